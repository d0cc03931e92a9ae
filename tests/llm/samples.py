"""Small tables with the awkward cases that every operator has to take."""

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977} über{k % 31}" for k in range(20_000))
ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, None),
    (4, "One two three", "en", "b"),
    (4, "One two three", "en", "b"),
    (None, "no id here", "en", "b"),
    (6, LONG, "de", "c"),
    (7, "日本語 текст \U0001f600 ß İ ", "xx", "c"),
    (8, "a a a a a a a a a a a a a a a\na a a\na a a\n\n", "fr", "c"),
]


def awkward(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 AS n_words", "'x' AS spans", "true AS kept", "'y' AS node", "2L AS start", "0 AS part")


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")
