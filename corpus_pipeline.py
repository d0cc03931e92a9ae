"""Documents to training sequences: language ID, near-dedup, decontamination, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. All but the last return
the columns of ``docs`` with their values, whatever extra columns there are. An empty table goes through every stage. What a
stage returns is computed when it is written, so stages leave the session's Arrow batch size lowered. :func:`run`
writes each stage's rows to the shared folder, reads them back, deletes what the stage wrote besides, and restores
that setting.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.llm import decontaminate, langid, minhash, packing, secrets
from siltworks.llm.storage import arrow_batches, materialise, release, scratch, small_batches

#: Similarity in hundredths from which the stage takes two documents for near copies.
NEAR_COPY = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the learned languages.

    These are null texts, texts without a letter, and those whose ranks are so far from every profile that the score
    falls below a floor learned from labelled documents. Where no label was learned, nothing can be rejected but
    texts without a letter. Rows that repeat an id or have none are judged each by its text.
    """
    small_batches(spark)
    labelled = docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()).select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    profiles = langid.learn(labelled)
    apart = "_" * (1 + max(map(len, docs.columns)))  # longer than any name
    own = {c: apart + c for c in ("lang_pred", "score") if c in docs.columns}
    marked = langid.predict(docs.withColumnsRenamed(own), profiles)
    speaks = F.col("text").rlike(r"\p{L}") if not profiles.names else (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= langid.least_score(labelled, profiles))
    return marked.where(speaks).drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, numerator: int = minhash.NUMERATOR) -> DataFrame:
    """Keeps the document with the smallest id of each group; the stage links from ``NEAR_COPY`` on.

    Rows that repeat an id are one document and stay or go together; rows without an id stay.
    """
    small_batches(spark)
    kept = minhash.near_duplicates(docs.select("doc_id", "text"), numerator).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a span of a benchmark item.

    Null and empty texts hold none and stay, as do all documents if the benchmark is empty. Rows with equal texts,
    whatever their ids, stay or go together.
    """
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a marker and counts the characters of ``n_chars`` anew; every row stays.

    Null texts stay null and their n_chars is null; repeated rows are treated alike.
    """
    small_batches(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the pieces of all documents in sequences.

    A null or empty text is one piece, the end id alone. Rows that repeat an id, or have none, are documents of their own.
    """
    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), with_ids=False, keep_pieces=False).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", partial(drop_near_duplicates, numerator=NEAR_COPY)),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: Tokenizers and MinHash groups have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with arrow_batches(spark):
        for name, stage in STAGES[:-1]:
            with scratch(spark):
                after = materialise(stage(spark, docs, sf_dir), name, keep=True)
            if before is not None:
                release(before)
            before = docs = after
        packed = STAGES[-1][1](spark, docs, sf_dir)
    return packed
