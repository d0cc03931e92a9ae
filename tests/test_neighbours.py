import random

import pytest
from pyspark.sql import functions as F

from siltworks.functions import similarity as S
from siltworks.resolve import neighbours as N

from .plans import join_rows


def slip(a, b):
    """A letter put in or left out, or two neighbours swapped, after the third, in names of seven letters or more."""
    if a == b or min(len(a.replace(" ", "")), len(b.replace(" ", ""))) < 7 or any(c.isdigit() for c in a + b):
        return False
    short, long = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    if at < 3:
        return False
    if len(long) == len(short) + 1:
        return long[at] != " " and long[:at] + long[at + 1 :] == short
    return len(long) == len(short) and " " not in a[at : at + 2] and a[:at] + a[at : at + 2][::-1] + a[at + 2 :] == b


def edits(word, letters):
    """All that one edit makes of a word."""
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in letters)
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            yield from (word[:k] + c + word[k + 1 :] for c in letters)
        if k + 1 < len(word):
            yield word[:k] + word[k + 1] + word[k] + word[k + 2 :]


def test_equal_to_brute_force_on_many_words(spark):
    r = random.Random(5)
    letters = "ABCDEFGÉ"
    words = {"".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(130_000)}
    words = sorted(words)[:100_000]
    known = set(words)
    want = {(min(w, x), max(w, x)) for w in words for x in edits(w, letters) if x in known and x != w}
    got = N.one_edit(spark.createDataFrame([(w,) for w in words], "name string")).collect()
    assert len(got) == len(want) and {(g.a, g.b) for g in got} == want
    some = [g for g in got if hash(g.a) % 50 == 0]
    assert (S.damerau_batch([g.a for g in some], [g.b for g in some]) == 1).all()
    for g in some:
        swapped = len(g.a) == len(g.b) and sum(x != y for x, y in zip(g.a, g.b, strict=True)) == 2
        assert g.how == ("gap" if len(g.a) != len(g.b) else "swap" if swapped else "letter")


def test_odd_names(spark):
    names = ["", None, "A", "B", "AB", "BA", "AA", "AAA", "ABA", "A B", "AB ", "AB", "😀A", "A😀", "\u0001"]
    got = {(g.a, g.b, g.how) for g in N.one_edit(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    real = sorted({n for n in names if n is not None})
    pairs = [(a, b) for a in real for b in real if a < b]
    near = S.damerau_batch([a for a, _ in pairs], [b for _, b in pairs]) == 1
    assert {(a, b) for a, b, _ in got} == {p for p, k in zip(pairs, near, strict=True) if k}
    assert N.one_edit(spark.createDataFrame([], "name string")).collect() == []


def test_slips_decide_in_their_city(spark):
    r = random.Random(6)
    base = ["".join(r.choice("ABCD 7") for _ in range(r.randint(6, 9))).strip() for _ in range(150)] + ["MCKENNEYS", "ROOFING", "PLAIN STONE", "TOWER B2", "TAMARIS", "AABBBCC"]
    typed = [(k % 3, x) for k, b in enumerate(base) for x in r.sample(list(edits(b, "ABE 7")), 12)] + [(0, "MCKENNYS"), (0, "ROOFNIG"), (1, "PLAINSTONE"), (2, "TOWER B3"), (None, "ROOFIING")]
    known = [(k % 3, b) for k, b in enumerate(base)] + [(0, None), (None, "ROOFING")]
    wanted = spark.createDataFrame([(i, *t) for i, t in enumerate(typed)], "query_id int, city int, name string")
    got = {(g.query_id, g.found) for g in N.slips(wanted, spark.createDataFrame(known, "city int, name string"), ["city"]).collect()}
    want = {(i, b) for i, (c, t) in enumerate(typed) for k, b in known if c is not None and c == k and b and slip(t, b)}
    assert got == want and len(want) > 20


def test_spelling_in_city(spark):
    records = [("MCKENNEYS", "GA", "ATLANTA"), ("MARTINSON", "GA", "ATLANTA"), ("MARTINSSN", "GA", "ATLANTA"), ("BROWNING", "GA", "MACON"), ("COMMONER", "GA", "MACON"), (None, "GA", "MACON")]
    tiers = [(n, "medium" if n == "COMMONER" else "distinctive") for n, *_ in records if n]
    asked = [
        (1, "MCKENNYS", "GA", "ATLANTA", "MCKENNEYS"), (2, "MCKENNYS", "GA", "MACON", None), (3, "MARTINSSON", "GA", "ATLANTA", None), (4, "BROWNNIG", "GA", "MACON", "BROWNING"),
        (5, "COMMONNER", "GA", "MACON", None), (6, "BROWNING", "GA", "ATLANTA", None), (7, "BROWNNING", "GA", None, None), (8, None, "GA", "MACON", None), (9, "BROWNUNG", "GA", "MACON", None),
    ]
    q = spark.createDataFrame([a[:4] for a in asked], "query_id int, name string, state string, city string")
    got = dict(map(tuple, N.spelling_in_city(q, spark.createDataFrame(records, "name string, state string, city string"), spark.createDataFrame(tiers, "name string, tier string")).select("query_id", "corrected").collect()))
    assert got == {a[0]: a[4] for a in asked if a[4]}


@pytest.mark.parametrize("n", [0, 1, 700])
def test_damerau_batch(n):
    import duckdb

    r = random.Random(n)
    word = lambda: "".join(r.choice("ABC") for _ in range(r.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(n)]
    with duckdb.connect() as con:  # it counts bytes, so its words are ASCII
        want = [con.execute("SELECT damerau_levenshtein(?, ?)", p).fetchone()[0] for p in pairs]
    assert S.damerau_batch([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want
    assert S.damerau_batch([a.replace("C", "É") for a, _ in pairs], [b.replace("C", "É") for _, b in pairs]).tolist() == want


def test_keys_meet_by_equality(spark):
    plan = N.one_edit(spark.range(10).select(F.col("id").cast("string").alias("name")))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_similar_tokens_against_all_pairs(spark):
    """Words of all lengths, slips of each other: the pairs of a plain comparison, met by shared letters and not by first letters."""
    import random

    from siltworks.functions.similarity import winkler_batch
    from siltworks.resolve import candidates as C

    r, words = random.Random(5), {"A", "AB", "ABC", "ÄBCDE", "ÄCBDE", "AAAA", "AAAAA"}
    for _ in range(120):
        w = "".join(r.choice("ABCDE") for _ in range(r.randint(2, 17)))
        k = r.randrange(len(w))
        words |= {w, w[:k] + w[k + 1 :], w[:k] + r.choice("ABCDE") + w[k:], w[: k + 1][:-1] + w[k : k + 2][::-1] + w[k + 2 :]} - {""}
    words = sorted(words)
    pairs = [(a, b) for a in words for b in words if a[0] == b[0] and abs(len(a) - len(b)) <= 3]
    alike = winkler_batch([a for a, _ in pairs], [b for _, b in pairs]) >= 0.92
    df = spark.createDataFrame([(w,) for w in words], "token string")
    got = [tuple(x) for x in C.similar_tokens(df, df).collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p, x in zip(pairs, alike, strict=True) if x}
    # made words of one first letter meet few others: below, all pairs were compared
    many = spark.createDataFrame([("A" + "".join(r.choice("BCDEFGHIKLMNOPR") for _ in range(7)),) for _ in range(1000)], "token string").distinct()
    a, b = C._letter_keys(many, 0.92, True), C._letter_keys(many, 0.92, False)
    assert a.join(b, "key").count() < 100_000


def test_lookalikes_do_not_pair_all_names_at_an_address(spark):
    at = "'TX' AS state, 'WACO' AS city, '1 MAIN' AS addr_key"
    known = spark.sql(f"SELECT left(md5(cast(id AS string)), 9) || 'A' AS name, {at} FROM range(1000)")
    listed = spark.sql(f"SELECT left(md5(cast(id AS string)), 9) || 'B' AS name, {at} FROM range(1000)")
    found = N.lookalikes(listed, known, known.select("name").withColumn("tier", F.lit("distinctive")))
    rows = found.collect()
    assert len(rows) == 1000 and all(r.same_address and r.found == r["name"][:9] + "A" for r in rows)
    assert join_rows(found) < 100_000  # 1,000,000 pairs stand at the address
