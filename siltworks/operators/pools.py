"""Rows drawn for an evaluation: strata that may overlap, and names with a slip put in. Draws hang on a digest of the row alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltworks.operators.rows import top_k

#: A slip goes into words of so many letters, after so many of them.
SLIP_WORD, SLIP_AFTER = 5, 3


def number_of(digest: Column, most: Column, at: int = 1) -> Column:
    """A number from 0 below ``most``, from eight hexadecimal digits of a digest."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % most


def draw(rows: DataFrame, key: str, strata: dict[str, tuple[Column, int]], seed: int = 0) -> DataFrame:
    """``rows``' columns and ``pool``: of each stratum the rows with the least digests, as many as it asks for.

    A row in several strata is drawn for each on its own, with its name in the digest, and comes once, for the first. All strata are drawn
    in one pass; tasks keep as many rows of each as it asks for, so neither the partitioning nor the order of rows matters. Rows
    with equal keys have equal digests; the other columns, as text, then decide.
    """
    text = F.col(key).cast("string")
    member = lambda k, name, holds: F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.md5(F.concat_ws("|", text, F.lit(name), F.lit(str(seed)))).alias("digest")))
    found = F.array_compact(F.array(*(member(k, name, holds) for k, (name, (holds, _)) in enumerate(strata.items()))))
    each = rows.withColumn("_p", F.explode(found)).withColumns({"_k": F.col("_p.k"), "_digest": F.col("_p.digest"), "pool": F.col("_p.name")}).drop("_p")
    tie = F.to_json(F.struct(*rows.columns))
    most = max(n for _, n in strata.values())
    first = top_k(each, ["_k"], [F.col("_digest"), tie], most, rank="_rank")
    sizes = F.element_at(F.array(*(F.lit(n) for _, n in strata.values())), F.col("_k") + 1)
    kept = first.where(F.col("_rank") <= sizes)
    return top_k(kept, [key], [F.col("_k"), F.col("_rank")]).select(*rows.columns, "pool")


def slip(word: Column, digest: Column) -> Column:
    """The word with a letter left out, doubled or swapped with the next, past the third and before the last; by the digest."""
    at = (number_of(digest, F.greatest(F.length(word) - SLIP_AFTER - 1, F.lit(1))) + SLIP_AFTER + 1).cast("int")
    head, here, tail = F.left(word, at - 1), F.substr(word, at, F.lit(1)), F.substr(word, at + 1)
    kind = number_of(digest, F.lit(3), 9)
    return F.when(kind == 0, F.concat(head, tail)).when(kind == 1, F.concat(head, here, here, tail)).otherwise(F.concat(head, F.substr(tail, F.lit(1), F.lit(1)), here, F.substr(tail, F.lit(2))))


def typos(rows: DataFrame, key: str, name: str, core: str, seed: int = 0) -> DataFrame:
    """``rows``' columns and ``typo``: the name with a slip in the longest word of its core, the first of several.

    Cores whose longest word is short, and slips that change nothing (two equal letters swapped), give no row.
    """
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    longest = F.reduce(words(core), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    df = rows.withColumn("_w", longest).where(F.length("_w") >= SLIP_WORD)
    df = df.withColumn("_s", slip(F.col("_w"), F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit("typo"), F.lit(str(seed)))))).where("_s != _w")
    put = F.array_join(F.transform(words(name), lambda w: F.when(w == F.col("_w"), F.col("_s")).otherwise(w)), " ")
    return df.withColumn("typo", put).drop("_w", "_s")
