"""Names one edit apart, found by equality: a deletion-neighbourhood index.

Each name is written out with every letter left out, every letter blanked and every two neighbours swapped. Names that are one
edit apart then agree on a key, so a join finds all such pairs and compares none that it need not:

- a gap: one name equals the other without a letter,
- a swap: one name equals the other with two neighbours swapped,
- a letter: both are equal with the same place blanked.

A name has about three keys a letter, whatever the number of names; a key is shared by at most as many names as there are letters
in use, so no key grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GAP, SWAP, LETTER = "gap", "swap", "letter"
#: A slip is safe to search by only in names of so many letters, after so many that are right.
SLIP_LETTERS, SLIP_AFTER = 7, 3
_BLANK = "\u0001"


def _places(name: Column) -> Column:
    """``(at, head, here, next, tail)`` of each letter: what stands before and after it."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda k: k <= F.length(name))
    part = lambda k: F.struct(k.alias("at"), F.left(name, k - 1).alias("head"), F.substr(name, k, F.lit(1)).alias("here"), F.substr(name, k + 1, F.lit(1)).alias("next"), F.substr(name, k + 1).alias("tail"))
    return F.transform(at, part)


def written_out(names: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``how, key, at, off``: one row for each way to write a name with an edit.

    ``at`` is the edit's place from 1, ``off`` the letters that it touches. Equal letters side by side give one gap, at the last of
    them. Null and empty names have no row.
    """
    one = names.withColumn("_p", F.explode(_places(F.col(name))))
    p = lambda f: F.col(f"_p.{f}")
    edit = lambda how, key, off: F.struct(F.lit(how).alias("how"), key.alias("key"), off.alias("off"))
    gap = F.when(p("here") != p("next"), edit(GAP, F.concat(p("head"), p("tail")), p("here")))
    swap = F.when((p("next") != "") & (p("here") != p("next")), edit(SWAP, F.concat(p("head"), p("next"), p("here"), F.substr(p("tail"), F.lit(2))), F.concat(p("here"), p("next"))))
    blank = edit(LETTER, F.concat(p("head"), F.lit(_BLANK), p("tail")), p("here"))
    edits = one.withColumn("_e", F.explode(F.array_compact(F.array(gap, swap, blank))))
    return edits.select(*names.columns, F.col("_e.how").alias("how"), F.col("_e.key").alias("key"), p("at").alias("at"), F.col("_e.off").alias("off"))


def one_edit(names: DataFrame, parts: int | None = None) -> DataFrame:
    """``a, b, how``: pairs of different names with ``a < b`` that are one edit apart, each pair once.

    ``names`` has ``name``; repeated and null names count once and never. Pairs that a swap and letters could both explain are
    one edit only as a swap, so no pair has two rows. Keys meet in ``parts`` partitions, if it is given.
    """
    dealt = lambda df: df.repartition(parts, "key") if parts else df
    own = names.select("name").where("name is not null").distinct()
    edits = written_out(own)
    whole = dealt(own.select(F.col("name").alias("other"), F.col("name").alias("key")))
    pair = [F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b"), "how"]
    gaps = dealt(edits.where(F.col("how") == GAP).select("key", "name", "how")).join(whole, "key").select(*pair)
    swaps = dealt(edits.where(F.col("how") == SWAP).select("key", "name", "how")).join(whole, "key").where("name < other").select(*pair)
    left = dealt(edits.where(F.col("how") == LETTER).select("key", "name"))
    letters = left.join(left.select("key", F.col("name").alias("other")), "key").where("name < other").select(*pair[:2], F.lit(LETTER).alias("how"))
    return gaps.unionByName(swaps).unionByName(letters)


def _letters(c: Column) -> Column:
    return F.length(F.replace(c, F.lit(" "), F.lit("")))


def is_one_slip(how: Column, at: Column, off: Column, a: Column, b: Column) -> Column:
    """Whether an edit found by :func:`written_out` is a typing slip: a letter put in or left out, or two neighbours swapped.

    Not in the first three letters, not in short names, not a digit's or a space's, and no other letter in a letter's
    place: those are usually other names.
    """
    digit = a.rlike("[0-9]") | b.rlike("[0-9]")
    long = F.least(_letters(a), _letters(b)) >= SLIP_LETTERS
    return how.isin(GAP, SWAP) & (at > SLIP_AFTER) & ~F.contains(off, F.lit(" ")) & ~digit & long


def slips(wanted: DataFrame, known: DataFrame, within: list[str]) -> DataFrame:
    """``wanted``'s columns and ``found``: names of ``known`` one slip away that agree on the columns ``within``.

    Both have ``name`` and the columns ``within``; nulls in those agree with nothing. Each pair comes once.
    """
    k = known.select(*within, F.col("name").alias("found")).where("found is not null").distinct()
    w = wanted.where("name is not null")
    edited = written_out(w.select(*within, "name").distinct())
    added = edited.join(k.withColumn("key", F.col("found")), [*within, "key"])  # known = wanted without a letter, or swapped
    good = added.where(is_one_slip(F.col("how"), F.col("at"), F.col("off"), F.col("name"), F.col("found"))).select(*within, "name", "found")
    gaps = written_out(k.withColumnRenamed("found", "name")).where(F.col("how") == GAP).withColumnsRenamed({"name": "found", "key": "name"})
    dropped = w.select(*within, "name").distinct().join(gaps, [*within, "name"])  # wanted = known without a letter
    good = good.unionByName(dropped.where(is_one_slip(F.col("how"), F.col("at"), F.col("off"), F.col("name"), F.col("found"))).select(*within, "name", "found"))
    return w.join(good.distinct(), [*within, "name"]).select(*wanted.columns, "found")


def spelling_in_city(queries: DataFrame, records: DataFrame, tiers: DataFrame) -> DataFrame:
    """``query_id, corrected``: the one distinctive record name a slip from the query's in its own city.

    ``queries`` has query_id, name, state, city (a comparable key); ``records`` name, state, city; ``tiers`` name, tier. A query whose
    name stands on any record is right as it is. Two names a slip away say nothing, nor does a name that isn't
    distinctive. Queries without a state or city, and null names, are left alone.
    """
    known = lambda df: df.where("state != '' and city != ''")
    open_ = known(queries).join(records.select("name").where("name is not null").distinct(), "name", "left_anti")
    found = slips(open_.select("query_id", "name", "state", "city"), known(records), ["state", "city"])
    one = found.groupBy("query_id").agg(F.count_distinct("found").alias("n"), F.min("found").alias("corrected")).where("n = 1")
    sure = tiers.where("tier = 'distinctive'").select(F.col("name").alias("corrected"))
    return one.join(sure, "corrected", "left_semi").select("query_id", "corrected")


def one_edit_within(wanted: DataFrame, known: DataFrame, within: list[str]) -> DataFrame:
    """``within``, ``name``, ``found``: different names of ``known`` one edit of any kind from a name of ``wanted`` that agree on ``within``."""
    w = wanted.select(*within, "name").where("name is not null").distinct()
    k = known.select(*within, F.col("name").alias("found")).where("found is not null").distinct()
    mine, theirs = written_out(w), written_out(k, "found")
    out = [*within, "name", "found"]
    shorter = mine.where(F.col("how").isin(GAP, SWAP)).join(k.withColumn("key", F.col("found")), [*within, "key"]).select(*out)
    longer = theirs.where(F.col("how") == GAP).join(w.withColumn("key", F.col("name")), [*within, "key"]).select(*out)
    letter = lambda df, c: df.where(F.col("how") == LETTER).select(*within, "key", c)
    other = letter(mine, "name").join(letter(theirs, "found"), [*within, "key"]).where("name != found").select(*out)
    return shorter.unionByName(longer).unionByName(other).distinct()


def lookalikes(listed: DataFrame, records: DataFrame, tiers: DataFrame) -> DataFrame:
    """``name, state, city, found, same_address``: listed names without a record that are one edit from just one distinctive name in their city.

    ``listed`` and ``records`` have name, state, city, addr_key; ``tiers`` name, tier. Names at a common address are most likely
    slips, the others companies that look alike.
    """
    sure = records.join(tiers.where("tier = 'distinctive'").select("name"), "name", "left_semi").where("name != ''")
    lost = listed.where("name != ''").join(records.select("name").distinct(), "name", "left_anti")
    found = one_edit_within(lost, sure, ["state", "city"])
    one = found.groupBy("name", "state", "city").agg(F.min("found").alias("found"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    # Only what was found is looked up at its addresses: all pairs of an address grow with the square of its names.
    where = ["state", "city", "addr_key"]
    asked = one.join(lost.select("name", *where).distinct(), ["name", "state", "city"])
    at = asked.join(sure.select(F.col("name").alias("found"), *where).distinct(), ["found", *where], "left_semi").select("name", "state", "city", "found").distinct()
    return one.join(at.withColumn("same_address", F.lit(True)), ["name", "state", "city", "found"], "left").select("name", "state", "city", "found", F.coalesce("same_address", F.lit(False)).alias("same_address"))
