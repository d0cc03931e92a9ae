"""Open questions to people: asking, uniting, covering other records of a company, and taking records back out.

A question is one row: question_id, sub_id (who is asked about), kind, suggestion (yes, no or null), created, answer (null while it is
open), entity_keys. What a question says is worked out from its records, never kept apart from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltworks.operators.components import components

#: A subject's groups that get a question each; with more of them, names do.
GROUPED_FROM = 12
#: Records of one company name that a question or an answer brings in.
CARRIED = 20
PLACES_SHOWN = 5
DISTINCTIVE, PERSON = "distinctive", "person"
DECIDED_BY_PEOPLE = ("user", "remap")


def questions_for(groups: DataFrame, threshold: int = GROUPED_FROM) -> DataFrame:
    """``sub_id, asked, entity_keys, suggestion, red_flags``: what to ask of red-flagged groups that rules leave uncertain.

    ``groups`` has sub_id, name, state, tier, entity_keys, lean (yes, no or null) and red_flags, a row for each group. A
    subject with up to ``threshold`` groups is asked about each; with more, about each name in all its states. A person's name
    never stands for more than one group. A suggestion is made only if all groups of a question lean that way. ``asked`` numbers a
    subject's questions, most red flags first.
    """
    sub = Window.partitionBy("sub_id")
    many = F.count("*").over(sub) > threshold
    person = F.max(F.when(F.col("tier") == PERSON, 1).otherwise(0)).over(sub) == 1
    g = groups.withColumn("_by_name", many & ~person)
    g = g.withColumn("_state", F.when(~F.col("_by_name"), F.coalesce("state", F.lit(""))))
    lean = F.when((F.count("lean") == F.count("*")) & (F.min("lean") == F.max("lean")), F.min("lean"))
    asked = g.groupBy("sub_id", "name", "_state").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("entity_keys")))).alias("entity_keys"), lean.alias("suggestion"), F.sum("red_flags").alias("red_flags"))
    order = Window.partitionBy("sub_id").orderBy(F.desc("red_flags"), F.asc_nulls_first("name"), F.asc_nulls_first("_state"))
    return asked.withColumn("asked", F.row_number().over(order)).select("sub_id", "asked", "entity_keys", "suggestion", "red_flags")


def _opened(questions: DataFrame) -> DataFrame:
    return questions.where("answer is null and kind != 'remap'")


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", "sub_id", F.explode("entity_keys").alias("entity_key")).distinct()


def company_names(records: DataFrame, tiers: DataFrame) -> DataFrame:
    """``entity_key, name`` of records under a distinctive name, which no other company and no person shares."""
    return records.join(tiers.where(F.col("tier") == DISTINCTIVE).select("name"), "name").select("entity_key", "name")


def united(questions: DataFrame, records: DataFrame, tiers: DataFrame, own_names: DataFrame, keep: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """``question_id, label``: the open questions of a subject that are one, by the least question_id.

    Two are one if they ask about the same record, or about records of one company: an equal distinctive name that
    isn't the subject's own. Evidence of the same kind (profile or web) that suggests the same is one question too. A question about a
    person's name is never united with any. ``records`` has entity_key and name, ``tiers`` name and tier, ``own_names`` sub_id and name. The
    result depends on the rows alone, not on their order.
    """
    opened = _opened(questions)
    asked = _asked(opened)
    named = asked.join(records.select("entity_key", "name"), "entity_key").join(tiers, "name", "left")
    persons = named.where(F.col("tier") == PERSON).select("question_id").distinct()
    free = opened.join(persons, "question_id", "left_anti")
    in_free = asked.join(persons, "question_id", "left_anti")
    key = lambda kind, *c: F.concat_ws("\u0001", F.lit(kind), F.col("sub_id").cast("string"), *c)
    same_record = in_free.select(F.col("question_id").alias("node"), key("record", F.col("entity_key")).alias("key"))
    company = in_free.join(company_names(records, tiers), "entity_key").join(own_names.select("sub_id", "name"), ["sub_id", "name"], "left_anti")
    same_name = company.select(F.col("question_id").alias("node"), key("name", F.col("name")).alias("key"))
    evidence = free.where("kind in ('profile', 'web')").select(F.col("question_id").alias("node"), key("evidence", F.col("kind"), F.coalesce("suggestion", F.lit(""))).alias("key"))
    alone = opened.select(F.col("question_id").alias("node"), key("self", F.col("question_id").cast("string")).alias("key"))
    return components(same_record.unionByName(same_name).unionByName(evidence).unionByName(alone), keep).withColumnsRenamed({"node": "question_id"})


def merge_open(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """``questions`` rewritten by key: of each set of united ones the oldest takes all records, the others are gone.

    A suggestion stays if all agree. Answered questions and those about moved records stay as they are.
    """
    opened = questions.join(labels, "question_id")
    oldest = F.struct("created", "question_id")
    agree = F.when((F.count("suggestion") == F.count("*")) & (F.min("suggestion") == F.max("suggestion")), F.min("suggestion"))
    one = opened.groupBy("label").agg(
        F.min_by("question_id", oldest).alias("question_id"), F.min_by("sub_id", oldest).alias("sub_id"), F.min_by("kind", oldest).alias("kind"), agree.alias("suggestion"), F.min("created").alias("created"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("entity_keys")))).alias("entity_keys"),
    )
    rest = questions.join(labels.select("question_id"), "question_id", "left_anti")
    return rest.unionByName(one.drop("label").withColumn("answer", F.lit(None).cast("string")).select(*questions.columns))


def covered(questions: DataFrame, records: DataFrame, tiers: DataFrame, own_names: DataFrame, decisions: DataFrame, most: int = CARRIED) -> DataFrame:
    """``question_id, sub_id, entity_key, name``: records that an open question covers as well, being of the same company (rule C1).

    They are the largest of the name's records that no open question of the subject asks about, that people haven't decided and that aren't
    matched, ``most`` for each name. Where several questions name a company, the least question_id takes its records. ``decisions`` has
    sub_id, entity_key, bucket, method.
    """
    opened = _opened(questions)
    # an open question about moved records keeps its records to itself
    asked_any = questions.where("answer is null").select("sub_id", F.explode("entity_keys").alias("entity_key")).distinct()
    names = company_names(records, tiers)
    about = _asked(opened).join(names, "entity_key").join(own_names.select("sub_id", "name"), ["sub_id", "name"], "left_anti")
    first = about.groupBy("sub_id", "name").agg(F.min("question_id").alias("question_id"))
    held = decisions.where(F.col("method").isin(*DECIDED_BY_PEOPLE) | (F.col("bucket") == "matched")).select("sub_id", "entity_key")
    more = first.join(names.join(records.select("entity_key", "n"), "entity_key"), "name").join(asked_any, ["sub_id", "entity_key"], "left_anti").join(held, ["sub_id", "entity_key"], "left_anti")
    place = F.row_number().over(Window.partitionBy("sub_id", "name").orderBy(F.desc_nulls_last("n"), "entity_key"))
    return more.withColumn("_n", place).where(F.col("_n") <= most).select("question_id", "sub_id", "entity_key", "name")


def take_in(questions: DataFrame, found: DataFrame) -> DataFrame:
    """``questions`` with the records of ``found(question_id, entity_key)`` added to theirs."""
    added = found.groupBy("question_id").agg(F.array_sort(F.collect_set("entity_key")).alias("_more"))
    both = F.when(F.col("_more").isNotNull(), F.array_sort(F.array_distinct(F.concat("entity_keys", "_more")))).otherwise(F.col("entity_keys"))
    return questions.join(added, "question_id", "left").withColumn("entity_keys", both).select(*questions.columns)


def unask(questions: DataFrame, settled: DataFrame) -> DataFrame:
    """``questions`` without the records of ``settled(sub_id, entity_key)``; open ones left with nothing to ask are withdrawn."""
    opened = questions.where("answer is null")
    gone = _asked(opened).join(settled.select("sub_id", "entity_key").distinct(), ["sub_id", "entity_key"], "left_semi").groupBy("question_id").agg(F.collect_set("entity_key").alias("_gone"))
    left = questions.join(gone, "question_id", "left").withColumn("entity_keys", F.when(F.col("_gone").isNotNull(), F.array_except("entity_keys", "_gone")).otherwise(F.col("entity_keys")))
    return left.where("answer is not null or _gone is null or size(entity_keys) > 0").select(*questions.columns)


def _plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def wording(questions: DataFrame, records: DataFrame, subjects: DataFrame, shown: int = PLACES_SHOWN, parts: int | None = None) -> DataFrame:
    """``question_id, text``: what a question says of its records as they are now.

    ``records`` has entity_key, name, city, state, n, first_year, last_year; ``subjects`` sub_id and entered_name. Places are counted
    once each, the ones with most records first; names and places beyond ``shown`` are counted only. ``parts`` is the number of partitions to deal
    questions over; left out, the session's.
    """
    rows = _asked(_opened(questions)).join(records, "entity_key")
    if parts:
        rows = rows.repartition(parts, "question_id")
    total = rows.groupBy("question_id", "sub_id").agg(F.sum("n").alias("n"), F.min("first_year").alias("since"), F.max("last_year").alias("until"))
    listed = lambda c: F.concat(F.array_join(F.slice(c, 1, shown), "; "), F.when(F.size(c) > shown, F.concat(F.lit(" and "), _plural(F.size(c) - shown, "more", "more"))).otherwise(F.lit("")))

    def each(what: Column, name: str) -> DataFrame:
        counted = rows.withColumn(name, what).groupBy("question_id", name).agg(F.count("*").alias("k"))
        return counted.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("k"), name))), lambda s: s[name]).alias(name))

    names = each(F.col("name"), "names")
    places = each(F.coalesce(F.nullif(F.concat_ws(", ", "city", "state"), F.lit("")), F.lit("no place on file")), "places")
    full = total.join(names, "question_id").join(places, "question_id").join(subjects, "sub_id")
    years = F.when(F.col("since") == F.col("until"), F.col("since").cast("string")).otherwise(F.concat_ws(" to ", F.col("since").cast("string"), F.col("until").cast("string")))
    text = F.concat(_plural(F.col("n"), "inspection", "inspections"), F.lit(", "), years, F.lit(", under "), listed(F.col("names")), F.lit(" ("), listed(F.col("places")), F.lit("). The same company as "), F.col("entered_name"), F.lit("?"))
    return full.select("question_id", text.alias("text"))


def carry(answers: DataFrame, decisions: DataFrame, records: DataFrame, tiers: DataFrame, own_names: DataFrame, most: int = CARRIED) -> DataFrame:
    """``sub_id, entity_key, bucket``: records that an answer about one of their company's settles too (rule C1).

    ``answers`` has sub_id, entity_key and bucket. Only matched and excluded are carried, to records of the same distinctive
    name that aren't the subject's own. Never to a record with red flags, to one that is matched or that people have
    decided and, for a match, to one in a state where none of the answered records is. Of answers that disagree none is carried.
    ``records`` has entity_key, name, state, n, red_flags.
    """
    said = answers.where("bucket in ('matched', 'excluded')").select("sub_id", "entity_key", "bucket")
    names = company_names(records, tiers)
    about = said.join(names, "entity_key").join(own_names.select("sub_id", "name"), ["sub_id", "name"], "left_anti").join(records.select("entity_key", "state"), "entity_key")
    one = about.groupBy("sub_id", "name").agg(F.min("bucket").alias("bucket"), F.max("bucket").alias("_other"), F.collect_set("state").alias("states")).where("bucket = _other")
    calm = records.where("coalesce(red_flags, 0) = 0").select("entity_key", "state", "n")
    found = one.join(names, "name").join(calm, "entity_key")
    found = found.where((F.col("bucket") == "excluded") | F.coalesce(F.array_contains("states", F.col("state")), F.lit(False)))
    held = decisions.where(F.col("method").isin(*DECIDED_BY_PEOPLE) | (F.col("bucket") == "matched")).select("sub_id", "entity_key").unionByName(answers.select("sub_id", "entity_key"))
    found = found.join(held, ["sub_id", "entity_key"], "left_anti")
    place = F.row_number().over(Window.partitionBy("sub_id", "name").orderBy(F.desc_nulls_last("n"), "entity_key"))
    return found.withColumn("_n", place).where(F.col("_n") <= most).select("sub_id", "entity_key", "bucket")
