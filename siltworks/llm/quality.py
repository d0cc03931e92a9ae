"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at a few counts of a text and votes good, bad, or abstains. How often each rule is right is
estimated by expectation-maximisation over the vote patterns, of which there are at most
3**len(RULES); a text's posterior probability of being good then replaces a test that all rules
must pass. The counts are written once to the shared folder; texts are read once and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

from .storage import materialise

SPACE = r"[ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
GOOD, BAD, NONE = 1, -1, 0
LEAST_WORDS = 50
#: bounds of what a rule's accuracy may come to; above one half, so that classes can't change places
ACCURACY = (0.55, 0.99)
ROUNDS, TOLERANCE = 100, 1e-9
LEAST_POSTERIOR = 0.5
#: frequent small words of English, French, German and Spanish; pass those of other languages to :func:`assess`
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "that", "de", "la", "le", "les", "et", "que", "des", "der", "die", "und", "das", "den", "en", "el", "los", "y", "las")


def counts(docs: DataFrame, function_words: tuple[str, ...] = FUNCTION_WORDS) -> DataFrame:
    """``doc_id`` and the counts that rules look at, for every row; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    n_chars = F.length(text)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        words.alias("words"),
        lines.alias("lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (n_chars - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    size = F.size("words")
    windows = F.transform(
        F.slice("words", F.lit(1), F.greatest(size - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")),
    )
    counted = base.select(
        "doc_id", "word_chars", "n_symbols",
        size.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, function_words)))).alias("n_function_words"),
        F.sort_array(windows).alias("sorted"),
    )
    same = lambda x, k: F.coalesce(F.get("sorted", k)["h"] == x["h"], F.lit(False))
    again = F.filter("sorted", lambda x, k: same(x, k + 1) | same(x, k - 1))
    starts = counted.select("*", F.sort_array(F.transform(again, lambda x: x["i"])).alias("starts"))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return starts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"), "n_function_words")


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, BAD)
    return (vote if good is None else vote.when(good, GOOD)).otherwise(NONE)


def votes() -> dict[str, Column]:
    """The rules, by the counts' columns.

    Most rules only speak against a text: not failing them says little, so then they abstain.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    length, share = F.col("word_chars") / n, lambda c: F.col(c) / n
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "size": _vote(F.col("n_words") < LEAST_WORDS),
        "word_length": _vote((length < 2.5) | (length > 12)),
        "symbols": _vote(share("n_symbols") > 0.1, share("n_symbols") < 0.02),
        "lines": _vote(lines > 0.3),
        "repeats": _vote(share("n_repeat_words") > 0.3),
        "function_words": _vote(F.col("n_function_words") <= 1, F.col("n_function_words") >= 5),
    }


RULES = ("size", "word_length", "symbols", "lines", "repeats", "function_words")


@dataclass(frozen=True)
class Model:
    """Log odds of good before any vote, and what a vote of each rule adds or takes."""

    prior: float
    weight: dict[str, float]

    def posterior(self, vote) -> Column:
        odds = F.lit(self.prior)
        for rule, w in self.weight.items():
            odds = odds + w * vote(rule)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> Model:
    """Expectation-maximisation for the share of good texts and each rule's accuracy.

    ``patterns`` holds each pattern of votes with its number of texts.
    """
    share, accuracy = 0.8, [0.7] * len(RULES)
    weight = lambda: [log(a / (1 - a)) for a in accuracy]
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        w, prior = weight(), log(share / (1 - share))
        good = [1 / (1 + exp(-prior - sum(x * v for x, v in zip(w, p, strict=True)))) for p, _ in patterns]
        new = []
        for j in range(len(RULES)):
            cast = sum(n for p, n in patterns if p[j])
            right = sum(n * (g if p[j] == GOOD else 1 - g) for (p, n), g in zip(patterns, good, strict=True) if p[j])
            new.append(min(ACCURACY[1], max(ACCURACY[0], (right + 0.7) / (cast + 1))))
        new_share = min(0.99, max(0.01, (sum(n * g for (_, n), g in zip(patterns, good, strict=True)) + 0.5) / (total + 1)))
        moved = max(abs(a - b) for a, b in zip([share, *accuracy], [new_share, *new], strict=True))
        share, accuracy = new_share, new
        if moved < TOLERANCE:
            break
    return Model(log(share / (1 - share)), dict(zip(RULES, weight(), strict=True)))


def assess(docs: DataFrame, function_words: tuple[str, ...] = FUNCTION_WORDS) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Texts with fewer than ``LEAST_WORDS`` words,
    null and empty ones among them, or more than half of whose words stand in repeated windows fail at
    once. Rows that repeat an id or have none are judged each for itself; a very long text is one row like any other. An
    empty table gives no rows.
    """
    counted = materialise(counts(docs, function_words), "quality")
    vote = votes()
    cast = counted.groupBy(*(vote[r].alias(r) for r in RULES)).agg(F.count("*").alias("n")).orderBy(*RULES).collect()
    model = fit([(tuple(r[x] for x in RULES), r.n) for r in cast])
    posterior = model.posterior(lambda r: vote[r])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counted.select(*columns, failed.alias("base_failed"), (~failed & (posterior >= LEAST_POSTERIOR)).alias("kept"), posterior.alias("posterior"))


def report(docs: DataFrame) -> DataFrame:
    """:func:`assess` without the posterior, whose last digits depend on the order of sums."""
    return assess(docs).drop("posterior")


_words = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
_n = len(RULES)
#: DuckDB's counterpart of :func:`report`: counts, votes, and the maximisation as a recursive query over vote patterns.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
counted AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, len(list_intersect(list_distinct(words), [{_words}])) AS n_function_words FROM w LEFT JOIN repeats USING (r)),
voted AS (SELECT *, [CASE WHEN n_words < {LEAST_WORDS} THEN -1 ELSE 0 END, CASE WHEN word_chars / m < 2.5 OR word_chars / m > 12 THEN -1 ELSE 0 END, CASE WHEN n_symbols / m > 0.1 THEN -1 WHEN n_symbols / m < 0.02 THEN 1 ELSE 0 END,
 CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.3 THEN -1 ELSE 0 END, CASE WHEN n_repeat_words / m > 0.3 THEN -1 ELSE 0 END, CASE WHEN n_function_words <= 1 THEN -1 WHEN n_function_words >= 5 THEN 1 ELSE 0 END] AS v FROM (SELECT *, greatest(n_words, 1) AS m FROM counted)),
patterns AS (SELECT list(v ORDER BY v) AS p, list(n ORDER BY v) AS n, sum(n)::DOUBLE AS total FROM (SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v)),
em AS (SELECT 0 AS k, 0.8::DOUBLE AS share, list_transform(range({_n}), lambda j: 0.7::DOUBLE) AS acc, 1.0::DOUBLE AS moved
 UNION ALL SELECT k + 1, new_share, new_acc, list_max(list_append(list_transform(range(1, {_n} + 1), lambda j: abs(new_acc[j] - acc[j])), abs(new_share - share))) FROM (
  SELECT *, least(0.99, greatest(0.01, (list_sum(list_transform(range(1, len(p) + 1), lambda i: n[i] * g[i])) + 0.5) / (total + 1))) AS new_share,
   list_transform(range(1, {_n} + 1), lambda j: least({ACCURACY[1]}, greatest({ACCURACY[0]}, (list_sum(list_transform(range(1, len(p) + 1), lambda i: n[i] * CASE p[i][j] WHEN 1 THEN g[i] WHEN -1 THEN 1 - g[i] ELSE 0 END)) + 0.7)
    / (list_sum(list_transform(range(1, len(p) + 1), lambda i: n[i] * abs(p[i][j]))) + 1)))) AS new_acc FROM (
   SELECT em.*, patterns.*, list_transform(p, lambda x: 1 / (1 + exp(-ln(share / (1 - share)) - list_sum(list_transform(range(1, {_n} + 1), lambda j: ln(acc[j] / (1 - acc[j])) * x[j]))))) AS g FROM em, patterns
   WHERE em.k < {ROUNDS} AND em.moved >= {TOLERANCE} AND total > 0))),
model AS (SELECT share, acc FROM em ORDER BY k DESC LIMIT 1),
judged AS (SELECT voted.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 1 / (1 + exp(-ln(share / (1 - share)) - list_sum(list_transform(range(1, {_n} + 1), lambda j: ln(acc[j] / (1 - acc[j])) * v[j])))) AS posterior FROM voted, model)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND posterior >= {LEAST_POSTERIOR} AS kept FROM judged
"""
