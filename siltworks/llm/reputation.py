"""URL filters: explicit rules, then the empirical-Bayes reputation of the host.

Labelled outcomes of pages are counted by host. A host's rate of bad pages is shrunk towards its registered
domain's, that towards its suffix's, and that towards the overall rate. At each level the prior is a
beta distribution whose mean is the parent's posterior mean and whose strength comes from how far
the children's rates lie apart (method of moments). What a child itself counted is left out of its parent's
rate, so no outcome counts twice. A host is blocked if the lower bound of its
posterior, ``Z`` standard deviations below the mean, exceeds ``BLOCK_RATE``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .storage import materialise, release

#: Rules of the kind that the public suffix list has: ``co.uk``, ``*.ck``, ``!www.ck``. These stand in for a caller's own
#: list; a host that no rule fits has a suffix of one label.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.jp", "co.kr", "com.br", "com.cn", "com.mx")
BLOCK_RATE = 0.5
Z = 1.645
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains, where the path starts as given."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty if the url is null or has no ``://``."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def with_domains(hosts: DataFrame, suffix_rules: DataFrame) -> DataFrame:
    """``hosts(host, ...)`` with ``domain`` and ``suffix``, user and port left out; an address is its own domain.

    ``suffix_rules`` has the column ``suffix_rule``. Of the rules that fit the longest counts, exceptions before all.
    """
    named = hosts.withColumn("_bare", F.regexp_replace("host", r"\A.*@|:[0-9]*\z", "")).withColumn("_labels", F.split("_bare", r"\."))
    n = F.size("_labels")
    # as many labels of a host's end are looked up as the longest rule has
    most = suffix_rules.agg(F.max(F.size(F.split("suffix_rule", r"\.")))).first()[0] or 1
    end = lambda k: F.array_join(F.slice("_labels", n - F.least(k, n) + 1, F.least(k, n)), ".")
    rule = lambda text, k: F.struct(text.alias("suffix_rule"), k.alias("length"))
    looked_for = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.array(rule(end(k), k), rule(F.concat(F.lit("*."), end(k - 1)), k), rule(F.concat(F.lit("!"), end(k)), k - 1)))
    known = named.select("host", F.explode(F.flatten(looked_for)).alias("r")).select("host", "r.*").join(suffix_rules, "suffix_rule")
    best = known.groupBy("host").agg(F.max(F.struct(F.col("suffix_rule").startswith("!"), "length")).getField("length").alias("_length"))
    numeric, size = F.col("_bare").rlike(r"\A[0-9]+(\.[0-9]+){3}\z"), F.coalesce("_length", F.lit(1))
    read = lambda k: F.when(numeric, F.col("_bare")).otherwise(end(k))
    return named.join(best, "host", "left").withColumns({"domain": read(size + 1), "suffix": read(size)}).drop("_bare", "_labels", "_length")


def _strength(children: DataFrame, mean: float) -> float:
    """Of the prior whose draws the children's rates are, by the method of moments."""
    r = children.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (F.col("bad") / F.col("n") - mean) ** 2).alias("q")).first()
    if not r.k or r.k < 2:
        return MOST_STRENGTH
    spread = mean * (1 - mean)
    between = (r.q - (r.k - 1) * spread) / (r.n - r.nn / r.n)
    if between <= 0:
        return MOST_STRENGTH
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, spread / between - 1))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, block_rate: float = BLOCK_RATE, z: float = Z, suffix_rules: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bad_rate_low`` of every page.

    ``pages`` has ``page_id`` and ``url``; ``outcomes`` has ``page_id`` and ``bad`` (0 or 1), of which rows
    with nulls are left out. Hosts are counted before any shuffle of pages. Hosts without outcomes
    take their domain's rate, or their suffix's, or the overall one; with no outcomes at all the rate is
    one half and pages that no rule fits are allowed. An empty table gives no rows. Rows that repeat a page_id are judged
    each for itself; those without one count for no host and are judged by theirs. Other columns are ignored. A whole
    public suffix list can be given as ``suffix_rules(suffix_rule)``.
    """
    host, path = url_parts(F.col("url").cast("string"))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("double")).alias("bad"))
    labelled = named.join(known, "page_id", "left")
    if suffix_rules is None:
        suffix_rules = pages.sparkSession.createDataFrame([(s,) for s in SUFFIXES], "suffix_rule string")
    counted = materialise(labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")), "hosts")
    hosts = materialise(with_domains(counted, suffix_rules), "domains")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")).first()
    mean = (total.bad + 0.5) / (total.n + 1)
    s_suffix, s_domain, s_host = (_strength(x.where("n > 0"), mean) for x in (suffixes, domains, hosts))
    of_suffix = suffixes.select("suffix", F.col("n").alias("suffix_n"), F.col("bad").alias("suffix_bad"))
    of_domain = domains.join(of_suffix, "suffix").select("domain", "suffix", F.col("n").alias("domain_n"), F.col("bad").alias("domain_bad"), "suffix_n", "suffix_bad")
    shrunk = lambda bad, n, parent, s: (bad + s * parent) / (n + s)
    c = F.col
    suffix_rate = shrunk(c("suffix_bad") - c("domain_bad"), c("suffix_n") - c("domain_n"), F.lit(mean), s_suffix)
    domain_rate = shrunk(c("domain_bad") - c("bad"), c("domain_n") - c("n"), suffix_rate, s_domain)
    rate = shrunk(c("bad"), c("n"), domain_rate, s_host)
    low = F.col("bad_rate") - z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n") + s_host + 1))
    by_host = hosts.join(of_domain, ["domain", "suffix"]).select("host", "n", rate.alias("bad_rate")).select("host", "bad_rate", low.alias("bad_rate_low"))
    by_host = materialise(by_host, "reputations")
    release(counted, hosts)
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("bad_rate_low") > block_rate) & F.lit(total.n > 0), "block").otherwise("allow")
    return named.join(by_host, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "bad_rate", "bad_rate_low")


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdicts on ``pages``; a page's outcome is the label of its id, bad if toxic or of low quality."""
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


_IN = ", ".join(f"'{s}'" for s in SUFFIXES)
#: DuckDB's counterpart of :func:`report` with the default parameters.
ORACLE_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), known AS (
  SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS bad FROM labels GROUP BY 1
), bare AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0.0::DOUBLE) AS bad, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS p
  FROM named LEFT JOIN known USING (page_id) GROUP BY host
), cutup AS (
  SELECT host, n, bad, array_to_string(p, '.') AS bare, array_to_string(p[greatest(len(p) - 1, 1):], '.') AS two, array_to_string(p[greatest(len(p) - 2, 1):], '.') AS three, p[len(p)] AS one FROM bare
), hosts AS (
  SELECT host, n, bad,
    CASE WHEN regexp_full_match(bare, '[0-9]+(\.[0-9]+){{3}}') THEN bare WHEN two IN ({_IN}) THEN three ELSE two END AS domain,
    CASE WHEN regexp_full_match(bare, '[0-9]+(\.[0-9]+){{3}}') THEN bare WHEN two IN ({_IN}) THEN two ELSE one END AS suffix FROM cutup
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2
), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1
), total AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1)::DOUBLE AS mean, coalesce(sum(n), 0) AS n FROM suffixes
), levels AS (
  SELECT 'suffix' AS level, n, bad FROM suffixes WHERE n > 0 UNION ALL SELECT 'domain', n, bad FROM domains WHERE n > 0 UNION ALL SELECT 'host', n, bad FROM hosts WHERE n > 0
), moments AS (
  SELECT level, count(*) AS k, max(mean * (1 - mean)) AS spread,
    (sum(levels.n * (bad / levels.n - mean) ** 2) - (count(*) - 1) * max(mean * (1 - mean))) / nullif(sum(levels.n) - sum(levels.n * levels.n) / sum(levels.n), 0) AS between_
  FROM levels, total GROUP BY level
), strength AS (
  SELECT level, CASE WHEN k < 2 OR between_ <= 0 THEN {MOST_STRENGTH} ELSE least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, spread / between_ - 1)) END AS s FROM moments
), s AS (
  SELECT coalesce(max(s) FILTER (level = 'suffix'), {MOST_STRENGTH}) AS s_suffix, coalesce(max(s) FILTER (level = 'domain'), {MOST_STRENGTH}) AS s_domain, coalesce(max(s) FILTER (level = 'host'), {MOST_STRENGTH}) AS s_host FROM strength
), of_domain AS (
  SELECT domain, suffix, domains.n AS domain_n, domains.bad AS domain_bad, (suffixes.bad - domains.bad + s_suffix * mean) / (suffixes.n - domains.n + s_suffix) AS r
  FROM domains JOIN suffixes USING (suffix), total, s
), by_host AS (
  SELECT host, n, s_host, (bad + s_host * ((domain_bad - bad + s_domain * r) / (domain_n - n + s_domain))) / (n + s_host) AS r FROM hosts JOIN of_domain USING (domain, suffix), s
), judged AS (
  SELECT host, CASE WHEN total.n > 0 AND r - {Z} * sqrt(r * (1 - r) / (by_host.n + s_host + 1)) > {BLOCK_RATE} THEN 'block' ELSE 'allow' END AS own FROM by_host, total
), ruled AS (
  SELECT page_id, named.host, path, own,
    CASE WHEN (named.host = 'example.net' OR ends_with(named.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (named.host = 'example.com' OR ends_with(named.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (named.host = 'org' OR ends_with(named.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (named.host = 'net' OR ends_with(named.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM named JOIN judged USING (host)
)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' ELSE own END AS verdict FROM ruled
"""
