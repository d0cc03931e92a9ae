"""Names, addresses, codes and texts over the driver's tables, each with its SQL counterpart.

The tables hold plain words, so raw names and addresses are made from them by an expression that both
engines read alike. Codes, pasted lines and answers are small literal lists with known results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.functions import addresses as A, codes, names as N, narrative
from siltworks.functions.text import natural_key
from siltworks.operators import pasted
from siltworks.session import table

from .marts import query

RAW = """CASE p_partkey % 9 WHEN 0 THEN upper(p_name) || ' ROOFING,  L.L.C.' WHEN 1 THEN 'The ' || p_name || ' & Sons Inc.' WHEN 2 THEN '1234567 - ' || p_name || ' Co'
 WHEN 3 THEN p_name || ' d/b/a Quick ' || p_type WHEN 4 THEN 'A. B. ' || p_name || ' Builders (TX)' WHEN 5 THEN p_name || ' Corp, Ltd.' WHEN 6 THEN 'UNKNOWN ' || p_brand
 WHEN 7 THEN p_name || ' of Texas' ELSE 'J V ' || p_name || ' and Joint Venture 12' END"""
ADDRESS = """CASE p_partkey % 7 WHEN 0 THEN p_partkey || ' North ' || p_name || ' Street, Suite ' || p_size WHEN 1 THEN 'P.O. Box ' || p_partkey WHEN 2 THEN p_partkey || 'B NE ' || p_name || ' Avenue'
 WHEN 3 THEN p_name || ' Road' WHEN 4 THEN p_partkey || ' WESTPARK DRIVE' WHEN 5 THEN p_partkey || ' N West ' || p_name || ' Hwy Unit #' || p_size ELSE '' END"""
ZIP = "CASE p_partkey % 5 WHEN 0 THEN '00000' WHEN 1 THEN CAST(1000 + p_partkey % 9000 AS VARCHAR(9)) WHEN 2 THEN CAST(10000 + p_partkey AS VARCHAR(9)) || '-1234' WHEN 3 THEN ' x' ELSE NULL END"


def _sub(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        rx = pattern.replace(r"\z", "$").replace("'", "''")
        to = to.replace("'", "''")
        for k in range(1, 5):
            to = to.replace(f"${k}", rf"\{k}")
        x = f"regexp_replace({x}, '{rx}', '{to}', 'g')"
    return x


_FORMS = "|".join(N.LEGAL_FORMS)


def sql_steps(x: str) -> list[str]:
    """DuckDB expressions for the name after each step; each reads the one before as ``s<k>``."""
    out = [f"trim({_sub(f'upper({x})', (r'[ \t\n\f\r]+', ' '))})"]
    out.append(_sub("s0", (r"^[A-Z]{0,3}(?:[0-9]{5,}\s*-\s*|[0-9]{3,}\s+-\s+)", "")))
    out.append(_sub("s1", ("['’‘`´ʼ.]", "")))
    out.append(_sub("s2", (N.DBA_MARKERS, "$1 DBA ")))
    out.append(_sub("s3", (r"\(\s*JV\s*\)\s*$", " JV"), (rf"\s*\((?:{'|'.join(N.STATES)}|[A-Z]{{2}})\)\s*$", "")))
    out.append(f"trim({_sub('s4', ('[^A-Z0-9 ]', ' '), (r'\bAND\b', ' '), (r'\s+', ' '))})")
    out.append(_sub("s5", (r"^THE\s+", ""), (r"\s+THE$", "")))
    out.append(_sub("s6", (r"\bP L L C\b", "PLLC"), (r"\bL L C\b", "LLC"), (r"\bL L P\b", "LLP"), (r"(^|[A-Z0-9]{2,} )([LG]) P\b", "$1$2P")))
    out.append(f"coalesce(nullif(trim({_sub('s7', (r'\s+DBA$', ''), (rf'(?:\s+(?:{_FORMS}))+\s+DBA\b', ' DBA'), (rf'(?:\s+(?:THE|{_FORMS}))+\s*$', ''))}), ''), s7)")
    marked = "array_to_string(list_transform(string_split(s8, ' '), lambda t: CASE WHEN regexp_full_match(t, '[A-Z]') THEN '<' || t || '>' ELSE t END), ' ')"
    out.append(_sub(f"replace(replace(replace({marked}, '> <', ''), '<', ''), '>', '')", (r"(^| )([A-Z]) ([0-9]{1,3})( |$)", "$1$2$3$4")))
    return out


def sql_cleaned(source: str, keep: str, raw: str) -> str:
    """CTEs that end in ``cleaned(keep, raw, clean, s0 ... s9)``."""
    ctes = [f"c_ AS (SELECT {keep}, {raw} AS raw FROM {source})"]
    before = "c_"
    for k, x in enumerate(sql_steps("raw")):
        ctes.append(f"c{k}_ AS (SELECT *, {x} AS s{k} FROM {before})")
        before = f"c{k}_"
    ctes.append(f"cleaned AS (SELECT *, trim(regexp_replace(s9, '\\s+', ' ', 'g')) AS clean FROM {before})")
    return ", ".join(ctes)


_CLEAN = "WITH " + sql_cleaned("part", "p_partkey, p_name", RAW)
_LEGAL = "trim(split_part(clean, ' DBA ', 1))"
_GENERIC = ", ".join(f"'{w}'" for w in N.GENERIC)
_CORE = f"coalesce(array_to_string(list_filter(string_split({_LEGAL}, ' '), lambda t: t <> '' AND t NOT IN ({_GENERIC})), ' '), '')"


def cleaned_parts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct raw names are cleaned once and joined back."""
    raw = table(spark, d, "part").select("p_partkey", "p_name", F.expr(RAW).alias("raw"))
    known = raw.select("raw").distinct().withColumn("clean", N.clean_name("raw"))
    return raw.join(known, "raw")


@query(_CLEAN + " SELECT p_partkey, s1, s3, s5, s8, clean FROM cleaned")
def clean_name_steps(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "part").select("p_partkey", F.expr(RAW).alias("raw")).withColumn("s0", N.upper_ascii("raw"))
    for k, step in enumerate(N.STEPS, 1):
        raw = raw.withColumn(f"s{k}", step(F.col(f"s{k - 1}")))
    from siltworks.functions.text import squeeze

    return raw.select("p_partkey", "s1", "s3", "s5", "s8", squeeze(F.col("s9")).alias("clean"))


@query(_CLEAN + f""" SELECT p_partkey, {_LEGAL} AS legal, CASE WHEN strpos(clean, ' DBA ') > 0 THEN nullif(trim(split_part(clean, ' DBA ', 2)), '') END AS dba, {_CORE} AS core,
 regexp_full_match({_CORE}, '[A-Z]{{1,3}}( [A-Z]{{1,3}})*') AS initials, regexp_matches(clean, '\\b(JV|JOINT VENTURE)\\b') AS jv, nullif(regexp_extract(clean, '\\s(OF|AT)\\s+([A-Z0-9 ]+)$', 0), '') AS suffix FROM cleaned""")
def name_core_and_flags(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("clean")
    return cleaned_parts(spark, d).select("p_partkey", N.legal_part(c).alias("legal"), N.trade_part(c).alias("dba"), N.name_core(c).alias("core"), N.initials_only(c).alias("initials"), N.is_joint_venture(c).alias("jv"), N.place_suffix(c).alias("suffix"))


@query(_CLEAN + """ SELECT p_partkey, clean = '' OR regexp_matches(clean, '\\b(UNKNOWN|UNKOWN|UNKNWN|UNIDENTIFIED)\\b') OR clean IN ('NONE', 'TBD', 'TEST', 'OWNER', 'UNK') AS placeholder FROM cleaned""")
def placeholder_filter(spark: SparkSession, d: str) -> DataFrame:
    return cleaned_parts(spark, d).select("p_partkey", N.is_placeholder(F.col("clean")).alias("placeholder"))


def _sql_address(x: str) -> str:
    out = _sub(f"upper({x})", ("[^A-Z0-9 ]", " "), (r"\s+", " "), *((rf"\b{a}\b", b) for a, b in A.ABBREVIATIONS), (r"\s+", " "))
    return f"trim({out})"


_HOUSE = A.HOUSE.replace("'", "''")


@query(f"""
WITH a AS (SELECT p_partkey, {ADDRESS} AS raw, {ZIP} AS z FROM part), c AS (SELECT *, {_sql_address('raw')} AS clean FROM a), s AS (SELECT *, {_sub('clean', (A.JOINED_DIRECTION, '$1$2 $3'))} AS split FROM c)
SELECT p_partkey, clean, CASE WHEN regexp_matches(clean, '\\bPO BOX\\s+[0-9]+') THEN 'POBOX ' || regexp_extract(clean, '\\bPO BOX\\s+([0-9]+)', 1)
  WHEN regexp_matches(clean, '^[0-9]+[A-Z]?\\s+') THEN regexp_extract(split, '{_HOUSE}', 1) || ' ' || regexp_extract(split, '{_HOUSE}', 2) END AS addr_key,
  nullif(regexp_extract(upper(raw), '\\b(STE|SUITE|UNIT|APT|FL|FLOOR|RM|ROOM|BLDG|#)\\s*#?\\s*([A-Z0-9-]+)\\s*$', 0), '') AS unit, md5(coalesce(clean, '') || '|' || coalesce(z, '')) AS k FROM s
""")
def address_key(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select("p_partkey", F.expr(ADDRESS).alias("raw"), F.expr(ZIP).alias("z"))
    a = a.withColumn("clean", A.clean_address("raw"))
    return a.select("p_partkey", "clean", A.address_key("raw").alias("addr_key"), A.address_unit("raw").alias("unit"), F.md5(F.concat_ws("|", "clean", F.coalesce("z", F.lit("")))).alias("k"))


@query(f"""
WITH z AS (SELECT p_partkey, trim(coalesce({ZIP}, '')) AS z FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(z, '^[0-9]{{5}}') AND substr(z, 1, 5) <> '00000' THEN substr(z, 1, 5) WHEN regexp_full_match(z, '[0-9]{{4}}') THEN '0' || z END AS zip5 FROM z
""")
def zip5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", A.zip5(F.expr(ZIP)).alias("zip5"))


GIVEN, SURNAMES = ("JOHN", "MARY", "ANNA"), ("SMITH", "LEE")
_WORD = "upper(split_part(p_name, ' ', 1))"
CORE = f"""CASE p_partkey % 9 WHEN 0 THEN 'JOHN ' || {_WORD} WHEN 1 THEN {_WORD} || ' MARY' WHEN 2 THEN {_WORD} || ' ANNA ' || chr(CAST(65 + p_partkey % 26 AS INT)) WHEN 3 THEN 'SAN JOHN' WHEN 4 THEN chr(CAST(65 + p_partkey % 26 AS INT)) || ' SMITH'
 WHEN 5 THEN chr(CAST(65 + p_partkey % 26 AS INT)) || ' ' || {_WORD} WHEN 6 THEN 'MARY ' || {_WORD} || ' LEE ' || p_partkey WHEN 7 THEN 'JOHN A B ' || {_WORD} || ' C' ELSE upper(p_name) END"""
_list = lambda words: ", ".join(f"'{w}'" for w in words)


@query(f"""WITH c AS (SELECT p_partkey, {CORE} AS core FROM part), w AS (SELECT *, string_split(core, ' ') AS w FROM c)
SELECT p_partkey, core, len(w) BETWEEN 2 AND 4 AND regexp_full_match(core, '[A-Z]+( [A-Z]+)*') AND (w[1] IN ({_list(GIVEN)}) OR (len(w) = 2 AND length(w[1]) = 1 AND w[2] IN ({_list(SURNAMES)}))
 OR (w[1] NOT IN ({_list(N.PLACE_PREFIXES)}) AND w[2] IN ({_list(GIVEN)}) AND (len(w) = 2 OR (len(w) = 3 AND length(w[3]) = 1)))) AS person FROM w""")
def person_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(CORE).alias("core")).withColumn("person", N.is_person(F.col("core"), GIVEN, SURNAMES))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey AS VARCHAR) AS k, lpad(CAST(p_size AS VARCHAR), 12, '0') || '.' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS natural FROM part")
def natural_sort_key(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("k"))
    return p.withColumn("natural", natural_key(F.col("k")))


_text = lambda x: f"CAST({x} AS STRING)"
_pad = lambda x, n: f"lpad(CAST({x} AS STRING), {n}, '0')"
_N, _K, _LETTER = "p_size", "p_partkey", "chr(CAST(65 + p_size % 8 AS INT))"
#: ways of writing a code made from a part's numbers: raw code and state, then family, key and citation as they must come out
WRITTEN = [
    (f"'1926' || {_pad(f'{_K} % 1500', 4)} || ' ' || {_LETTER} || {_pad(_N, 2)}", "''", "'federal_1926'", f"'1926.' || {_text(f'{_K} % 1500')}", f"'(' || lower({_LETTER}) || ')(' || {_text(_N)} || ')'"),
    (f"'1910' || {_pad(f'{_K} % 1300', 4)} || ' ' || {_LETTER} || {_pad(_N, 2)} || ' II B'", "'TX'", "'federal_1910'", f"'1910.' || {_text(f'{_K} % 1300')}", f"'(' || lower({_LETTER}) || ')(' || {_text(_N)} || ')(ii)(B)'"),
    (f"'296-' || {_text(f'100 + {_K} % 700')} || '-' || {_text(f'10000 + {_K}')} || '(' || {_pad(_N, 2)} || ')(' || {_LETTER} || ')'", "'WA'", "'state_WA'", f"'WAC 296-' || {_text(f'100 + {_K} % 700')} || '-' || {_text(f'10000 + {_K}')}", f"'(' || {_text(_N)} || ')(' || lower({_LETTER}) || ')'"),
    (f"{_pad(f'24 + {_K} % 90', 3)} || {_pad(f'1000 + {_K}', 5)} || {_pad(_N, 2)}", "'WA'", "'state_WA'", f"'WAC 296-' || {_text(f'24 + {_K} % 90')} || '-' || {_pad(f'1000 + {_K}', 5)}", f"'(' || {_text(_N)} || ')'"),
    (f"'OAR 437-' || {_pad(f'{_K} % 8', 3)} || '-' || {_pad(f'{_K} % 10000', 4)} || '(' || {_pad(_N, 2)} || ')(' || {_LETTER} || ')'", "'OR'", "'state_OR'", f"'OAR 437-' || {_pad(f'{_K} % 8', 3)} || '-' || {_pad(f'{_K} % 10000', 4)}", f"'(' || {_text(_N)} || ')(' || lower({_LETTER}) || ')'"),
    (f"'70' || {_text(f'{_K} % 8')} || {_pad(f'{_K} % 10000', 4)} || {_pad(_N, 2)} || ' ' || {_LETTER}", "'OR'", "'state_OR'", f"'OAR 437-00' || {_text(f'{_K} % 8')} || '-' || {_pad(f'{_K} % 10000', 4)}", f"'(' || {_text(_N)} || ')(' || lower({_LETTER}) || ')'"),
    (f"'408' || {_text(f'10000 + {_K} % 80000')} || {_pad(_N, 2)}", "'MI'", "'state_MI'", f"'R 408.' || {_text(f'10000 + {_K} % 80000')}", f"'(' || {_text(_N)} || ')'"),
    (f"'4080' || {_pad(f'1000 + {_K} % 9000', 4)} || {_pad(_N, 2)} || {_LETTER}", "'MI'", "'state_MI'", f"'MCL 408.' || {_pad(f'1000 + {_K} % 9000', 4)}", f"'(' || {_text(_N)} || ')(' || lower({_LETTER}) || ')'"),
    (f"{_text(f'3000 + {_K} % 2000')} || '(' || {_LETTER} || ')(' || {_pad(_N, 2)} || ')'", "'CA'", "'state_CA'", f"'T8 CCR ' || {_text(f'3000 + {_K} % 2000')}", f"'(' || lower({_LETTER}) || ')(' || {_text(_N)} || ')'"),
    (f"{_text(f'1500 + {_K} % 400')} || {_pad(_N, 4)} || ' ' || {_LETTER}", "'CA'", "'state_CA'", f"'T8 CCR ' || {_text(f'1500 + {_K} % 400')} || '.' || {_text(_N)}", f"'(' || lower({_LETTER}) || ')'"),
    (f"{_text(_K)} || ' ' || {_LETTER} || ' ' || {_text(_N)}", "'PR'", "'state_other'", f"'PR ' || {_text(_K)}", f"' ' || {_LETTER} || ' ' || {_text(_N)}"),
]
_written = lambda k: f"CASE {_K} % {len(WRITTEN)} " + " ".join(f"WHEN {i} THEN {w[k]}" for i, w in enumerate(WRITTEN)) + " END"


@query(f"SELECT p_partkey, code, state, std_family, section_key, section_key || tail AS standard_cite FROM (SELECT p_partkey, {', '.join(f'{_written(k)} AS {c}' for k, c in enumerate(('code', 'state', 'std_family', 'section_key', 'tail')))} FROM part)".replace("STRING", "VARCHAR"))
def standard_parse(spark: SparkSession, d: str) -> DataFrame:
    """Codes written from known parts in each way, read back. The SQL never parses: it writes what must come out."""
    df = table(spark, d, "part").select("p_partkey", F.expr(_written(0)).alias("code"), F.expr(_written(1)).alias("state"))
    return df.withColumn("p", codes.parse("code", "state")).select("p_partkey", "code", "state", "p.*")


_TAIL = "CASE (conv_id + turn) % 5 WHEN 0 THEN ' The employee later died.' WHEN 1 THEN ' The engine died.' WHEN 2 THEN ' She died of a heart attack' WHEN 3 THEN ' Diedrich drill' ELSE ' He succumbed' END"


@query(r"""
SELECT conv_id, turn, length(said) AS n_chars, regexp_matches(said, '(?i)((employee|worker|victim|\bhe|\bshe)( later| subsequently| eventually)? (died|was killed|succumbed|passed away)\b)|(\b(later|subsequently|eventually) died\b)')
  AND NOT regexp_matches(said, '(?i)(\b(battery|engine|motor) (had )?died\b|heart attack)') AS death
FROM (SELECT conv_id, turn, coalesce(text, '') || """ + _TAIL + """ AS said FROM conversations)
""")
def narrative_death(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, each with an ending that does or doesn't tell of a death."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.expr(_TAIL)).alias("said"))
    return c.select("conv_id", "turn", F.length("said").cast("long").alias("n_chars"), narrative.reports_death("said").alias("death"))


_NAMED = lambda salt: f"substr(translate(md5(CAST(conv_id * 10 + {salt} AS STRING)), '0123456789', 'ghijklmnop'), 1, 7)"
_FORM = "(conv_id + turn) % 9"
#: a line in each way of writing, then the name, city and state that it has to give and which lines are one
PASTES = [
    ("'# note ' || CAST(turn AS STRING)", None, None, None, None), ("'Name, City, State'", None, None, None, None), ("''", None, None, None, None),
    (f"{_NAMED(1)} || ' Roofing, LLC, Dallas TX'", f"{_NAMED(1)} || ' Roofing, LLC'", "'Dallas'", "'TX'", 1), (f"upper({_NAMED(1)}) || ' Roofing LLC' || chr(9) || ' Dallas' || chr(9) || 'Texas'", f"upper({_NAMED(1)}) || ' Roofing LLC'", "'Dallas'", "'TX'", 1),
    (f"{_NAMED(2)} || ' & Sons, Portland, OR'", f"{_NAMED(2)} || ' & Sons'", "'Portland'", "'OR'", 2), (f"{_NAMED(2)} || ' and sons, Salem, Oregon'", f"{_NAMED(2)} || ' and sons'", "'Salem'", "'OR'", 2),
    (f"{_NAMED(3)} || ' Builders'", f"{_NAMED(3)} || ' Builders'", "NULL", "NULL", 3), (f"{_NAMED(4)} || ' Co, Austin, tx'", f"{_NAMED(4)} || ' Co'", "'Austin'", "'TX'", 4),
]
_pasted = lambda k: f"CASE {_FORM} " + " ".join(f"WHEN {i} THEN {w[k] if w[k] is not None else 'NULL'}" for i, w in enumerate(PASTES)) + " END"


@query(f"""WITH l AS (SELECT conv_id AS paste_id, turn AS line_no, {_pasted(1)} AS name, {_pasted(2)} AS city, {_pasted(3)} AS state, {_pasted(4)} AS same FROM conversations),
f AS (SELECT * FROM l WHERE same IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paste_id, same ORDER BY line_no) = 1)
SELECT paste_id, line_no, name, city, state FROM f""".replace("STRING", "VARCHAR"))
def paste_parse(spark: SparkSession, d: str) -> DataFrame:
    """Lists as people paste them, one a conversation, a line a turn. The SQL never parses: it gives what was written."""
    c = table(spark, d, "conversations")
    return pasted.parse_pasted(c.select(F.col("conv_id").alias("paste_id"), F.col("turn").alias("line_no"), F.expr(_pasted(0)).alias("line")))


@query(_CLEAN + " SELECT count(DISTINCT raw) AS raw, count(DISTINCT s0) AS upper_ascii, count(DISTINCT s1) AS numbers, count(DISTINCT s5) AS words, count(DISTINCT s8) AS forms, count(DISTINCT clean) AS clean FROM cleaned")
def distinct_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many names are left apart after each step, in one pass over distinct raw names."""
    df = table(spark, d, "part").select(F.expr(RAW).alias("raw")).distinct().withColumn("s0", N.upper_ascii("raw"))
    for k, step in enumerate(N.STEPS, 1):
        df = df.withColumn(f"s{k}", step(F.col(f"s{k - 1}")))
    n = F.countDistinct
    return df.agg(n("raw").alias("raw"), n("s0").alias("upper_ascii"), n("s1").alias("numbers"), n("s5").alias("words"), n("s8").alias("forms"), n(F.trim("s9")).alias("clean"))
