"""One query for each operator over the driver's tables, and the same in DuckDB SQL."""

import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions import tables as T
from .functions import text as X
from .functions import values as V
from .operators import resolve as R
from .operators.components import written
from .operators.identity import resolve_identities
from .operators.normalise import EDUCATION, EXPERIENCE, LOCATION, normalise_claims, normalise_hints
from .plans import pipeline
from .plans.projection import canonical_json
from .plans.validation import validate, validate_or_raise
from .sources import claims as C
from .sources import delimited, detect, foreign_json, notes, profiles, resumes
from .sources.files import dealt, extension, overrides

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has any."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(mapping: dict, names: str) -> str:
    """A SQL relation of a mapping."""
    q = lambda x: "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in mapping.items()) + f") {names}"


# ------------------------------------------------------------------ tokens in text
EMAIL_SQL = r"(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}"
PHONE_SQL = r"\+?[0-9][0-9\-.\s()]{7,}[0-9]"
EMAILS_SQL = rf"""SELECT <id>, array_to_string(x, '|') AS emails, len(x) AS n FROM (SELECT <id>, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i) AS x
    FROM (SELECT *, regexp_extract_all(<text>, '{EMAIL_SQL}') AS e FROM <table>)) WHERE len(x) > 0"""
PHONES_SQL = rf"""SELECT doc_id, list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i) AS p FROM (
    SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{PHONE_SQL}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
        lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 7 AND 15) AS p FROM documents)"""


@query(EMAILS_SQL.replace("<id>", "doc_id").replace("<text>", "text").replace("<table>", "documents"))
def extract_emails(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", C.emails_in(F.col("text"), P.EMAIL).alias("x"))
    return found.where("size(x) > 0").select("doc_id", F.array_join("x", "|").alias("emails"), F.size("x").cast("long").alias("n"))


@query(EMAILS_SQL.replace("<id>", "page_id").replace("<text>", "html").replace("<table>", "pages"))
def extract_emails_pages(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", C.emails_in(F.col("html"), P.EMAIL).alias("x"))
    return found.where("size(x) > 0").select("page_id", F.array_join("x", "|").alias("emails"), F.size("x").cast("long").alias("n"))


@query(f"SELECT doc_id, array_to_string(p, '|') AS phones, len(p) AS n FROM ({PHONES_SQL}) WHERE len(p) > 0")
def extract_phones(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", C.phones_in(F.col("text"), P.PHONE).alias("x"))
    return found.where("size(x) > 0").select("doc_id", F.array_join("x", "|").alias("phones"), F.size("x").cast("long").alias("n"))


@query(r"""WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents),
n AS (SELECT doc_id, token, regexp_replace(lower(regexp_replace('<' || token || '>', '^\s+|\s+$', '', 'g')), '^[<>]+|[<>]+$', '', 'g') AS x FROM t WHERE contains(token, '@'))
SELECT doc_id, token, CASE WHEN regexp_full_match(x, '[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}') THEN x END AS email FROM n""")
def normalize_email(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token")).where(F.col("token").contains("@"))
    return tokens.select("doc_id", "token", V.email(F.concat(F.lit("<"), "token", F.lit(">"))).alias("email"))


@query(rf"""WITH t AS (SELECT doc_id, unnest(p) AS token FROM ({PHONES_SQL})),
n AS (SELECT doc_id, token, regexp_replace(token, '[^0-9+]', '', 'g') AS x FROM t), b AS (SELECT *, regexp_replace(x, '^\++', '') AS d FROM n)
SELECT doc_id, token, CASE WHEN x LIKE '+%' THEN CASE WHEN regexp_full_match(d, '[0-9]{{8,15}}') THEN '+' || d END
  WHEN regexp_full_match(d, '[0-9]{{10}}') THEN '+1' || d WHEN regexp_full_match(d, '1[0-9]{{10}}') THEN '+' || d END AS phone FROM b""")
def normalize_phone(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(C.phones_in(F.col("text"), P.PHONE)).alias("token"))
    return tokens.select("doc_id", "token", V.phone(F.col("token")).alias("phone"))


# ------------------------------------------------------------------ source types
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
DETECT_SQL = rf"""WITH f AS (SELECT 'd' || doc_id AS id, substr(text, 1, 8192) AS head FROM documents UNION ALL SELECT 'p' || page_id, substr(html, 1, 8192) FROM pages),
g AS (SELECT *, list_filter(list_transform(regexp_split_to_array(head, '{BREAKS}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM f)
SELECT id, CASE WHEN regexp_replace(head, '\s+', '', 'g') = '' THEN 'recruiter_notes'
  WHEN len(lines) > 0 AND len(list_filter(lines, lambda x: regexp_matches(x, '(?i)https?://(www\.)?github\.com/'))) >= greatest(1, len(lines) // 2) THEN 'github'
  WHEN {" + ".join(f"regexp_matches(lower(head), '(?m)^\\s*{w}\\b')::INT" for w in T.RESUME_WORDS)} >= 2 THEN 'resume' ELSE 'recruiter_notes' END AS source_type FROM g"""


@query(DETECT_SQL)
def detect_source_type(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit(".txt").alias("ext"), F.col("text").alias("content"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id"), F.lit(".html"), "html")
    return docs.union(pages).select("id", detect.source_type(F.col("ext"), F.col("content")).alias("source_type"))


JSON_HEADS = [
    '{"login": "u#", "name": "x"}',
    '{"html_url": "h#", "followers": 3}',
    '{"html_url": "h#"}',
    '[{"PUBLIC_REPOS": #}, {"a": 1}]',
    '{"candidates": [{"login": "u#"}]}',
    '{"login": "u#", "public_repos": 3, "cut',
    '{"login": "u#", "cut',
    "[]",
]


@query("SELECT c_custkey, CASE WHEN c_custkey % 8 IN (0, 1, 3, 5) THEN 'github' ELSE 'ats_json' END AS source_type FROM customer")
def detect_json_kind(spark, sf_dir):
    forms = F.array(*map(F.lit, JSON_HEADS))
    content = F.replace(F.get(forms, (F.col("c_custkey") % 8).cast("int")), F.lit("#"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", detect.source_type(F.lit(".json"), content).alias("source_type"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.pdf' WHEN 2 THEN '' WHEN 3 THEN '.md' WHEN 4 THEN '.gz' ELSE '' END AS ext FROM part")
def file_extension(spark, sf_dir):
    names = F.array(*map(F.lit, ["a/b.c/x.CSV", "x.pdf", "a.b/readme", "a/y.md", "z.tar.gz", "a/.hidden"]))
    return table(spark, sf_dir, "part").select("p_partkey", extension(F.get(names, (F.col("p_partkey") % 6).cast("int"))).alias("ext"))


# ------------------------------------------------------------------ scalar functions
CAPITAL = "upper(substr({w}, 1, 1)) || lower(substr({w}, 2))"
NAME_SQL = f"""CASE WHEN x = '' OR regexp_matches(x, '[0-9]') THEN NULL ELSE array_to_string(list_transform(string_split(x, ' '), lambda w:
  CASE WHEN lower(w) IN ({", ".join(repr(p) for p in T.PARTICLES)}) THEN lower(w) WHEN contains(w, '-') THEN array_to_string(list_transform(string_split(w, '-'), lambda v: {CAPITAL.format(w="v")}), '-') ELSE {CAPITAL.format(w="w")} END), ' ') END"""
NAMES_SQL = r"""(SELECT 'p' || p_partkey AS id, '  ' || p_name || ' van  ' || lower(p_type) || '-' || p_brand[1:5] || '. ' AS raw FROM part
  UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, ',' || r_name || ',' FROM region)"""


@query(f"SELECT id, {NAME_SQL} AS name FROM (SELECT id, regexp_replace(regexp_replace(trim(raw), '\\s+', ' ', 'g'), '^[.,]+|[.,]+$', '', 'g') AS x FROM {NAMES_SQL})")
def normalize_name(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("  "), "p_name", F.lit(" van  "), F.lower("p_type"), F.lit("-"), F.substring("p_brand", 1, 5), F.lit(". ")).alias("raw"))
    rest = [table(spark, sf_dir, t).select(F.concat(F.lit(t[0]), k), n) for t, k, n in (("customer", "c_custkey", F.col("c_name")), ("nation", "n_nationkey", F.col("n_name")), ("region", "r_regionkey", F.concat(F.lit(","), "r_name", F.lit(","))))]
    out = parts
    for r in rest:
        out = out.union(r)
    return out.select("id", V.name(F.col("raw")).alias("name"))


COUNTRY_SQL = "CASE WHEN len({k}) = 2 AND upper({k}) IN (SELECT DISTINCT code FROM countries) THEN upper({k}) ELSE (SELECT code FROM countries WHERE name = {k}) END"
COUNTRIES_SQL = f"countries AS (SELECT * FROM {values(T.COUNTRIES, 'c(name, code)')})"


@query(f"WITH {COUNTRIES_SQL}, d AS (SELECT doc_id, lang, regexp_replace(lower(trim(lang || '. ')), '\\.+$', '') AS k FROM documents) SELECT doc_id, {COUNTRY_SQL.format(k='k')} AS country FROM d")
def normalize_country(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.country(F.concat("lang", F.lit(". "))).alias("country"))


PLACES = ["london", " new york,NY , USA", "Paris, texas", "Singapore", "somewhere  else, upper austria, Austria", ",,", "x, de", "berlin, , u.k."]


@query(
    f"""WITH p AS (SELECT * FROM (VALUES (0, 'London', NULL, 'GB'), (1, 'New York', 'NY', 'US'), (2, 'Paris', 'Texas', 'FR'), (3, NULL, NULL, 'SG'), (4, 'Somewhere Else', 'Upper Austria', 'AT'),
  (5, NULL, NULL, NULL), (6, 'X', NULL, 'DE'), (7, 'Berlin', 'U.k.', 'DE')) v(k, city, region, country)),
  q AS (SELECT c_custkey, c_custkey % {len(PLACES)} AS k FROM customer) SELECT c_custkey, city, region, country FROM q JOIN p USING (k)"""
)
def parse_location(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, PLACES)), (F.col("c_custkey") % len(PLACES)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", V.location(raw).alias("l")).select("c_custkey", "l.*")


DATE_FORMS = ["yyyy-MM", "M/yyyy", "MMM yyyy", "yyyy MMMM", "yyyy", "yyyy-MM-dd", "MMMM, yyyy"]


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN strftime(o_orderdate, '%Y-01') WHEN 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month,
  CAST(year(o_orderdate) AS INTEGER) AS end_year FROM orders""")
def normalize_date(spark, sf_dir):
    forms = F.array(*[F.date_format("o_orderdate", f) for f in DATE_FORMS])
    raw = F.get(forms, (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.date(raw).alias("month"), V.end_year(raw).alias("end_year"))


SKILLS_RAW_SQL = f"""(SELECT 'p' || p_partkey AS id, lower(p_type) || '; ' AS raw FROM part UNION ALL SELECT 'b' || p_partkey, p_brand FROM part UNION ALL SELECT 'e' || event_id, event_type || '  ' || event_type FROM events
  UNION ALL SELECT 'c' || c_custkey, ' ' || upper(alias) || '.' FROM customer JOIN (SELECT alias, row_number() OVER (ORDER BY alias) - 1 AS i FROM {values(T.skill_aliases(), 's(alias, name)')}) ON i = c_custkey % {len(T.skill_aliases())})"""


@query(f"""WITH s AS (SELECT * FROM {values(T.skill_aliases(), 's(alias, name)')}), r AS (SELECT id, trim(regexp_replace(regexp_replace(trim(raw), '^[.,;/]+|[.,;/]+$', '', 'g'), '\\s+', ' ', 'g')) AS x FROM {SKILLS_RAW_SQL})
SELECT id, coalesce(s.name, CASE WHEN x = upper(x) AND x <> lower(x) THEN x ELSE array_to_string(list_transform(string_split(x, ' '), lambda w: {CAPITAL.format(w='w')}), ' ') END) AS skill, s.name IS NOT NULL AS canonical
FROM r LEFT JOIN s ON s.alias = lower(x) WHERE x <> '' AND len(x) <= 40""")
def canonicalize_skill(spark, sf_dir):
    part, events, customer = (table(spark, sf_dir, t) for t in ("part", "events", "customer"))
    aliases = sorted(T.skill_aliases())
    alias = F.get(F.array(*map(F.lit, aliases)), (F.col("c_custkey") % len(aliases)).cast("int"))
    raw = part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lower("p_type"), F.lit("; ")).alias("raw"))
    raw = raw.union(part.select(F.concat(F.lit("b"), "p_partkey"), "p_brand")).union(events.select(F.concat(F.lit("e"), "event_id"), F.concat("event_type", F.lit("  "), "event_type")))
    raw = raw.union(customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit(" "), F.upper(alias), F.lit("."))))
    return raw.select("id", V.skill(F.col("raw")).alias("s")).where("s IS NOT NULL").select("id", F.col("s.name").alias("skill"), F.col("s.canonical").alias("canonical"))


@query("SELECT p_partkey, CASE WHEN y BETWEEN 0 AND 70 THEN y END AS years FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5 WHEN p_partkey % 3 = 1 THEN p_size * 2.0 END::DOUBLE AS y FROM part)")
def normalize_years(spark, sf_dir):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("~"), "p_size", F.lit(".5+ yrs"))).when(k == 1, (F.col("p_size") * 2).cast("string")).otherwise("many years")
    return table(spark, sf_dir, "part").select("p_partkey", V.years(raw).alias("years"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || user_id END AS github, CASE WHEN event_id % 3 = 2 THEN 'in-' || user_id END AS linkedin,
  CASE event_id % 4 WHEN 0 THEN 'https://x.io/u' || user_id WHEN 1 THEN 'http://x.io' WHEN 2 THEN 'https://HTTP://x' END AS url FROM events""")
def profile_handles(spark, sf_dir):
    k, m = F.col("event_id") % 3, F.col("event_id") % 4
    address = F.when(k == 0, F.concat(F.lit("see HTTPS://GitHub.com/U"), "user_id", F.lit("/repo"))).when(k == 1, F.lit("github.com/settings")).otherwise(F.concat(F.lit("www.linkedin.com/in/IN-"), "user_id", F.lit("?x")))
    url = F.when(m == 0, F.concat(F.lit(" x.io/u"), "user_id", F.lit("// "))).when(m == 1, F.lit("http://x.io/")).when(m == 2, F.lit("HTTP://x")).otherwise(F.lit(" "))
    return table(spark, sf_dir, "events").select("event_id", V.github_handle(address).alias("github"), V.linkedin_handle(address).alias("linkedin"), V.url(url).alias("url"))


@query("SELECT c_custkey, c_name || '|' || c_mktsegment || '|x' AS parts, 3::BIGINT AS n FROM customer")
def split_values(spark, sf_dir):
    found = delimited.split_values(F.concat(F.lit(" ; "), "c_name", F.lit("|,"), "c_mktsegment", F.lit(" ;x,,")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(found, "|").alias("parts"), F.size(found).cast("long").alias("n"))


TRUST_SQL = "(VALUES " + ", ".join(f"('{s}', '{f}', {round(v * 100)})" for s, t in T.TRUST.items() for f, v in t.items()) + ") trust(s, f, v)"
ORDER_FIELDS = {"1-URGENT": "full_name", "2-HIGH": "links.github", "3-MEDIUM": "skills", "4-NOT SPECIFIED": "education", "5-LOW": "phones"}
ORDER_TYPES = {"O": "ats_json", "F": "recruiter_csv", "P": "github"}
METHODS = [*T.CERTAINTY, "other"]


@query(f"""WITH trust AS (SELECT * FROM {TRUST_SQL}), m AS (SELECT * FROM {values({k: round(T.CERTAINTY.get(k, 0.6) * 100) for k in METHODS}, 'm(method, c)')}),
n AS (SELECT method, c, row_number() OVER () - 1 AS i FROM m), o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 7 THEN 'fax' ELSE t.s END AS s, f.f, (o_orderkey % {len(METHODS)}) AS i
  FROM orders JOIN {values(ORDER_TYPES, 't(k, s)')} ON t.k = o_orderstatus JOIN {values(ORDER_FIELDS, 'f(k, f)')} ON f.k = o_orderpriority)
SELECT o_orderkey, CAST(coalesce(a.v, b.v, 50) * n.c AS INTEGER) AS base_bp FROM o JOIN n USING (i) LEFT JOIN trust a ON a.s = o.s AND a.f = split_part(o.f, '.', 1) LEFT JOIN trust b ON b.s = o.s AND b.f = '_default'""")
def base_confidence(spark, sf_dir):
    method = F.get(F.array(*map(F.lit, METHODS)), (F.col("o_orderkey") % len(METHODS)).cast("int"))
    kind = F.when(F.col("o_orderkey") % 10 == 7, "fax").otherwise(T.lookup(ORDER_TYPES, F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.base_confidence(kind, T.lookup(ORDER_FIELDS, F.col("o_orderpriority")), method).alias("base_bp"))


# ------------------------------------------------------------------ resolution
TYPES = [*T.PRIORITY, "fax"]


def claim(df: DataFrame, component: Column, order: Column, field: Column, kind: Column, method: Column, **value: Column) -> DataFrame:
    """Normalised claims as the resolver takes them."""
    kinds = {"v_text": "string", "v_canonical": "boolean", "v_number": "double", "v_place": LOCATION, "v_job": EXPERIENCE, "v_school": EDUCATION}
    return df.select(
        component.cast("string").alias("component"), F.lpad(order.cast("string"), 12, "0").alias("record_id"), F.lit(0).alias("claim_idx"), field.alias("field"),
        F.concat(kind, F.lit(":x")).alias("source"), kind.alias("source_type"), method.alias("method"), T.base_confidence(kind, field, method).alias("base_bp"),
        *[value.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()],
    )


def type_at(c: Column) -> Column:
    return F.get(F.array(*map(F.lit, TYPES)), (c % len(TYPES)).cast("int"))


def points_sql(field: str, method: str) -> str:
    return "CASE t " + " ".join(f"WHEN '{s}' THEN {T.base_points(s, field, method)}" for s in TYPES) + " END"


RANK_SQL = "CASE t " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(TYPES)) + " END"
TYPE_SQL = "[" + ", ".join(f"'{t}'" for t in TYPES) + f"][({{k}} % {len(TYPES)}) + 1]"
ROUND_SQL = "CAST(printf('%.4f', {x}) AS DOUBLE)"
SURE_SQL = f"least(0.99::DOUBLE, bp / 10000.0::DOUBLE + {T.AGREEMENT_BP / 10000}::DOUBLE * (types - 1))"


@query(f"""WITH c AS (SELECT o_custkey AS person, o_orderkey AS id, lower(o_orderpriority) AS k, o_orderpriority AS value, {TYPE_SQL.format(k='o_orderkey')} AS t FROM orders),
b AS (SELECT *, {points_sql('headline', 'resume_section')} AS bp, {RANK_SQL} AS rank FROM c),
g AS (SELECT person, k, max(bp) AS bp, count(DISTINCT t) AS types, arg_min({{'value': value, 't': t, 'rank': rank}}, (-bp, rank, id)) AS top FROM b GROUP BY ALL),
s AS (SELECT *, bp + 500 * (types - 1) AS score FROM g), w AS (SELECT *, row_number() OVER p AS rn, lead(score) OVER p AS rival FROM s WINDOW p AS (PARTITION BY person ORDER BY score DESC, top.rank, top.value))
SELECT CAST(person AS VARCHAR) AS component, top.value AS headline, top.t || ':x' AS source, {ROUND_SQL.format(x=f'CASE WHEN score - rival < 800 THEN {SURE_SQL} * 0.85::DOUBLE ELSE {SURE_SQL} END')} AS confidence FROM w WHERE rn = 1""")
def resolve_scalar(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    made = claim(orders, F.col("o_custkey"), F.col("o_orderkey"), F.lit("headline"), type_at(F.col("o_orderkey")), F.lit("resume_section"), v_text=F.col("o_orderpriority"))
    return R.profiles(made).select("component", "headline", F.get("provenance", F.lit(0))["source"].alias("source"), F.col("field_confidence")["headline"].alias("confidence"))


LIST_SQL = f"""c AS (SELECT user_id AS person, event_id AS id, event_type || (event_id % 7) AS value, {TYPE_SQL.format(k='(event_id + user_id)')} AS t FROM events),
b AS (SELECT *, {{points}} AS bp FROM c), g AS (SELECT person, value, max(bp) AS bp, count(DISTINCT t) AS types, arg_min(t, (-bp, id)) AS t, list_sort(list(DISTINCT t)) AS ts FROM b GROUP BY ALL),
s AS (SELECT *, least(9900, bp + 500 * (types - 1)) AS conf FROM g)"""


@query(f"""WITH {LIST_SQL.format(points=points_sql('phones', 'regex_phone'))}
SELECT CAST(person AS VARCHAR) AS component, string_agg(value, '|' ORDER BY conf DESC, value) AS phones, {ROUND_SQL.format(x='max(conf) / 10000.0::DOUBLE')} AS confidence, count(DISTINCT t) AS n_sources FROM s GROUP BY person""")
def resolve_list(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    value = F.concat("event_type", (F.col("event_id") % 7).cast("string"))
    made = claim(events, F.col("user_id"), F.col("event_id"), F.lit("phones"), type_at(F.col("event_id") + F.col("user_id")), F.lit("regex_phone"), v_text=value)
    return R.profiles(made).select("component", F.array_join("phones", "|").alias("phones"), F.col("field_confidence")["phones"].alias("confidence"), F.size("provenance").cast("long").alias("n_sources"))


@query(f"""WITH {LIST_SQL.format(points=points_sql('skills', 'resume_section'))}, o AS (SELECT person, count(DISTINCT t) AS n FROM c GROUP BY person)
SELECT CAST(person AS VARCHAR) AS component, string_agg(value || '=' || printf('%.4f', conf / 10000.0::DOUBLE) || '=' || array_to_string(ts, '+'), '|' ORDER BY conf DESC, value) AS skills, any_value(n) AS n_sources FROM s JOIN o USING (person) GROUP BY person""")
def resolve_skills(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    value = F.concat("event_type", (F.col("event_id") % 7).cast("string"))
    made = claim(events, F.col("user_id"), F.col("event_id"), F.lit("skills"), type_at(F.col("event_id") + F.col("user_id")), F.lit("resume_section"), v_text=value)
    say = F.transform("skills", lambda s: F.concat_ws("=", s["name"], F.format_number(s["confidence"], 4), F.array_join(s["sources"], "+")))
    return R.profiles(made).select("component", F.array_join(say, "|").alias("skills"), F.size("provenance").cast("long").alias("n_sources"))


@query(f"""WITH c AS (SELECT c_nationkey AS person, c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS city, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS region, CASE WHEN c_custkey % 2 = 0 THEN 'US' END AS country, {TYPE_SQL.format(k='c_custkey')} AS t FROM customer),
b AS (SELECT *, {points_sql('location', 'github_api')} AS bp FROM c)
SELECT CAST(person AS VARCHAR) AS component, arg_min(city, (-bp, id)) FILTER (city IS NOT NULL) AS city, arg_min(region, (-bp, id)) FILTER (region IS NOT NULL) AS region, arg_min(country, (-bp, id)) FILTER (country IS NOT NULL) AS country,
  {ROUND_SQL.format(x="max(bp) FILTER (coalesce(city, region, country) IS NOT NULL) / 10000.0::DOUBLE")} AS confidence FROM b GROUP BY person HAVING count(coalesce(city, region, country)) > 0""")
def resolve_location(spark, sf_dir):
    k = F.col("c_custkey")
    place = F.struct(F.when(k % 3 > 0, F.col("c_mktsegment")).alias("city"), F.when(k % 5 == 0, F.col("c_name")).alias("region"), F.when(k % 2 == 0, "US").alias("country"))
    made = claim(table(spark, sf_dir, "customer"), F.col("c_nationkey"), k, F.lit("location"), type_at(k), F.lit("github_api"), v_place=place)
    return R.profiles(made).select("component", "location.*", F.col("field_confidence")["location"].alias("confidence"))


@query(f"""WITH c AS (SELECT c_nationkey AS person, c_custkey AS id, ['linkedin', 'github', 'portfolio'][c_custkey % 3 + 1] AS kind, 'https://x.io/' || c_custkey AS url, {TYPE_SQL.format(k='c_custkey // 3')} AS t FROM customer),
b AS (SELECT *, {points_sql('links', 'resume_regex')} AS bp FROM c)
SELECT CAST(person AS VARCHAR) AS component, arg_min(url, (-bp, id)) FILTER (kind = 'linkedin') AS linkedin, arg_min(url, (-bp, id)) FILTER (kind = 'github') AS github, arg_min(url, (-bp, id)) FILTER (kind = 'portfolio') AS portfolio,
  {ROUND_SQL.format(x='max(bp) / 10000.0::DOUBLE')} AS confidence FROM b GROUP BY person""")
def resolve_links(spark, sf_dir):
    k = F.col("c_custkey")
    field = F.get(F.array(*[F.lit(f"links.{x}") for x in R.LINKS]), (k % 3).cast("int"))
    made = claim(table(spark, sf_dir, "customer"), F.col("c_nationkey"), k, field, type_at(F.floor(k / 3)), F.lit("resume_regex"), v_text=F.concat(F.lit("https://x.io/"), k))
    return R.profiles(made).select("component", "links.linkedin", "links.github", "links.portfolio", F.col("field_confidence")["links"].alias("confidence"))


@query(f"""WITH c AS (SELECT l_suppkey AS person, l_orderkey * 10 + l_linenumber AS id, 'Co-' || (l_partkey % 5) AS company, CASE WHEN l_partkey % 3 > 0 THEN l_returnflag END AS title,
  CASE WHEN l_quantity > 20 THEN strftime(l_shipdate, '%Y-%m') END AS s, CASE WHEN l_quantity > 40 THEN strftime(l_shipdate, '%Y-12') WHEN l_quantity > 30 THEN 'present' END AS e, CASE WHEN l_quantity < 10 THEN l_linestatus END AS summary, {TYPE_SQL.format(k='l_orderkey')} AS t FROM lineitem),
b AS (SELECT *, {points_sql('experience', 'resume_section')} AS bp, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS ck, coalesce(lower(title), '') AS tk FROM c),
g AS (SELECT person, ck, tk, min((-bp, id)) AS ord, arg_min(company, (-bp, id)) AS company, arg_min(title, (-bp, id)) FILTER (title IS NOT NULL) AS title, arg_min(s, (-bp, id)) FILTER (s IS NOT NULL) AS s, arg_min(e, (-bp, id)) FILTER (e IS NOT NULL) AS e,
  arg_min(summary, (-bp, id)) FILTER (summary IS NOT NULL) AS summary, max(bp) AS bp FROM b GROUP BY person, ck, tk),
k AS (SELECT * FROM g a WHERE title IS NOT NULL OR s IS NOT NULL OR NOT EXISTS (SELECT 1 FROM g d WHERE d.person = a.person AND d.ck = a.ck AND (d.title IS NOT NULL OR d.s IS NOT NULL)))
SELECT CAST(person AS VARCHAR) AS component, string_agg(concat_ws('~', company, coalesce(title, '-'), coalesce(s, '-'), coalesce(e, '-'), coalesce(summary, '-')), '|' ORDER BY coalesce(e <> 'present', true) DESC, coalesce(s, '') DESC, company DESC, ord) AS jobs,
  (SELECT {ROUND_SQL.format(x='max(g.bp) / 10000.0::DOUBLE')} FROM g WHERE g.person = k.person) AS confidence FROM k GROUP BY person""")
def resolve_experience(spark, sf_dir):
    q, ship = F.col("l_quantity"), F.col("l_shipdate")
    job = F.struct(
        F.concat(F.lit("Co-"), (F.col("l_partkey") % 5).cast("string")).alias("company"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_returnflag")).alias("title"), F.when(q > 20, F.date_format(ship, "yyyy-MM")).alias("start"),
        F.when(q > 40, F.date_format(ship, "yyyy-12")).when(q > 30, "present").alias("end"), F.when(q < 10, F.col("l_linestatus")).alias("summary"),
    )
    made = claim(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.lit("experience"), type_at(F.col("l_orderkey")), F.lit("resume_section"), v_job=job)
    say = F.transform("experience", lambda j: F.concat_ws("~", j["company"], *[F.coalesce(j[f], F.lit("-")) for f in ("title", "start", "end", "summary")]))
    return R.profiles(made).select("component", F.array_join(say, "|").alias("jobs"), F.col("field_confidence")["experience"].alias("confidence"))


@query(f"""WITH c AS (SELECT l_suppkey AS person, l_orderkey * 10 + l_linenumber AS id, 'Uni ' || (l_partkey % 4) AS institution, CASE WHEN l_partkey % 3 > 0 THEN l_returnflag END AS degree, CASE WHEN l_quantity > 45 THEN CAST(year(l_shipdate) AS INT) END AS y, CASE WHEN l_quantity < 10 THEN l_linestatus END AS f, {TYPE_SQL.format(k='l_orderkey')} AS t FROM lineitem),
b AS (SELECT *, {points_sql('education', 'resume_section')} AS bp, lower(institution) AS ik, coalesce(lower(degree), '') AS dk FROM c),
g AS (SELECT person, ik, dk, min((-bp, id)) AS ord, arg_min(institution, (-bp, id)) AS institution, arg_min(degree, (-bp, id)) FILTER (degree IS NOT NULL) AS degree, arg_min(f, (-bp, id)) FILTER (f IS NOT NULL) AS f, arg_min(y, (-bp, id)) FILTER (y IS NOT NULL) AS y FROM b GROUP BY person, ik, dk)
SELECT CAST(person AS VARCHAR) AS component, string_agg(concat_ws('~', institution, coalesce(degree, '-'), coalesce(f, '-'), coalesce(CAST(y AS VARCHAR), '-')), '|' ORDER BY coalesce(y, 0) DESC, ord) AS schools FROM g GROUP BY person""")
def resolve_education(spark, sf_dir):
    q = F.col("l_quantity")
    school = F.struct(
        F.concat(F.lit("Uni "), (F.col("l_partkey") % 4).cast("string")).alias("institution"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_returnflag")).alias("degree"),
        F.when(q < 10, F.col("l_linestatus")).alias("field"), F.when(q > 45, F.year("l_shipdate")).alias("end_year"),
    )
    made = claim(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.lit("education"), type_at(F.col("l_orderkey")), F.lit("resume_section"), v_school=school)
    say = F.transform("education", lambda s: F.concat_ws("~", s["institution"], *[F.coalesce(s[f].cast("string"), F.lit("-")) for f in ("degree", "field", "end_year")]))
    return R.profiles(made).select("component", F.array_join(say, "|").alias("schools"))


HINTS_SQL = """h AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 < 3 THEN 'email:m' || (c_custkey // 4) || '@x.io' END AS e, CASE WHEN c_custkey % 7 = 0 THEN 'github:g' || (c_custkey // 20) END AS g, CASE WHEN c_custkey % 11 = 0 THEN 'linkedin:l' || (c_custkey // 30) END AS l,
  'name:' || c_mktsegment || c_nationkey AS n FROM customer),
k AS (SELECT id, e AS key FROM h WHERE e IS NOT NULL UNION SELECT id, g FROM h WHERE g IS NOT NULL UNION SELECT id, l FROM h WHERE l IS NOT NULL UNION SELECT id, n FROM h WHERE coalesce(e, g, l) IS NULL),
p AS (SELECT id, min(id) OVER (PARTITION BY key) AS root FROM k), x AS (SELECT id AS a, root AS b FROM p UNION SELECT root, id FROM p)"""


@query(f"WITH RECURSIVE {HINTS_SQL}, r(a, b) AS (SELECT a, b FROM x UNION SELECT r.a, x.b FROM r JOIN x ON x.a = r.b) SELECT id AS c_custkey, CAST(min(coalesce(b, id)) AS BIGINT) AS component FROM h LEFT JOIN r ON r.a = h.id GROUP BY id")
def identity_components(spark, sf_dir):
    k = F.col("c_custkey")
    hints = table(spark, sf_dir, "customer").select(
        F.lpad(k.cast("string"), 12, "0").alias("record_id"),
        F.when(k % 5 < 3, F.array(F.concat(F.lit("m"), F.floor(k / 4).cast("string"), F.lit("@x.io")))).otherwise(F.array().cast("array<string>")).alias("emails"),
        F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"),
        F.when(k % 7 == 0, F.concat(F.lit("g"), F.floor(k / 20).cast("string"))).alias("github"),
        F.when(k % 11 == 0, F.concat(F.lit("l"), F.floor(k / 30).cast("string"))).alias("linkedin"),
    )
    return resolve_identities(hints).select(F.col("record_id").cast("long").alias("c_custkey"), F.col("component").cast("long").alias("component"))


@query("SELECT c_custkey, 'cand_' || substr(sha1(lower(CASE c_custkey % 3 WHEN 0 THEN 'A' || c_custkey || '@x.io' WHEN 1 THEN c_name ELSE '' END)), 1, 12) AS candidate_id FROM customer")
def candidate_id(spark, sf_dir):
    k = F.col("c_custkey")
    emails = F.when(k % 3 == 0, F.array(F.concat(F.lit("A"), k, F.lit("@x.io")), F.lit("z@x.io"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select("c_custkey", V.candidate_id(emails, F.when(k % 3 == 1, F.col("c_name"))).alias("candidate_id"))


# ------------------------------------------------------------------ profiles, projection, validation
def people(spark, sf_dir) -> DataFrame:
    """A profile for each customer: a name, e-mail addresses for some, a headline for some, and years."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    one = lambda field, kind, method, **v: claim(c, F.lpad(k.cast("string"), 8, "0"), k, F.lit(field), F.lit(kind), F.lit(method), **v)
    made = one("full_name", "ats_json", "ats_field_map", v_text=F.initcap("c_mktsegment"))
    made = made.union(one("emails", "resume", "regex_email", v_text=F.concat(F.lit("m"), k, F.lit("@x.io"))).where((F.col("record_id").cast("long") % 3) > 0))
    made = made.union(one("headline", "recruiter_csv", "csv_column", v_text=F.concat(F.lit("Made \"by\" é "), "c_name")).where((F.col("record_id").cast("long") % 2) > 0))
    return R.profiles(made.union(one("years_experience", "recruiter_notes", "regex_freetext", v_number=(k % 40) / 2)))


BP = {f: T.base_points(s, f, m) / 10000 for f, s, m in (("full_name", "ats_json", "ats_field_map"), ("emails", "resume", "regex_email"), ("headline", "recruiter_csv", "csv_column"), ("years_experience", "recruiter_notes", "regex_freetext"))}
PEOPLE_SQL = f"""p AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS component, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS full_name, CASE WHEN c_custkey % 3 > 0 THEN 'm' || c_custkey || '@x.io' END AS email,
  CASE WHEN c_custkey % 2 > 0 THEN 'Made "by" é ' || c_name END AS headline, (c_custkey % 40) / 2.0::DOUBLE AS years,
  CAST(printf('%.4f', ({BP['full_name']}::DOUBLE * 3.0 + CASE WHEN c_custkey % 2 > 0 THEN {BP['headline']}::DOUBLE * 1.0 ELSE 0.0 END + {BP['years_experience']}::DOUBLE * 0.5 + CASE WHEN c_custkey % 3 > 0 THEN {BP['emails']}::DOUBLE * 3.0 ELSE 0.0 END)
    / (3.5 + CASE WHEN c_custkey % 2 > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN c_custkey % 3 > 0 THEN 3.0 ELSE 0.0 END)) AS DOUBLE) AS overall FROM customer),
q AS (SELECT *, 'cand_' || substr(sha1(lower(coalesce(email, full_name))), 1, 12) AS candidate_id, CASE WHEN years = floor(years) THEN CAST(CAST(years AS BIGINT) AS VARCHAR) ELSE CAST(years AS VARCHAR) END AS y, replace(headline, '"', '\\"') AS h FROM p)"""


@query(f"WITH {PEOPLE_SQL} SELECT component, candidate_id, overall AS overall_confidence FROM q")
def overall_confidence(spark, sf_dir):
    return people(spark, sf_dir).select("component", "candidate_id", "overall_confidence")


@query(f"""WITH {PEOPLE_SQL} SELECT component, '{{"candidate_id":"' || candidate_id || '","full_name":"' || full_name || '","emails":' || CASE WHEN email IS NULL THEN 'null' ELSE '["' || email || '"]' END || ',"phones":null,"location":{{"city":null,"region":null,"country":null}},'
  || '"links":{{"linkedin":null,"github":null,"portfolio":null,"other":[]}},"headline":' || coalesce('"' || h || '"', 'null') || ',"years_experience":' || y || ',"skills":null,"experience":null,"education":null}}' AS output_json, 0::BIGINT AS n_errors FROM q""")
def project_default(spark, sf_dir):
    return validate(people(spark, sf_dir), {}).select("component", "output_json", F.size("validation_errors").cast("long").alias("n_errors"))


OMIT = {
    "on_missing": "omit", "include_confidence": True, "include_provenance": True,
    "fields": [{"path": "id", "from": "candidate_id", "type": "string", "required": True}, {"path": "mail", "from": "emails[0]", "type": "string", "normalize": "upper"}, {"path": "what", "from": "headline", "type": "integer"}, {"path": "phone", "from": "phones[0]", "required": True}, {"path": "skills", "from": "skills[].name", "type": "string[]"}],
}


@query(f"""WITH {PEOPLE_SQL} SELECT component, '{{"id":"' || candidate_id || '"' || coalesce(',"mail":"' || upper(email) || '"', '') || coalesce(',"what":"' || h || '"', '') || ',"phone":null,"overall_confidence":' || overall || ',"field_confidence":{{'
  || concat_ws(',', CASE WHEN email IS NOT NULL THEN '"mail":{BP['emails']}' END, CASE WHEN headline IS NOT NULL THEN '"what":{BP['headline']}' END) || '}},"provenance":['
  || concat_ws(',', CASE WHEN email IS NOT NULL THEN '{{"field":"emails","source":"resume:x","method":"regex_email"}}' END, CASE WHEN headline IS NOT NULL THEN '{{"field":"headline","source":"recruiter_csv:x","method":"csv_column"}}' END) || ']}}' AS output_json,
  concat_ws('; ', CASE WHEN headline IS NOT NULL THEN 'field ''what'' should be integer but is str' END, 'required field ''phone'' is null') AS errors FROM q""")
def project_omit(spark, sf_dir):
    return validate(people(spark, sf_dir), OMIT).select("component", "output_json", F.array_join("validation_errors", "; ").alias("errors"))


ERROR = {"on_missing": "error", "fields": [{"path": "mail", "from": "emails[0]"}, {"path": "headline", "normalize": "title"}, {"path": "years", "from": "years_experience", "type": "integer"}]}


@query(f"""WITH {PEOPLE_SQL}, e AS (SELECT *, concat_ws('; ', CASE WHEN email IS NULL THEN 'missing value for ''mail'' (from ''emails[0]'')' END, CASE WHEN headline IS NULL THEN 'missing value for ''headline'' (from ''headline'')' END) AS err FROM q)
SELECT component, CASE WHEN err = '' THEN '{{"mail":"' || email || '","headline":"Made \\"By\\" É ' || substr(h, 15) || '","years":' || y || '}}' END AS output_json,
  CASE WHEN err <> '' THEN 'projection error: ' || err WHEN years <> floor(years) THEN 'field ''years'' should be integer but is float' ELSE '' END AS errors FROM e""")
def project_error(spark, sf_dir):
    return validate(people(spark, sf_dir), ERROR).select("component", "output_json", F.array_join("validation_errors", "; ").alias("errors"))


CHECKED = {"fields": [{"path": "full_name", "type": "string", "required": True}, {"path": "emails", "type": "number[]"}, {"path": "location", "type": "string"}, {"path": "gone", "required": True}, {"path": "years_experience", "type": "boolean"}, {"path": "links", "type": "unknown"}]}


@query(f"""WITH {PEOPLE_SQL} SELECT component, concat_ws('; ', CASE WHEN email IS NOT NULL THEN 'field ''emails[0]'' violates element type ''number''' END, 'field ''location'' should be string but is dict', 'required field ''gone'' is null',
  'field ''years_experience'' should be boolean but is ' || CASE WHEN years = floor(years) THEN 'int' ELSE 'float' END) AS errors FROM q""")
def validate_output(spark, sf_dir):
    return validate(people(spark, sf_dir), CHECKED).select("component", F.array_join("validation_errors", "; ").alias("errors"))


# ------------------------------------------------------------------ sources
def named(df: DataFrame, path: Column, content: Column, ext: str) -> DataFrame:
    return df.select(path.alias("path"), F.lit(ext).alias("ext"), content.cast("binary").alias("raw"), content.alias("content"))


def claim_text(records: DataFrame) -> DataFrame:
    """Records as one line each, for comparison."""
    job = F.transform("claims", lambda c: F.when(c["job"].isNotNull(), F.concat(F.lit("experience="), F.concat_ws("~", *[F.coalesce(c["job"][f], F.lit("-")) for f in R.JOB_FIELDS]))))
    school = F.transform("claims", lambda c: F.when(c["school"].isNotNull(), F.concat(F.lit("education="), F.concat_ws("~", *[F.coalesce(c["school"][f], F.lit("-")) for f in R.SCHOOL_FIELDS]))))
    text = F.transform("claims", lambda c: F.when(c["text"].isNotNull(), F.concat(c["field"], F.lit("="), c["text"])))
    line = F.array_join(F.zip_with(F.zip_with(text, job, lambda a, b: F.coalesce(a, b)), school, lambda a, b: F.coalesce(a, b)), "|")
    return records.select("path", "rec_idx", line.alias("claims"), F.array_join("hint_emails", "|").alias("hint_emails"), "hint_name", "hint_github", "hint_linkedin")


@query("""WITH c AS (SELECT *, c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT 'nation/' || n AS path, CAST(i AS INTEGER) AS rec_idx, 'full_name=' || c_name || '|emails=m' || c_custkey || '@x.io|emails=z@x.io' || CASE WHEN c_custkey % 2 = 0 THEN '|headline=' || c_mktsegment ELSE '' END || '|experience=A, Inc.~' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END || '~-~present~-' AS claims,
  'm' || c_custkey || '@x.io|z@x.io' AS hint_emails, c_name AS hint_name, NULL::VARCHAR AS hint_github, NULL::VARCHAR AS hint_linkedin FROM c""")
def extract_csv(spark, sf_dir):
    k = F.col("c_custkey")
    row = F.concat(F.lit(" "), "c_name", F.lit(" ,m"), k, F.lit('@x.io; z@x.io,"A, Inc.",'), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.lit(",extra"))
    files = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("row")))).alias("rows"))
    content = F.concat(F.lit("﻿ Candidate ,E-Mail,EMPLOYER,Role\n\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\r\n"))
    return claim_text(delimited.extract_delimited(named(files, F.concat(F.lit("nation/"), "c_nationkey"), content, ".csv")))


def foreign_documents(spark, sf_dir) -> DataFrame:
    """A JSON document for each customer, every fifth one broken."""
    k = F.col("c_custkey").cast("string")
    job = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('[{"org": "", "company": "Co", "role": "'), "c_mktsegment", F.lit('", "start": "2019-01"}, 7]'))).otherwise("[]")
    content = F.concat(
        F.lit('{"results": ["skip", {"name": "'), "c_name", F.lit('", "contact": {"email_address": "", "phone": "+1'), k, F.lit('"}, "email": ["m'), k, F.lit('@x.io", "z@x.io"], "yoe": '), (F.col("c_custkey") % 9).cast("string"),
        F.lit(', "location": {"city": "Rome", "country": "IT"}, "github": "github.com/U'), k, F.lit('", "skills": [{"tag": "js"}, "Go", {"x": 1}], "history": '), job,
        F.lit(', "schools": [{"school": "Uni", "degree": "BSc", "grad": '), (2000 + F.col("c_custkey") % 20).cast("string"), F.when(F.col("c_custkey") % 5 > 0, F.lit("}]}]}")).otherwise("}"),
    )
    return named(dealt(table(spark, sf_dir, "customer"), k), F.concat(F.lit("c/"), k), content, ".json")


@query("""WITH c AS (SELECT *, c_custkey AS k FROM customer)
SELECT 'c/' || k AS path, CAST(1 AS INTEGER) AS rec_idx, 'full_name=' || c_name || '|emails=m' || k || '@x.io|emails=z@x.io|phones=+1' || k || '|years_experience=' || (k % 9) || '|location=Rome, IT|links.github=github.com/U' || k || '|skills=js|skills=Go'
  || CASE WHEN k % 2 = 0 THEN '|experience=Co~' || c_mktsegment || '~2019-01~-~-' ELSE '' END || '|education=Uni~BSc~-~' || (2000 + k % 20) AS claims, 'm' || k || '@x.io|z@x.io' AS hint_emails, c_name AS hint_name, 'u' || k AS hint_github, NULL::VARCHAR AS hint_linkedin FROM c WHERE k % 5 > 0""")
def extract_foreign_json(spark, sf_dir):
    return claim_text(foreign_json.extract_json(foreign_documents(spark, sf_dir)))


def foreign_points(field: str) -> int:
    return T.base_points("ats_json", field, "ats_field_map")


@query(f"""WITH c AS (SELECT *, c_custkey AS k FROM customer WHERE c_custkey % 5 > 0), v AS (
  SELECT k, 1 AS claim_idx, 'emails' AS field, {foreign_points('emails')} AS base_bp, 'm' || k || '@x.io' AS value FROM c UNION ALL SELECT k, 2, 'emails', {foreign_points('emails')}, 'z@x.io' FROM c
  UNION ALL SELECT k, 4, 'years_experience', {foreign_points('years_experience')}, CAST(k % 9 AS VARCHAR) FROM c UNION ALL SELECT k, 5, 'location', {foreign_points('location')}, 'Rome~-~IT' FROM c
  UNION ALL SELECT k, 6, 'links.github', {foreign_points('links.github')}, 'https://github.com/U' || k FROM c UNION ALL SELECT k, 7, 'skills', {foreign_points('skills')}, 'JavaScript' FROM c UNION ALL SELECT k, 8, 'skills', {foreign_points('skills')}, 'Go' FROM c
  UNION ALL SELECT k, 9, 'experience', {foreign_points('experience')}, 'Co~' || c_mktsegment || '~2019-01~present~-' FROM c WHERE k % 2 = 0
  UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN 10 ELSE 9 END, 'education', {foreign_points('education')}, 'Uni~BSc~-~' || (2000 + k % 20) FROM c)
SELECT 'ats_json:c/' || k AS source, claim_idx, field, base_bp, value FROM v""")
def normalize_claims(spark, sf_dir):
    made = normalise_claims(written(foreign_json.extract_json(foreign_documents(spark, sf_dir))), F.lit(2100))
    joined = lambda c, fields: F.when(F.col(c).isNotNull(), F.concat_ws("~", *[F.coalesce(F.col(f"{c}.{f}").cast("string"), F.lit("-")) for f in fields]))
    value = F.coalesce("v_text", R.number_text(F.col("v_number")), joined("v_place", R.PARTS), joined("v_job", R.JOB_FIELDS), joined("v_school", R.SCHOOL_FIELDS))
    return made.select("source", "claim_idx", "field", "base_bp", value.alias("value"))


@query("SELECT 'c/' || c_custkey AS path, 'm' || c_custkey || '@x.io|z@x.io' AS emails, NULL::VARCHAR AS name, 'u' || c_custkey AS github FROM customer WHERE c_custkey % 5 > 0")
def normalize_hints(spark, sf_dir):
    made = normalise_hints(foreign_json.extract_json(foreign_documents(spark, sf_dir)))
    return made.select(F.substring_index("record_id", "\x00", 1).alias("path"), F.array_join("emails", "|").alias("emails"), "name", "github")


def mixed_files(spark, sf_dir) -> DataFrame:
    """A file for each customer: JSON, some of it broken, notes, some of them blank, and files of a type that is forced and unknown."""
    k = F.col("c_custkey")
    kind = F.when(k % 4 < 2, F.lit(".json")).when(k % 4 == 2, F.lit(".txt")).otherwise(F.lit(".x"))
    content = F.when(k % 8 == 0, '{"name": "cut').when(k % 4 < 2, F.concat(F.lit('{"email": "m'), k, F.lit('@x.io"}'))).when(k % 8 == 2, "  ").otherwise(F.concat(F.lit("mail n"), k, F.lit("@x.io")))
    files = dealt(table(spark, sf_dir, "customer"), k).select(F.concat(F.lit("f/"), F.lpad(k.cast("string"), 9, "0"), kind).alias("path"), content.cast("binary").alias("raw"), content.alias("content"), kind.alias("ext"))
    typed = detect.with_types(files)
    return typed.withColumn("source_type", F.when(F.col("ext") == ".x", "fax").otherwise(F.col("source_type")))


def mixed_run(spark, sf_dir) -> pipeline.Run:
    files = mixed_files(spark, sf_dir)
    none = spark.createDataFrame([], "validation_errors array<string>")
    return pipeline.Run(files, pipeline.extract(files), none, none)


@query("""SELECT path, CASE k % 4 WHEN 3 THEN 'skipped (unrecognized source type): ' || path WHEN 2 THEN 'no candidates extracted from ' || path || ' (recruiter_notes)' ELSE 'no candidates extracted from ' || path || ' (ats_json)' END AS warning
FROM (SELECT c_custkey AS k, 'f/' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ['.json', '.json', '.txt', '.x'][c_custkey % 4 + 1] AS path FROM customer) WHERE k % 4 = 3 OR k % 8 IN (0, 2)""")
def run_warnings(spark, sf_dir):
    return mixed_run(spark, sf_dir).warning_rows()


@query("""SELECT CASE WHEN c_custkey % 4 < 2 THEN 'ats_json' ELSE 'recruiter_notes' END AS source_type, count(*) AS files, count(*) FILTER (c_custkey % 8 NOT IN (0, 2)) AS records FROM customer WHERE c_custkey % 4 < 3 GROUP BY 1""")
def run_stats(spark, sf_dir):
    return mixed_run(spark, sf_dir).source_counts()


@query("""SELECT count(*) AS input_files, count(*) FILTER (c_custkey % 4 < 3 AND c_custkey % 8 NOT IN (0, 2)) AS records_extracted, 0::BIGINT AS candidates, true AS all_valid FROM customer""")
def run_summary(spark, sf_dir):
    s = mixed_run(spark, sf_dir).stats()
    return spark.createDataFrame([tuple(s[k] for k in ("input_files", "records_extracted", "candidates", "all_valid"))], "input_files long, records_extracted long, candidates long, all_valid boolean")


@query("SELECT 'f/' || c_custkey AS path, CASE WHEN c_custkey BETWEEN 1 AND 40 THEN 'fax' ELSE 'recruiter_notes' END AS source_type FROM customer")
def forced_types(spark, sf_dir):
    files = named(table(spark, sf_dir, "customer"), F.concat(F.lit("f/"), F.col("c_custkey")), F.lit("plain words"), ".txt")
    return detect.with_types(files, overrides([f"./f/{k}=fax" for k in range(1, 41)])).select("path", "source_type")


@query(f"""WITH {PEOPLE_SQL} SELECT component, '{{"full_name":"' || full_name || '"}}' AS output_json FROM q""")
def validated_profiles(spark, sf_dir):
    return validate_or_raise(people(spark, sf_dir), {"fields": [{"path": "full_name", "type": "string", "required": True}]}).select("component", "output_json")


@query("""SELECT 'c/' || c_custkey AS path, 0 AS rec_idx, 'emails=m' || c_custkey || '@x.io|phones=415) 555-26' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '|full_name=Ada Lovelace|headline=Staff Engineer at Acme|experience=Acme~Staff Engineer~-~present~-|years_experience=' || (c_custkey % 30)
  || '|skills=Python|skills=Go|location=Paris, FR|links.github=github.com/Ada' || c_custkey AS claims, 'm' || c_custkey || '@x.io' AS hint_emails, 'Ada Lovelace' AS hint_name, 'ada' || c_custkey AS hint_github, NULL::VARCHAR AS hint_linkedin FROM customer""")
def extract_note_files(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    content = F.concat(
        F.lit("Met with Ada Lovelace Met with Ada Lovelace.\n"), F.lit("met with Ada Lovelace, Staff Engineer at Acme, mail m"), k, F.lit("@x.io and M"), k, F.lit("@X.io, call (415) 555-26"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"),
        F.lit("\n~"), (F.col("c_custkey") % 30).cast("string"), F.lit(" years; strong in Python and Go.\nbased in Paris, FR. github.com/Ada"), k, F.lit(" "),
    )
    return claim_text(notes.extract_notes(named(dealt(table(spark, sf_dir, "customer"), k), F.concat(F.lit("c/"), k), content, ".txt")))


RESUMES_SQL = """SELECT 'c/' || c_custkey AS path, 0 AS rec_idx, 'full_name=Alan Turing|emails=m' || c_custkey || '@x.io|skills=Python|skills=Logic|skills=Go|experience=Acme Corp~Senior Engineer~2018-03~present~-|education=MIT~Ph.D~Mathematics~' || (1950 + c_custkey % 50) AS claims,
  'm' || c_custkey || '@x.io' AS hint_emails, 'Alan Turing' AS hint_name, NULL::VARCHAR AS hint_github, NULL::VARCHAR AS hint_linkedin FROM customer"""


def resume_text() -> Column:
    k = F.col("c_custkey").cast("string")
    return F.concat(
        F.lit("\n Alan Turing \nm"), k, F.lit("@x.io\nSKILLS:\nPython with Logic\n\nExperience\n• Acme Corp, Senior Engineer (2018-03 - present) did things\nnothing here\nTechnical Skills\nGo;\nEducation:\n- MIT, Ph.D in Mathematics, "),
        (1950 + F.col("c_custkey") % 50).cast("string"),
    )


@query(RESUMES_SQL)
def extract_resume_files(spark, sf_dir):
    k = F.col("c_custkey")
    return claim_text(resumes.extract_resumes(named(dealt(table(spark, sf_dir, "customer"), k), F.concat(F.lit("c/"), k), resume_text(), ".txt")))


def as_docx(batches):
    """The contents of Arrow batches of (path, ext, raw, content) as DOCX files, a paragraph for each line."""
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for batch in batches:
        made = []
        for text in batch.column(3).to_pylist():
            body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in text.split("\n"))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as archive:
                archive.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>')
            made.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary()), pa.array([""] * batch.num_rows, pa.string())], names=["path", "ext", "raw", "content"])


@query(RESUMES_SQL + " WHERE c_custkey % 10 = 0")
def extract_docx_files(spark, sf_dir):
    k = F.col("c_custkey")
    plain = named(dealt(table(spark, sf_dir, "customer").where("c_custkey % 10 = 0"), k), F.concat(F.lit("c/"), k), resume_text(), ".docx")
    return claim_text(resumes.extract_resumes(plain.mapInArrow(as_docx, plain.schema)))


@query("""SELECT 'd' || (c_custkey % 10) || '/list.txt' AS path, CAST(c_custkey // 10 AS INTEGER) AS rec_idx, 'full_name=' || c_name || '|links.github=https://github.com/U' || c_custkey || '|links.portfolio=https://x.io|skills=Go|experience=acme~-~-~present~-' AS claims,
  '' AS hint_emails, c_name AS hint_name, 'u' || c_custkey AS hint_github, NULL::VARCHAR AS hint_linkedin FROM customer WHERE c_custkey % 3 > 0""")
def extract_profile_lists(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    lists = c.groupBy((k % 10).alias("d")).agg(F.array_sort(F.collect_list(k)).alias("users"))
    lines = F.transform("users", lambda u: F.concat(F.lit("https://github.com/U"), u.cast("string"), F.lit("\nhttp://github.com/u"), u.cast("string"), F.lit("\ngithub.com/orgs")))
    files = lists.select(F.concat(F.lit("d"), "d", F.lit("/list.txt")).alias("path"), F.array_join(lines, "\n").alias("content"))
    profile = F.concat(F.lit('{"login": "U'), k, F.lit('", "name": "'), "c_name", F.lit('", "email": null, "bio": "", "blog": " x.io", "company": "@acme ", "_languages": ["Go"], "followers": 3}'))
    cache = dealt(c.where(k % 3 > 0), k).select(F.concat(F.lit("d"), k % 10, F.lit("/github_cache/U"), k, F.lit(".json")).alias("path"), profile.alias("content"))
    return claim_text(profiles.extract_profiles(files, cache))


@query("""SELECT conv_id, turn, upper(left(c, 1)) || lower(substr(c, 2)) AS role_title, CAST(len(string_split(t, ' ')) AS BIGINT) AS n_words FROM (SELECT conv_id, turn, role AS c, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) WHERE t <> ''""")
def clean_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("t", X.clean(F.col("text"))).where("t IS NOT NULL")
    return c.select("conv_id", "turn", X.title(F.col("role")).alias("role_title"), F.size(F.split("t", " ")).cast("long").alias("n_words"))


@query()
def pipeline_profiles(spark, sf_dir):
    """Documents as notes and conversations as notes of their own, from files to validated profiles."""
    docs = named(table(spark, sf_dir, "documents"), F.concat(F.lit("documents/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")), F.col("text"), ".txt")
    talk = named(table(spark, sf_dir, "conversations"), F.concat(F.lit("conversations/"), F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 6, "0")), F.col("text"), ".txt")
    records = notes.extract_notes(docs.union(talk))
    canonical = pipeline.consolidate(records)
    return validate(canonical, {}).select("candidate_id", "component", "output_json", "overall_confidence", canonical_json(canonical.schema).alias("canonical_json"))
