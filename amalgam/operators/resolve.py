"""From the claims of each person to one profile: agreement, conflict, order and provenance.

Claims meet twice: first by person, field and value, where the best claim and the
source types that agree are kept, then by person. Both are hash aggregations with a
partial step before their shuffle; what reaches a person's row is one entry for each
distinct value. Where equals compete, the first claim in record order wins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import values as V
from ..functions.text import let

SCALARS = ("full_name", "headline", "years_experience")
LISTS = ("emails", "phones")
LINKS = ("linkedin", "github", "portfolio")
PARTS = ("city", "region", "country")
JOB_FIELDS = ("company", "title", "start", "end", "summary")
SCHOOL_FIELDS = ("institution", "degree", "field", "end_year")


def round4(c: Column) -> Column:
    """Rounded to four decimals by the double's exact value, halves to even."""
    return F.replace(F.format_number(c, 4), F.lit(","), F.lit("")).cast("double")


def points(bp: Column) -> Column:
    return bp.cast("double") / F.lit(10000.0)


def number_text(c: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def agreed(bp: Column, types: Column) -> Column:
    """Basis points of a value that so many source types state, before the cap."""
    return bp + T.AGREEMENT_BP * (types - 1)


def value_keys(claims: DataFrame) -> DataFrame:
    """claims with key, by which values of a field meet, and place parts as claims of their own."""
    f = F.col("field")
    job, school = F.col("v_job"), F.col("v_school")
    parts = F.array(*[F.struct(F.lit(p).alias("key"), F.col(f"v_place.{p}").alias("v_text")) for p in PARTS])
    key = (
        F.when(f == "skills", F.col("v_text"))
        .when(f == "years_experience", number_text(F.col("v_number")))
        .when(f.startswith("links."), F.lit(""))
        .when(f == "experience", F.concat(V.company_key(job["company"]), F.lit("\x00"), V.text_key(job["title"])))
        .when(f == "education", F.concat(V.text_key(school["institution"]), F.lit("\x00"), V.text_key(school["degree"])))
        .otherwise(F.lower("v_text"))
    )
    each = F.when(f == "location", F.filter(parts, lambda p: F.coalesce(p["v_text"], F.lit("")) != "")).otherwise(F.array(F.struct(key.alias("key"), F.when(f == "years_experience", number_text(F.col("v_number"))).otherwise(F.col("v_text")).alias("v_text"))))
    return claims.withColumn("_p", F.explode(each)).select("*", F.col("_p.key").alias("key"), F.col("_p.v_text").alias("value")).drop("_p")


def entries(claims: DataFrame) -> DataFrame:
    """One row for each component, field and key: the best claim's value, source, method and points, the agreeing types, and merged job and school fields."""
    order = F.struct((-F.col("base_bp")).alias("a"), F.col("record_id").alias("b"), F.col("claim_idx").alias("c"))
    ranked = F.struct((-F.col("base_bp")).alias("a"), T.priority(F.col("source_type")).alias("p"), F.col("record_id").alias("b"), F.col("claim_idx").alias("c"))
    is_scalar = F.col("field").isin(*SCALARS)
    # one order for both: scalars also weigh the source type
    full = F.struct(ranked["a"].alias("a"), F.when(is_scalar, ranked["p"]).otherwise(0).alias("p"), ranked["b"].alias("b"), ranked["c"].alias("c"))
    best = F.struct("value", "source", "method", "source_type", "base_bp")

    def filled(column: str, fields: tuple[str, ...]) -> list[Column]:
        out = []
        for f in fields:
            v = F.col(f"{column}.{f}")
            there = v.isNotNull() & (v.cast("string") != "") & (v.cast("string") != "0")
            out.append(F.min_by(F.when(there, v), F.when(there, order)).alias(f"{column}_{f}"))
        return out

    return value_keys(claims).groupBy("component", "field", "key").agg(
        F.min_by(best, full).alias("best"),
        F.min(full).alias("best_order"),
        F.min(F.struct(F.col("record_id").alias("r"), F.col("claim_idx").alias("c"))).alias("first"),
        F.array_sort(F.collect_set("source_type")).alias("types"),
        F.collect_set(F.when(F.col("field") == "skills", F.struct("source", "method"))).alias("origins"),
        *filled("v_job", JOB_FIELDS),
        *filled("v_school", SCHOOL_FIELDS),
    )


def _by(xs: Column, *keys) -> Column:
    """xs sorted by keys, each (function, descending)."""

    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for key, down in reversed(keys):
            a, b = (key(y), key(x)) if down else (key(x), key(y))
            out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
        return out

    return F.array_sort(xs, compare)


def _origin(field: str, e: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), e["source"].alias("source"), e["method"].alias("method"))


def _best_origin(field: str):
    return lambda x: _origin(field, x["best"])


def profiles(claims: DataFrame) -> DataFrame:
    """The canonical profile of each component of (component, normalised claims).

    Columns: component, candidate_id, full_name, emails, phones, location, links,
    headline, years_experience, skills, experience, education, provenance,
    overall_confidence, field_confidence.
    """
    e = entries(claims)
    entry = F.struct("key", "best", "best_order", "first", "types", "origins")
    jobs = F.struct("best", "best_order", *[F.col(f"v_job_{f}").alias(f) for f in JOB_FIELDS])
    schools = F.struct("best", "best_order", *[F.col(f"v_school_{f}").alias(f) for f in SCHOOL_FIELDS])
    fields = [*SCALARS, *LISTS, "skills", "location", *[f"links.{x}" for x in LINKS]]
    gathered = e.groupBy("component").agg(
        *[F.collect_list(F.when(F.col("field") == f, entry)).alias(f.replace(".", "_")) for f in fields],
        F.collect_list(F.when(F.col("field") == "experience", jobs)).alias("jobs"),
        F.collect_list(F.when(F.col("field") == "education", schools)).alias("schools"),
    )
    score = lambda x: agreed(x["best"]["base_bp"], F.size(x["types"]))
    capped = lambda x: F.least(F.lit(T.CAP_BP), score(x))
    rank = lambda x: T.priority(x["best"]["source_type"])
    value = lambda x: x["best"]["value"]

    # stage 1: each family in its order
    ordered = gathered.select(
        "component",
        *[_by(F.col(f), (score, True), (rank, False), (value, False)).alias(f) for f in SCALARS],
        *[_by(F.col(f), (capped, True), (value, False)).alias(f) for f in LISTS],
        _by(F.col("skills"), (lambda x: x["first"], False)).alias("skills_seen"),
        _by(F.col("skills"), (capped, True), (lambda x: x["key"], False)).alias("skills"),
        _by(F.col("location"), (lambda x: x["best"]["base_bp"], True), (lambda x: x["first"], False), (lambda x: F.array_position(F.array(*map(F.lit, PARTS)), x["key"]), False)).alias("location"),
        *[F.get(F.col(f"links_{x}"), F.lit(0)).alias(f"links_{x}") for x in LINKS],
        _by(F.col("jobs"), (lambda x: x["best_order"], False)).alias("jobs"),
        _by(F.col("schools"), (lambda x: x["best_order"], False)).alias("schools"),
    )

    # stage 2: values, confidences and origins
    def scalar_confidence(f: str) -> Column:
        top, rival = F.get(F.col(f), F.lit(0)), F.get(F.col(f), F.lit(1))
        sure = F.least(F.lit(T.CAP_BP / 10000), points(top["best"]["base_bp"]) + F.lit(T.AGREEMENT_BP / 10000) * (F.size(top["types"]) - 1))
        close = rival.isNotNull() & (score(top) - score(rival) < T.CONFLICT_MARGIN_BP)
        return F.when(top.isNotNull(), round4(F.when(close, sure * F.lit(1 - T.CONFLICT_PENALTY)).otherwise(sure)))

    first = lambda f: F.get(F.col(f), F.lit(0))
    some = lambda c, v: F.when(F.size(c) > 0, v)
    best_job = F.get(F.col("jobs"), F.lit(0))["best"]
    best_school = F.get(F.col("schools"), F.lit(0))["best"]
    links = [F.col(f"links_{x}") for x in LINKS]
    top_link = F.greatest(*[x["best"]["base_bp"] for x in links])
    confidence = {f: scalar_confidence(f) for f in SCALARS}
    confidence |= {f: some(f, round4(points(capped(first(f))))) for f in (*LISTS, "skills")}
    confidence["location"] = some("location", round4(points(F.least(F.lit(T.CAP_BP), first("location")["best"]["base_bp"]))))
    confidence["links"] = F.when(top_link.isNotNull(), round4(points(F.least(F.lit(T.CAP_BP), top_link))))
    confidence["experience"] = some("jobs", round4(points(F.least(F.lit(T.CAP_BP), best_job["base_bp"]))))
    confidence["education"] = some("schools", round4(points(F.least(F.lit(T.CAP_BP), best_school["base_bp"]))))

    # stubs go where the same company has an entry with a title or a start
    told = lambda j: F.coalesce(j["title"], j["start"]).isNotNull()
    detailed = F.array_distinct(F.transform(F.filter("jobs", told), lambda j: V.company_key(j["company"])))
    kept_jobs = let(detailed, lambda companies: F.filter("jobs", lambda j: told(j) | ~F.array_contains(companies, V.company_key(j["company"]))))
    job_order = _by(kept_jobs, (lambda j: F.coalesce(j["end"] != "present", F.lit(True)), True), (lambda j: F.coalesce(j["start"], F.lit("")), True), (lambda j: F.coalesce(j["company"], F.lit("")), True))
    school_order = _by(F.col("schools"), (lambda s: F.coalesce(s["end_year"], F.lit(0)), True))

    origins = F.concat(
        *[F.transform(F.slice(F.col(f), 1, 1), _best_origin(f)) for f in SCALARS],
        *[F.transform(f, _best_origin(f)) for f in LISTS],
        F.transform(F.flatten(F.transform("skills_seen", lambda x: F.array_sort(x["origins"]))), lambda o: _origin("skills", o)),
        F.transform(F.slice("location", 1, 1), lambda x: _origin("location", x["best"])),
        F.array_compact(F.array(*[F.when(x.isNotNull(), _origin("links", x["best"])) for x in links])),
        F.transform(F.slice("jobs", 1, 1), lambda x: _origin("experience", x["best"])),
        F.transform(F.slice("schools", 1, 1), lambda x: _origin("education", x["best"])),
    )
    part = lambda p: F.get(F.filter("location", lambda x: x["key"] == p), F.lit(0))["best"]["value"]
    emails = F.transform("emails", value)
    name = first("full_name")["best"]["value"]
    resolved = ordered.select(
        "component",
        V.candidate_id(emails, name).alias("candidate_id"),
        name.alias("full_name"),
        emails.alias("emails"),
        F.transform("phones", value).alias("phones"),
        F.struct(*[part(p).alias(p) for p in PARTS]).alias("location"),
        F.struct(*[x["best"]["value"].alias(k) for k, x in zip(LINKS, links, strict=True)], F.array().cast("array<string>").alias("other")).alias("links"),
        first("headline")["best"]["value"].alias("headline"),
        first("years_experience")["best"]["value"].cast("double").alias("years_experience"),
        F.transform("skills", lambda x: F.struct(x["key"].alias("name"), round4(points(capped(x))).alias("confidence"), x["types"].alias("sources"))).alias("skills"),
        F.transform(job_order, lambda j: F.struct(*[j[f].alias(f) for f in JOB_FIELDS])).alias("experience"),
        F.transform(school_order, lambda s: F.struct(*[s[f].alias(f) for f in SCHOOL_FIELDS])).alias("education"),
        _by(F.array_distinct(origins), (lambda o: o["field"], False), (lambda o: o["source"], False)).alias("provenance"),
        *[confidence[f].alias(f"_c_{f}") for f in T.WEIGHTS],
    )
    known = [(f, F.col(f"_c_{f}")) for f in T.WEIGHTS]
    total, weight = F.lit(0.0), F.lit(0.0)
    for f, c in known:
        total = total + F.coalesce(c * F.lit(T.WEIGHTS[f]), F.lit(0.0))
        weight = weight + F.when(c.isNotNull(), F.lit(T.WEIGHTS[f])).otherwise(0.0)
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), c.alias("value")) for f, c in known]), lambda p: p["value"].isNotNull())
    return resolved.select(
        *[c for c in resolved.columns if not c.startswith("_c_")],
        F.coalesce(round4(total / F.when(weight > 0, weight)), F.lit(0.0)).alias("overall_confidence"),
        F.map_from_entries(pairs).alias("field_confidence"),
    )
