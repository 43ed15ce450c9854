"""JSON documents with foreign field names, through Spark's VARIANT type."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import values as V
from . import claims as C

EMPTY = ["null", '""', "[]", "{}"]


def dig(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def first(value: Column, paths: list[str]) -> Column:
    """The value at the first path that has one: neither null nor empty."""
    return F.coalesce(*[F.when(~F.to_json(v).isin(EMPTY), v) for v in (dig(value, p) for p in paths)])


def truthy(value: Column, keys: list[str]) -> Column:
    """As first(), but zero and false count as empty, too."""
    return F.coalesce(*[F.when(~F.to_json(v).isin([*EMPTY, "0", "false", "0.0"]), v) for v in (dig(value, k) for k in keys)])


def items(value: Column) -> Column:
    """The items of a list, or the value alone; null for null."""
    return F.when(value.isNotNull(), F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value)))


def string(value: Column) -> Column:
    """A JSON string's text; null for any other type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def scalar(value: Column) -> Column:
    """A string's or number's text; null for lists and objects."""
    kind = F.schema_of_variant(value)
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(value, "$", "string"))


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def place(value: Column) -> Column:
    """A place as text; an object's city, region and country in one."""
    parts = F.array_compact(F.array(*[scalar(truthy(value, [k])) for k in ("city", "region", "country")]))
    return F.when(is_object(value), F.array_join(parts, ", ")).otherwise(string(value))


def documents(files: DataFrame) -> DataFrame:
    """(path, rec_idx, c): the objects of each document, which is a list, an object with a list under a known key, or one object. Broken JSON has none."""
    doc = F.try_parse_json(F.col("content"))
    whole = files.select("path", doc.alias("doc"))
    lists = [F.when(F.schema_of_variant(dig(F.col("doc"), k)).startswith("ARRAY"), F.try_variant_get(dig(F.col("doc"), k), "$", "array<variant>")) for k in T.JSON_LISTS]
    own = F.when(F.schema_of_variant("doc").startswith("ARRAY"), F.try_variant_get(F.col("doc"), "$", "array<variant>"))
    found = F.coalesce(own, *lists, F.when(is_object(F.col("doc")), F.array("doc")))
    return whole.select("path", F.posexplode(found).alias("rec_idx", "c")).where(is_object(F.col("c")))


def extract_json(files: DataFrame) -> DataFrame:
    """A record for each object. Values of a type that a field cannot have are left out."""
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    method = "ats_field_map"
    c = F.col("c")
    # each field is looked up once and projected, so plans stay small
    base = documents(files).select("path", "rec_idx", *[first(c, paths).alias(f.replace(".", "_")) for f, paths in T.JSON_PATHS.items()])
    col = lambda f: F.col(f.replace(".", "_"))
    strings = lambda v: F.transform(items(v), string)
    skill = lambda v: F.when(is_object(v), string(truthy(v, ["name", "skill", "tag"]))).otherwise(string(v))
    objects = lambda v: F.filter(items(v), is_object)
    # an end that is given but no text is no missing end
    end = lambda j: F.coalesce(string(truthy(j, T.JSON_JOB["end"])), F.when(F.coalesce(*[dig(j, k) for k in T.JSON_JOB["end"]]).isNotNull() & (F.to_json(dig(j, T.JSON_JOB["end"][-1])) == '""'), F.lit("")))
    job = lambda j: F.struct(*[(end(j) if k == "end" else string(truthy(j, keys))).alias(k) for k, keys in T.JSON_JOB.items()])
    school = lambda s: F.struct(*[(scalar if k == "end_year" else string)(truthy(s, keys)).alias(k) for k, keys in T.JSON_SCHOOL.items()])
    name, github, linkedin = string(col("full_name")), string(col("links.github")), string(col("links.linkedin"))
    made = [
        C.text("full_name", method, name),
        C.texts("emails", method, strings(col("emails"))),
        C.texts("phones", method, strings(col("phones"))),
        C.text("headline", method, string(col("headline"))),
        C.text("years_experience", method, scalar(col("years_experience"))),
        C.text("location", method, place(col("location"))),
        C.text("links.linkedin", method, linkedin),
        C.text("links.github", method, github),
        C.text("links.portfolio", method, string(col("links.portfolio"))),
        C.texts("skills", method, F.transform(items(col("skills")), skill)),
        C.jobs(method, F.transform(objects(col("experience")), job)),
        C.schools(method, F.transform(objects(col("education")), school)),
    ]
    return C.records(base, "ats_json", made, F.array_compact(strings(col("hint_emails"))), name, V.github_handle(github), V.linkedin_handle(linkedin), F.col("rec_idx"))
