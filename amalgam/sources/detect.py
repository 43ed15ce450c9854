"""Which kind of source a file is, from its extension and the first 8,192 characters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import tables as T
from ..functions.text import has_text, let, split_lines, strip

HEAD_CHARS = 8192


def classify_json(head: Column) -> Column:
    """github for an object (or a list whose first item is one) with the keys of a profile; text that does not parse is judged by its words."""
    value = F.try_parse_json(head)
    is_list = strip(head).startswith("[")
    first = F.try_variant_get(value, "$[0]", "variant")
    sample = F.when(is_list & first.isNotNull(), F.to_json(first)).otherwise(head)
    keys = F.coalesce(F.transform(F.json_object_keys(sample), F.lower), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, k)
    profile = has("login") | has("public_repos") | (has("html_url") & has("followers"))
    words = head.contains('"login"') & head.contains('"public_repos"')
    return F.when(F.when(value.isNull(), words).otherwise(profile), "github").otherwise("ats_json")


def classify_text(head: Column) -> Column:
    """github if half the lines or more hold a profile address, resume with two header words at line starts, else notes."""
    lines = F.filter(F.transform(split_lines(head), strip), lambda x: x != "")
    half = let(lines, lambda ls: F.size(F.filter(ls, lambda x: x.rlike(P.GITHUB_LINE))) >= F.greatest(F.lit(1), F.floor(F.size(ls) / 2)))
    low = F.lower(head)
    # one pass finds all words; none of them begins another
    headers = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?mdU)^\s*({'|'.join(T.RESUME_WORDS)})\b"), 1)))
    return (
        F.when(~has_text(head), "recruiter_notes")
        .when(low.contains("github.com/") & half, "github")
        .when(headers >= 2, "resume")
        .otherwise("recruiter_notes")
    )


def source_type(ext: Column, content: Column) -> Column:
    head = F.substring(content, 1, HEAD_CHARS)
    return (
        F.when(ext.isin(".pdf", ".docx"), "resume")
        .when(ext == ".csv", "recruiter_csv")
        .when(ext == ".json", classify_json(head))
        .when(ext.isin(".txt", ".md", ""), classify_text(head))
        .when(F.regexp_replace(head, r"(?U)^\s+", "").rlike(r"\A[{\[]"), classify_json(head))
        .otherwise(classify_text(head))
    )


def with_types(files: DataFrame, forced: dict[str, str] | None = None) -> DataFrame:
    """files with source_type: the forced one, else the detected one."""
    detected = source_type(F.col("ext"), F.col("content"))
    chosen = F.coalesce(T.lookup(forced, F.col("path")), detected) if forced else detected
    return files.withColumn("source_type", chosen)
