"""The shape of records and raw claims, and how extractors build them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_ignoring_case, first_match, let, strip

JOB = "struct<company:string,title:string,start:string,end:string,summary:string>"
SCHOOL = "struct<institution:string,degree:string,field:string,end_year:string>"
CLAIM = f"struct<field:string,method:string,text:string,job:{JOB},school:{SCHOOL}>"


def texts(field: str, method: str, values: Column) -> Column:
    """Claims of one field from an array of texts; none for null."""
    made = F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), F.lit(method).alias("method"), v.alias("text"), F.lit(None).cast(JOB).alias("job"), F.lit(None).cast(SCHOOL).alias("school")))
    return F.coalesce(made, F.array().cast(f"array<{CLAIM}>"))


def text(field: str, method: str, value: Column) -> Column:
    return texts(field, method, F.array(value))


def jobs(method: str, values: Column) -> Column:
    made = F.transform(values, lambda v: F.struct(F.lit("experience").alias("field"), F.lit(method).alias("method"), F.lit(None).cast("string").alias("text"), v.cast(JOB).alias("job"), F.lit(None).cast(SCHOOL).alias("school")))
    return F.coalesce(made, F.array().cast(f"array<{CLAIM}>"))


def schools(method: str, values: Column) -> Column:
    made = F.transform(values, lambda v: F.struct(F.lit("education").alias("field"), F.lit(method).alias("method"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(JOB).alias("job"), v.cast(SCHOOL).alias("school")))
    return F.coalesce(made, F.array().cast(f"array<{CLAIM}>"))


def job(company: Column, title: Column, start: Column | None = None, end: Column | None = None, summary: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(company.alias("company"), title.alias("title"), (none if start is None else start).alias("start"), (F.lit("present") if end is None else end).alias("end"), (none if summary is None else summary).alias("summary"))


def records(df: DataFrame, source_type: str, claims: list[Column], emails: Column, name: Column, github: Column | None = None, linkedin: Column | None = None, rec_idx: Column | None = None) -> DataFrame:
    """One row for each record that claims something: path, rec_idx, source_type, claims, and the hints that identity is resolved by.

    Claims keep the order they are given in; rec_idx orders the records of a file.
    """
    none = F.lit(None).cast("string")
    given = F.filter(F.concat(*claims), lambda c: (F.coalesce(c["text"], F.lit("")) != "") | c["job"].isNotNull() | c["school"].isNotNull())
    row = F.struct(
        F.col("path").alias("path"),
        (F.lit(0) if rec_idx is None else rec_idx).cast("int").alias("rec_idx"),
        F.lit(source_type).alias("source_type"),
        given.alias("claims"),
        F.coalesce(emails, F.array().cast("array<string>")).alias("hint_emails"),
        name.alias("hint_name"),
        (none if github is None else github).alias("hint_github"),
        (none if linkedin is None else linkedin).alias("hint_linkedin"),
    )
    # a filter would be pushed below the columns, and compute all of them once more
    return df.select(F.explode(F.filter(F.array(row), lambda r: F.size(r["claims"]) > 0)).alias("r")).select("r.*")


def emails_in(content: Column, pattern: str) -> Column:
    found = F.when(content.contains("@"), F.regexp_extract_all(content, F.lit(pattern), 0))
    return let(F.coalesce(found, F.when(content.isNotNull(), F.array().cast("array<string>"))), distinct_ignoring_case)


def phones_in(content: Column, pattern: str) -> Column:
    """Phone-like tokens with 7 to 15 digits."""
    found = F.transform(F.regexp_extract_all(content, F.lit(pattern), 0), strip)
    return let(F.filter(found, lambda x: F.length(F.regexp_replace(x, r"(?U)\D", "")).between(7, 15)), distinct_ignoring_case)


def address_in(content: Column, pattern: str, mark: str) -> Column:
    """The first match of a pattern that holds `mark`, in whatever case; texts without it are not searched."""
    return F.when(F.lower(content).contains(mark), first_match(content, pattern))
