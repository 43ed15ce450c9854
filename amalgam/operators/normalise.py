"""From records with raw claims to normalised claims and hints."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import values as V
from ..functions.text import clean, let

LOCATION = "struct<city:string,region:string,country:string>"
EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:int>"

#: Orders records by file, then by place in the file; no path holds the separator.
SEPARATOR = "\x00"


def record_id(path: Column, rec_idx: Column) -> Column:
    return F.concat(path, F.lit(SEPARATOR), F.lpad(rec_idx.cast("string"), 10, "0"))


def normalise_claims(records: DataFrame, last_year: Column | None = None) -> DataFrame:
    """One row for each claim whose value can be trusted: record_id, claim_idx, field, source, source_type, method, base_bp and the value in the column of its kind.

    base_bp is trust times certainty in basis points. claim_idx is the claim's place in
    its record; it decides between equals later on.
    """
    each = records.select(record_id(F.col("path"), F.col("rec_idx")).alias("record_id"), "path", "source_type", F.posexplode("claims").alias("claim_idx", "c"))
    f, t = F.col("c.field"), F.col("c.text")
    # a null where there is no phone, so that a library sees phones alone
    number = V.phone(F.when(f == "phones", t))
    place = let(V.location(t), lambda p: F.when(p["city"].isNotNull() | p["region"].isNotNull() | p["country"].isNotNull(), p))
    each = each.withColumn("s", F.when(f == "skills", V.skill(t)))
    text = (
        F.when(f == "full_name", V.name(t))
        .when(f == "emails", V.email(t))
        .when(f == "phones", number)
        .when(f == "headline", clean(t))
        .when(f.startswith("links."), V.url(t))
    )
    row = F.struct(
        F.col("record_id").alias("record_id"),
        F.col("claim_idx").alias("claim_idx"),
        f.alias("field"),
        F.concat_ws(":", "source_type", F.regexp_replace("path", r"\\", "/")).alias("source"),
        F.col("source_type").alias("source_type"),
        F.col("c.method").alias("method"),
        T.base_confidence(F.col("source_type"), f, F.col("c.method")).alias("base_bp"),
        F.coalesce(text, F.col("s.name")).alias("v_text"),
        F.col("s.canonical").alias("v_canonical"),
        F.when(f == "years_experience", V.years(t)).alias("v_number"),
        F.when(f == "location", place).alias("v_place"),
        F.when(f == "experience", V.experience(F.col("c.job"), last_year)).alias("v_job"),
        F.when(f == "education", V.education(F.col("c.school"), last_year)).alias("v_school"),
    )
    holds = lambda r: (F.coalesce(r["v_text"], F.lit("")) != "") | r["v_number"].isNotNull() | r["v_place"].isNotNull() | r["v_job"].isNotNull() | r["v_school"].isNotNull()
    # a filter would be pushed below the columns, and compute all of them once more
    return each.select(F.explode(F.filter(F.array(row), holds)).alias("r")).select("r.*")


def normalise_hints(records: DataFrame) -> DataFrame:
    """(record_id, emails, name, github, linkedin): what identity is resolved by."""
    emails = F.array_compact(F.transform("hint_emails", V.email))
    return records.select(record_id(F.col("path"), F.col("rec_idx")).alias("record_id"), emails.alias("emails"), V.name(F.col("hint_name")).alias("name"), F.col("hint_github").alias("github"), F.col("hint_linkedin").alias("linkedin"))
