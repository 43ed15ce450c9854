"""Free-text notes: one record a file."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import values as V
from ..functions.text import first_line, first_match, has_text, pieces, strip
from . import claims as C


def guess_name(content: Column) -> Column:
    """The name after a cue, else two or three capitalised words at the start."""
    return F.coalesce(first_match(content, P.NAME_CUE, 1), first_match(first_line(content), P.NAME_START, 1))


def extract_notes(files: DataFrame) -> DataFrame:
    method = "regex_freetext"
    t = F.col("content")
    with_name = files.where(has_text(t)).select("path", "content", guess_name(t).alias("name"), first_match(t, P.TITLE_AT).alias("role"), C.emails_in(t, P.EMAIL).alias("emails"), C.address_in(t, P.GITHUB, "github.com/").alias("github"), C.address_in(t, P.LINKEDIN, "linkedin.com/in/").alias("linkedin"))
    # the match gives its own groups, so the text is searched once
    title, company = strip(first_match(F.col("role"), P.TITLE_AT, 1)), strip(first_match(F.col("role"), P.TITLE_AT, 2))
    made = [
        C.texts("emails", "regex_email", F.col("emails")),
        C.texts("phones", "regex_phone", C.phones_in(t, P.PHONE)),
        C.text("full_name", method, F.col("name")),
        C.text("headline", method, F.concat(title, F.lit(" at "), company)),
        C.jobs(method, F.when(title.isNotNull(), F.array(C.job(company, title)))),
        C.text("years_experience", method, first_match(t, P.YEARS, 1)),
        C.texts("skills", method, pieces(F.regexp_replace(first_match(t, P.SKILLS_CUE, 1), r"(?iU)\band\b", ","), ",")),
        C.text("location", method, strip(first_match(t, P.LOCATION_CUE, 1))),
        C.text("links.linkedin", method, F.col("linkedin")),
        C.text("links.github", method, F.col("github")),
    ]
    return C.records(with_name, "recruiter_notes", made, F.col("emails"), F.col("name"), V.github_handle(F.col("github")), V.linkedin_handle(F.col("linkedin")))
