"""Value normalisers: each takes a text Column and gives the canonical value, or null where it cannot be sure."""

import importlib.util

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .text import capitalize, capitalize_words, clean, collapse, first_match, let, pieces, strip, title

def email(c: Column) -> Column:
    """Trimmed, without angle brackets, lower case; a plain address with a top-level domain of two letters or more."""
    x = F.lower(F.regexp_replace(strip(c), "^[<>]+|[<>]+$", ""))
    return let(x, lambda x: F.when(x.rlike(r"\A[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\z"), x))


#: Whether the optional number library is there; phones are then valid numbers and not only of the right form.
NUMBER_LIBRARY = importlib.util.find_spec("phonenumbers") is not None


def phone(c: Column) -> Column:
    """E.164: by the number library where it is installed, which tells valid numbers of all regions, else by form. Numbers without + are North American."""
    if not NUMBER_LIBRARY:
        return phone_by_form(c)

    @F.pandas_udf("string")
    def valid(texts: pd.Series) -> pd.Series:
        import phonenumbers as library

        def e164(text: str) -> str | None:
            try:
                number = library.parse(text, None if text.startswith("+") else "US")
                return library.format_number(number, library.PhoneNumberFormat.E164) if library.is_valid_number(number) else None
            except Exception:  # noqa: BLE001 - no number
                return None

        # each distinct text is looked at once
        known = {t: e164(t) for t in set(texts) if t}
        return pd.Series([known.get(t) for t in texts], dtype=object)

    return valid(strip(c))


def phone_by_form(c: Column) -> Column:
    """E.164 by form alone: + with 8 to 15 digits as it is; 10 digits, or 11 that start with 1, as North American."""
    x = F.regexp_replace(strip(c), r"[^0-9+]", "")
    bare = F.regexp_replace(x, r"^\++", "")
    return (
        F.when(x.startswith("+"), F.when(bare.rlike(r"\A[0-9]{8,15}\z"), F.concat(F.lit("+"), bare)))
        .when(bare.rlike(r"\A[0-9]{10}\z"), F.concat(F.lit("+1"), bare))
        .when(bare.rlike(r"\A1[0-9]{10}\z"), F.concat(F.lit("+"), bare))
    )


def _year_month(year: Column, month: Column, last_year: Column) -> Column:
    return F.when(year.between(1900, last_year) & month.between(1, 12), F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def date(c: Column, last_year: Column | None = None) -> Column:
    """YYYY-MM, or "present". A bare year is its January. Years run from 1900 to last_year, next year by default."""
    last = F.year(F.current_date()) + 1 if last_year is None else last_year
    forms = [
        (r"\A([0-9]{4})[-/]([0-9]{1,2})\z", 1, 2, False),
        (r"\A([0-9]{1,2})[-/]([0-9]{4})\z", 2, 1, False),
        (r"\A([a-z]+)\.?,?\s+([0-9]{4})\z", 2, 1, True),
        (r"\A([0-9]{4})\s+([a-z]+)\.?\z", 1, 2, True),
    ]

    def read(x: Column) -> Column:
        out = F.when(x.isin(T.PRESENT), "present")
        for pattern, y, m, named in forms:
            part = F.regexp_extract(x, pattern, m)
            month = T.lookup(T.MONTHS, part) if named else F.try_to_number(part, F.lit("99")).cast("int")
            fits = x.rlike(pattern) & month.isNotNull() if named else x.rlike(pattern)
            out = out.when(fits, _year_month(F.regexp_extract(x, pattern, y).try_cast("int"), month, last))
        return out.when(x.rlike(r"\A[0-9]{4}\z"), _year_month(x.try_cast("int"), F.lit(1), last))

    return let(F.lower(strip(c)), read)


def end_year(c: Column, last_year: Column | None = None) -> Column:
    """Year of a date, else the first 19xx or 20xx in the text."""
    year = let(date(c, last_year), lambda d: F.when(d != "present", F.substring(d, 1, 4).cast("int")))
    return F.coalesce(year, first_match(c, "(19|20)[0-9]{2}").cast("int"))


def country(c: Column) -> Column:
    """ISO code of a country's name, alias or code."""
    key = F.regexp_replace(F.lower(strip(c)), r"\.+$", "")
    codes = sorted(set(T.COUNTRIES.values()))
    return let(key, lambda key: F.when((F.length(key) == 2) & F.upper(key).isin(codes), F.upper(key)).otherwise(T.lookup(T.COUNTRIES, key)))


def location(c: Column) -> Column:
    """struct<city, region, country> of a comma-separated place; a known city gives its country."""

    def split(parts: Column) -> Column:
        last = F.when(F.size(parts) > 0, country(F.get(parts, F.size(parts) - 1)))
        return let(last, lambda last: F.struct(last.alias("last"), F.when(last.isNotNull(), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts).alias("rest")))

    def place(s: Column) -> Column:
        city = F.when(F.size(s["rest"]) > 0, capitalize_words(F.get(s["rest"], F.lit(0))))
        second = F.get(s["rest"], F.lit(1))
        region = F.when(F.length(second) <= 3, F.upper(second)).otherwise(capitalize_words(second))
        return let(city, lambda city: F.struct(city.alias("city"), region.alias("region"), F.coalesce(s["last"], T.lookup(T.CITIES, F.lower(city))).alias("country")))

    return let(let(pieces(c, ","), split), place)


def name(c: Column) -> Column:
    """A person's name in title case, particles lower; null if empty or with a digit."""
    x = F.regexp_replace(collapse(c), r"^[.,]+|[.,]+$", "")

    def word(w: Column) -> Column:
        low = F.lower(w)
        return F.when(low.isin(T.PARTICLES), low).when(w.contains("-"), F.array_join(F.transform(F.split(w, "-"), capitalize), "-")).otherwise(capitalize(w))

    return let(x, lambda x: F.when((x != "") & ~x.rlike(r"(?U)\d"), F.array_join(F.transform(F.split(x, " "), word), " ")))


def years(c: Column) -> Column:
    """The first number in a text, from 0 to 70."""
    n = first_match(c, r"[0-9]+(\.[0-9]+)?").try_cast("double")
    return let(n, lambda n: F.when(n.between(0, 70), n))


def skill(c: Column) -> Column:
    """struct<name, canonical>: a known skill's name, or the text as it is written if in capitals, else capitalised; null over 40 characters."""
    x = collapse(F.regexp_replace(strip(c), r"^[.,;/]+|[.,;/]+$", ""))

    def named(x: Column) -> Column:
        capitals = (x == F.upper(x)) & (x != F.lower(x))
        out = let(T.lookup(T.skill_aliases(), F.lower(x)), lambda known: F.struct(F.coalesce(known, F.when(capitals, x).otherwise(capitalize_words(x))).alias("name"), known.isNotNull().alias("canonical")))
        return F.when((x != "") & (F.length(x) <= 40), out)

    return let(x, named)


def url(c: Column) -> Column:
    """With a scheme, without trailing slashes; null if blank."""
    with_scheme = lambda x: F.when(x.startswith("http://") | x.startswith("https://"), x).otherwise(F.concat(F.lit("https://"), x))
    return let(strip(c), lambda x: F.when(x != "", F.regexp_replace(with_scheme(x), "/+$", "")))


def github_handle(c: Column) -> Column:
    handle = F.lower(first_match(c, r"(?i)github\.com/([A-Za-z0-9\-_]+)", 1))
    return let(handle, lambda handle: F.when(~handle.isin(T.RESERVED_HANDLES), handle))


def linkedin_handle(c: Column) -> Column:
    return F.lower(first_match(c, r"(?i)linkedin\.com/in/([A-Za-z0-9\-_%]+)", 1))


def experience(job: Column, last_year: Column | None = None) -> Column:
    """A job with clean texts and dates; null without company and title. A missing end is the present, an unreadable one is null."""
    company = clean(job["company"])
    job_title = clean(F.regexp_replace(clean(job["title"]), rf"(?iU)^({T.FILLER_WORDS})\s+", ""))
    end = F.coalesce(date(job["end"], last_year), F.when(job["end"].isNull(), "present"))
    out = F.struct(company.alias("company"), job_title.alias("title"), date(job["start"], last_year).alias("start"), end.alias("end"), clean(job["summary"]).alias("summary"))
    return let(out, lambda j: F.when(j["company"].isNotNull() | j["title"].isNotNull(), j))


def education(school: Column, last_year: Column | None = None) -> Column:
    """A school with clean texts and its end year; null without institution and degree."""
    institution, degree = clean(school["institution"]), clean(school["degree"])
    out = F.struct(institution.alias("institution"), degree.alias("degree"), clean(school["field"]).alias("field"), end_year(school["end_year"], last_year).alias("end_year"))
    return let(out, lambda s: F.when(s["institution"].isNotNull() | s["degree"].isNotNull(), s))


def candidate_id(emails: Column, full_name: Column) -> Column:
    """cand_ and twelve digits of the SHA-1 of the first e-mail address, else the name, else nothing."""
    return F.concat(F.lit("cand_"), F.substring(F.sha1(F.lower(F.coalesce(F.get(emails, F.lit(0)), full_name, F.lit("")))), 1, 12))


def company_key(c: Column) -> Column:
    """Letters and digits only, lower case; empty for null."""
    return F.coalesce(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))


def text_key(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit(""))


#: Hooks that a projection may name. The phones of a profile are E.164 before.
HOOKS = {"E164": phone_by_form, "canonical": lambda c: skill(c)["name"], "lower": F.lower, "upper": F.upper, "title": title}
