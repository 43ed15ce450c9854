"""Text functions that follow Python's string methods, as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that str.strip() and str.split() know: Unicode's, and four separators that Java leaves out.
SPACE = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+\\z", "")


def collapse(c: Column) -> Column:
    """Stripped, with one space for each run of white space."""
    return F.regexp_replace(strip(c), f"(?U){SPACE}+", " ")


def has_text(c: Column) -> Column:
    """Whether strip() leaves anything, told by the first character that is no white space."""
    return c.rlike(r"(?U)[^\s\x1c-\x1f]")


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used. (The optimiser copies a column's expression to each of its uses.)"""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def clean(c: Column) -> Column:
    """Collapsed text, null if nothing is left."""
    return blank_to_null(collapse(c))


def split_lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def capitalize(c: Column) -> Column:
    """First character upper, the others lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def capitalize_words(c: Column) -> Column:
    """Each word of a collapsed text capitalised."""
    return F.array_join(F.transform(F.split(collapse(c), " "), capitalize), " ")


def title(c: Column) -> Column:
    """str.title(): every run of letters capitalised, whatever stands between."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, capitalize), "")


def first_line(c: Column) -> Column:
    """The first line with text, stripped."""
    return strip(F.regexp_extract(c, rf"(?U)\A{SPACE}*([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)", 1))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def distinct_ignoring_case(xs: Column) -> Column:
    """Items of an array without those that equal an earlier one but for case. Equals meet by sorting, so that long arrays cost little more than their length."""
    marked = F.transform(xs, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x")))
    firsts = let(F.sort_array(marked), lambda ms: F.filter(ms, lambda m, k: ~m["low"].eqNullSafe(F.get(ms, k - 1)["low"])))
    once = F.transform(F.sort_array(F.transform(firsts, lambda m: F.struct(m["i"], m["x"]))), lambda m: m["x"])
    return F.when(F.size(xs) < 2, xs).otherwise(once)


def pieces(c: Column, pattern: str) -> Column:
    """Stripped non-empty parts between matches of pattern; an empty array for null."""
    parts = F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))
