"""Value normalisers over input and expected pairs."""

import pytest
from pyspark.sql import functions as F

from amalgam.functions import tables as T
from amalgam.functions import text as X
from amalgam.functions import values as V

CASES = {
    "email": (V.email, {" <Ada@X.io> ": "ada@x.io", "bad@x": None, "a b@c.de": None, "": None, None: None, "x@y.c": None, "A.B+C@d-e.org": "a.b+c@d-e.org"}),
    "phone": (V.phone, {"(415) 555-2671": "+14155552671", "+44 20 7946 0958": "+442079460958", "1-415-555-2671": "+14155552671", "not-a-phone": None, "1936-01 - 1939-08": None, "+123": None, "": None, None: None}),
    "date": (
        lambda c: V.date(c, F.lit(2027)),
        {"2019-03": "2019-03", "2019/3": "2019-03", "03/2019": "2019-03", "Mar 2019": "2019-03", "March, 2019": "2019-03", "2019 Mar.": "2019-03", "2019": "2019-01", " Present ": "present", "13/2019": None, "2019-03-15": None, "1899": None, "2028": None, "foo 2019": None, "": None, None: None, "sept 2001": "2001-09"},
    ),
    "end_year": (lambda c: V.end_year(c, F.lit(2027)), {"2015": 2015, "May 2016": 2016, "class of 2014": 2014, "present": None, None: None, "none": None}),
    "country": (V.country, {"UK": "GB", "u.k.": None, "Germany": "DE", "de": "DE", "xx": None, "USA.": "US", " The Netherlands ": "NL", None: None, "": None}),
    "name": (V.name, {"  ada   LOVELACE ": "Ada Lovelace", "mary-jane VAN DER berg": "Mary-Jane van der Berg", "X1": None, ".": None, "o'neil": "O'neil", "McDonald": "Mcdonald", None: None, "": None}),
    "years": (V.years, {"~12 yrs": 12.0, "8.5+": 8.5, "100": None, "x": None, "": None, None: None, "0": 0.0, "70": 70.0}),
    "skill": (lambda c: V.skill(c)["name"], {"JS": "JavaScript", "k8s": "Kubernetes", "COBOL": "COBOL", "foo bar.": "Foo Bar", "x" * 41: None, "": None, None: None, "C++": "C++", " node.js; ": "Node.js", "cobol": "Cobol"}),
    "url": (V.url, {"github.com/a/": "https://github.com/a", "HTTP://x": "https://HTTP://x", " ": None, None: None, "http://a//": "http://a"}),
    "github": (V.github_handle, {"see https://GitHub.com/Ada-L/repo": "ada-l", "github.com/settings": None, "x": None, None: None}),
    "linkedin": (V.linkedin_handle, {"linkedin.com/in/A%20b?x": "a%20b", "linkedin.com/company/x": None, None: None}),
    "title": (X.title, {"o'neil mc-donald x2y": "O'Neil Mc-Donald X2Y", "ÉA é": "Éa É", "": "", None: None}),
    "clean": (X.clean, {"  a \t\n b c ": "a b c", " ": None, None: None}),
    "company": (V.company_key, {"Analytical-Engines, Inc.": "analyticalenginesinc", None: "", "...": ""}),
}


@pytest.mark.parametrize("name", CASES)
def test_values(spark, name):
    fn, cases = CASES[name]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, x string").select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in rows] == list(cases.values())


@pytest.mark.parametrize(
    ("raw", "city", "region", "country"),
    [("London, UK", "London", None, "GB"), ("San Francisco, CA, USA", "San Francisco", "CA", "US"), ("Chicago, IL", "Chicago", None, "IL"), ("Paris, Texas", "Paris", "Texas", "FR"), ("Singapore", None, None, "SG"), ("new  york", "New York", None, "US"), ("", None, None, None), (None, None, None, None), (" , ", None, None, None)],
)
def test_location(spark, raw, city, region, country):
    row = spark.createDataFrame([(raw,)], "x string").select(V.location(F.col("x")).alias("l")).first().l
    assert (row.city, row.region, row.country) == (city, region, country)


def test_skill_flag(spark):
    rows = spark.createDataFrame([("reactjs",), ("Basket weaving",)], "x string").select(V.skill(F.col("x")).alias("s")).collect()
    assert [(r.s.name, r.s.canonical) for r in rows] == [("React", True), ("Basket Weaving", False)]


def test_job_and_school(spark):
    df = spark.createDataFrame([(("  Acme ", "Currently Principal  Engineer", "Mar 2019", None, None), ("MIT", "BSc", None, "2015"))], "j struct<company:string,title:string,start:string,end:string,summary:string>, s struct<institution:string,degree:string,field:string,end_year:string>")
    r = df.select(V.experience(F.col("j")).alias("j"), V.education(F.col("s")).alias("s"), V.experience(F.struct(*[F.lit("").alias(x) for x in ("company", "title", "start", "end", "summary")])).alias("none")).first()
    assert tuple(r.j) == ("Acme", "Principal Engineer", "2019-03", "present", None)
    assert tuple(r.s) == ("MIT", "BSc", None, 2015)
    assert r.none is None


def test_base_confidence(spark):
    cases = [("recruiter_csv", "full_name", "csv_column", 8330), ("github", "links.github", "github_api", 9025), ("recruiter_notes", "experience", "regex_freetext", 2170), ("fax", "emails", "guess", 3000), ("resume", "emails", "regex_email", 7360)]
    rows = spark.createDataFrame([c[:3] for c in cases], "s string, f string, m string").select(T.base_confidence(F.col("s"), F.col("f"), F.col("m")).alias("bp"), T.priority(F.col("s")).alias("p")).collect()
    assert [r.bp for r in rows] == [c[3] for c in cases] == [T.base_points(*c[:3]) for c in cases]
    assert [r.p for r in rows] == [1, 3, 4, 5, 2]


def test_phones_by_the_number_library(spark, tmp_path, monkeypatch):
    """With the library, which a stand-in plays here, valid numbers alone are kept; texts without + are North American."""
    (tmp_path / "phonenumbers.py").write_text(
        "class PhoneNumberFormat:\n    E164 = 0\n\n"
        "def parse(text, region):\n    if 'x' in text:\n        raise ValueError(text)\n    return ('+1' if region == 'US' else '') + ''.join(c for c in text if c in '+0123456789')\n\n"
        "def is_valid_number(n):\n    return len(n) == 12\n\ndef format_number(n, form):\n    return n\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "phonenumbers.py"))
    monkeypatch.setattr(V, "NUMBER_LIBRARY", True)
    given = [" (415) 555-2671 ", "+14155552671", "+1415", "x", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", V.phone(F.col("t")).alias("p")).collect()
    assert [r.p for r in sorted(rows)] == ["+14155552671", "+14155552671", None, None, None, None]


def test_addresses_in_linear_time(spark):
    """The address pattern finds what its plain form finds, and long runs without an address cost no more than their length."""
    import random
    import time

    from amalgam.functions import patterns as P
    from amalgam.sources import claims as C

    plain = r"(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}"
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab.@-_c é") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a@b.co_x@y.org", "x@y.zz@q.io", "a@b.c@d.ef"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_extract_all("t", F.lit(plain), 0).alias("a"), F.regexp_extract_all("t", F.lit(P.EMAIL), 0).alias("b"))
    assert df.where("a <> b").count() == 0 and df.where("size(a) > 0").count() > 50
    took = time.time()
    long = spark.createDataFrame([("x" * 200_000 + " a@b.io " + "y" * 200_000,)], "t string").select(C.emails_in(F.col("t"), P.EMAIL).alias("e"))
    assert long.first().e == ["a@b.io"] and time.time() - took < 5
