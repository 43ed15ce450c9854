"""Identity and resolution on hand-made claims."""

import pytest
from pyspark.sql import functions as F

from amalgam.operators.components import connected_components
from amalgam.operators.identity import resolve_identities
from amalgam.operators.normalise import EDUCATION, EXPERIENCE, LOCATION
from amalgam.operators.resolve import profiles

HINTS = "record_id string, emails array<string>, name string, github string, linkedin string"
CLAIMS = f"component string, record_id string, claim_idx int, field string, source string, source_type string, method string, base_bp int, v_text string, v_canonical boolean, v_number double, v_place {LOCATION}, v_job {EXPERIENCE}, v_school {EDUCATION}"


def claim(record, field, kind, method, bp, text=None, number=None, place=None, job=None, school=None, component="p", idx=0):
    return (component, record, idx, field, f"{kind}:f", kind, method, bp, text, None, number, place, job, school)


def groups(spark, rows):
    found = {}
    for r in resolve_identities(spark.createDataFrame(rows, HINTS)).collect():
        found.setdefault(r.component, set()).add(r.record_id)
    return found


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(1, 1), (None, 3), (2, 3), (3, 2), (2, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[k] for k in range(5, 40)} == {5}
    assert got[1] == 1 and got[2] == got[3] == 2


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_identity_links(spark):
    rows = [
        ("1", ["a@x.io"], "Ada", None, None),
        ("2", ["b@x.io", "a@x.io"], "Ada L", "ada", None),
        ("3", [], None, "ada", None),
        ("4", [], "Ada", None, None),  # weak: a name alone never joins a record with an address
        ("5", [], "Ada", None, None),
        ("6", ["c@x.io"], "Ada", None, None),
        ("7", [], None, None, "ada"),
        ("8", [], None, None, None),
        ("9", [], None, None, None),
    ]
    assert groups(spark, rows) == {"1": {"1", "2", "3"}, "4": {"4", "5"}, "6": {"6"}, "7": {"7"}, "8": {"8"}, "9": {"9"}}


def test_identity_of_a_shared_mailbox(spark):
    rows = [(f"{i:05}", ["team@x.io"], None, None, None) for i in range(3000)]
    assert groups(spark, rows) == {"00000": {r[0] for r in rows}}


def one(spark, claims):
    return profiles(spark.createDataFrame(claims, CLAIMS)).first()


def test_agreement_raises_and_conflict_lowers(spark):
    r = one(spark, [claim("1", "full_name", "recruiter_csv", "csv_column", 8330, "Ada Lovelace"), claim("2", "full_name", "resume", "resume_section", 5950, "ADA lovelace")])
    assert (r.full_name, r.field_confidence["full_name"]) == ("Ada Lovelace", 0.883)
    r = one(spark, [claim("1", "full_name", "recruiter_csv", "csv_column", 8330, "Ada"), claim("2", "full_name", "recruiter_csv", "csv_column", 8330, "Bob")])
    assert (r.full_name, r.field_confidence["full_name"]) == ("Ada", 0.708)  # .70805 rounds by its exact value


def test_trusted_source_wins_and_cap_holds(spark):
    r = one(spark, [claim("1", "headline", "recruiter_notes", "regex_freetext", 2480, "B"), claim("2", "headline", "ats_json", "ats_field_map", 7760, "A"), *[claim(str(k), "emails", t, "m", 8924, "a@x.io") for k, t in enumerate(("ats_json", "recruiter_csv", "resume", "github"))]])
    assert r.headline == "A" and r.field_confidence["headline"] == 0.776
    assert r.field_confidence["emails"] == 0.99
    assert r.candidate_id == "cand_" + __import__("hashlib").sha1(b"a@x.io").hexdigest()[:12]


def test_lists_are_ordered_by_confidence_then_value(spark):
    r = one(spark, [claim("1", "phones", "resume", "m", 6600, "+2"), claim("2", "phones", "resume", "m", 6600, "+1"), claim("3", "phones", "ats_json", "m", 8536, "+3")])
    assert r.phones == ["+3", "+1", "+2"]


def test_skills_keep_their_sources(spark):
    r = one(spark, [claim("1", "skills", "github", "github_api", 6650, "Go"), claim("2", "skills", "resume", "resume_section", 6630, "Go"), claim("3", "skills", "resume", "resume_section", 6630, "GO")])
    assert [(s.name, s.confidence, s.sources) for s in r.skills] == [("Go", 0.715, ["github", "resume"]), ("GO", 0.663, ["resume"])]


def test_jobs_merge_and_stubs_go(spark):
    job = lambda c, t, s, e, x=None: (c, t, s, e, x)
    rows = [
        claim("1", "experience", "github", "m", 5225, job=job("acme", None, None, "present")),
        claim("2", "experience", "resume", "m", 6800, job=job("Acme", "Dev", None, None)),
        claim("3", "experience", "recruiter_notes", "m", 2170, job=job("ACME", "dev", "2019-01", "2020-01", "did")),
        claim("4", "experience", "resume", "m", 6800, job=job("Beta", "Dev", "2020-02", "present")),
        claim("5", "experience", "github", "m", 5225, job=job("Lone", None, None, "present")),
    ]
    assert [tuple(j) for j in one(spark, rows).experience] == [("Acme", "Dev", "2019-01", "2020-01", "did"), ("Beta", "Dev", "2020-02", "present", None), ("Lone", None, None, "present", None)]


def test_place_and_links_take_the_best_part(spark):
    rows = [
        claim("1", "location", "recruiter_notes", "m", 2480, place=("Rome", "RM", None)),
        claim("2", "location", "ats_json", "m", 7760, place=("Milan", None, "IT")),
        claim("3", "links.github", "resume", "m", 5460, "https://github.com/a"),
        claim("4", "links.github", "github", "m", 9025, "https://github.com/A"),
    ]
    r = one(spark, rows)
    assert tuple(r.location) == ("Milan", "RM", "IT") and r.field_confidence["location"] == 0.776
    assert r.links.github == "https://github.com/A" and r.links.other == [] and r.field_confidence["links"] == 0.9025
    assert [(p.field, p.source) for p in r.provenance] == [("links", "github:f"), ("location", "ats_json:f")]


@pytest.mark.parametrize("parts", [1, 8, 37])
def test_order_and_partitions_do_not_matter(spark, parts):
    rows = [claim(f"{i:03}", "headline", ("resume", "ats_json", "github")[i % 3], "m", 6000 + i % 4, f"T{i % 5}") for i in range(60)]
    want = profiles(spark.createDataFrame(rows, CLAIMS)).collect()
    got = profiles(spark.createDataFrame(rows[::-1], CLAIMS).repartition(parts, F.col("record_id"))).collect()
    assert got == want


def test_nobody(spark):
    assert profiles(spark.createDataFrame([], CLAIMS)).count() == 0
