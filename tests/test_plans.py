"""From files to results, projection and validation."""

import hashlib
import io
import json
import time
import zipfile

import pytest

from amalgam import cli
from amalgam.plans import pipeline
from amalgam.plans.projection import ConfigError, project
from amalgam.plans.validation import ValidationError, validate, validate_or_raise
from amalgam.sources.files import expand, overrides
from amalgam.sources.profiles import listed_users

CSV = "﻿Full_Name,Email,Phone,Company,Title\r\nGrace Hopper,grace@navy.mil; g@x.io,not-a-phone,US Navy,Rear Admiral\r\n\r\nKatherine Johnson,kj@nasa.gov,,NASA,Mathematician\r\n"
ATS = {"candidates": [{"applicant_name": "ada LOVELACE", "contact": {"email_address": "Ada@analytical.io", "mobile": "+44 20 7946 0958"}, "job_title": "Engineer", "experience_years": 12, "locale": "London, UK", "skill_tags": ["js", {"name": "Python"}], "social": {"github_url": "https://github.com/ada-l"}, "history": [{"org": "Analytical Engines", "role": "Engineer", "from": "2019-03", "to": "Present"}], "schools": [{"name": "Home", "degree": "BSc", "grad": 2015}]}, 7]}
NOTE = "Spoke with Ada Lovelace about the role. ada@analytical.io, ADA@analytical.io\nStaff Engineer at Analytical Engines, 10 years, strong in Python and Go. Based in London, UK.\n"
RESUME = "Alan Turing\nalan@x.io\nSkills\nPython, Logic with Go\nExperience\nBletchley Park, Senior Engineer (1939-09 - 1945-08)\nEducation\nPrinceton, Ph.D in Mathematics, 1938\n"
CACHE = {"login": "Ada-L", "name": "Ada Lovelace", "bio": "Maths", "company": "@analytical-engines", "blog": "ada.io", "location": "London", "email": None, "_languages": ["JavaScript", "Go"], "public_repos": 3}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("inputs")
    (d / "export.csv").write_text(CSV, encoding="utf-8")
    (d / "ats.json").write_text(json.dumps(ATS))
    (d / "note.txt").write_text(NOTE)
    (d / "cv.txt").write_text(RESUME)
    (d / "urls.txt").write_text("https://github.com/ada-l\nhttps://github.com/nobody\n")
    (d / "github_cache").mkdir()
    (d / "github_cache" / "ada-l.json").write_text(json.dumps(CACHE))
    (d / "broken.json").write_text('{"candidates": [{"applicant_name": "Br')
    (d / "latin.csv").write_bytes(b"name,email\nJos\xe9,jose@x.io\n")
    (d / "a b+c%20[1].txt").write_text("  \n")
    return d


@pytest.fixture(scope="module")
def done(spark, folder):
    return pipeline.run(spark, expand([str(folder)]), {})


def people(run):
    return {r.full_name: r for r in run.canonical.collect()}


def test_run_links_and_merges(done):
    found = people(done)
    assert set(found) == {"Grace Hopper", "Katherine Johnson", "Ada Lovelace", "Alan Turing"}
    ada = found["Ada Lovelace"]
    assert ada.emails == ["ada@analytical.io"] and ada.years_experience == 12 and ada.location.country == "GB"
    assert [s.name for s in ada.skills] == ["JavaScript", "Python", "Go"]
    assert [tuple(j)[:4] for j in ada.experience] == [("Analytical Engines", "Engineer", "2019-03", "present"), ("Analytical Engines", "Staff Engineer", None, "present")]
    assert ada.links.github == "https://github.com/Ada-L" and ada.links.portfolio == "https://ada.io"
    grace = found["Grace Hopper"]
    assert grace.phones == [] and grace.emails == ["g@x.io", "grace@navy.mil"] and grace.field_confidence["full_name"] == 0.833
    alan = found["Alan Turing"]
    assert [tuple(j)[:4] for j in alan.experience] == [("Bletchley Park", "Senior Engineer", "1939-09", "1945-08")]
    assert [tuple(e) for e in alan.education] == [("Princeton", "Ph.D", "Mathematics", 1938)]
    assert [s.name for s in alan.skills] == ["Go", "Logic", "Python"]


def test_warnings_and_stats(done, folder):
    assert [w.replace(str(folder), "") for w in done.warnings()] == [
        "no candidates extracted from /a b+c%20[1].txt (recruiter_notes)",
        "no candidates extracted from /broken.json (ats_json)",
        "extractor 'recruiter_csv' failed on /latin.csv: UnicodeDecodeError: 'utf-8' codec can't decode byte 0xe9 in position 14: invalid continuation byte",
    ]
    s = done.stats()
    assert (s["input_files"], s["records_extracted"], s["candidates"], s["all_valid"]) == (8, 6, 4, True)
    assert s["by_source"] == {"ats_json": 1, "github": 1, "recruiter_csv": 2, "recruiter_notes": 1, "resume": 1}


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in text.split("\n"))
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_and_forced_types(spark, tmp_path):
    (tmp_path / "cv.docx").write_bytes(docx(RESUME))
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "cv.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "x.txt").write_text("grace@navy.mil")
    paths = expand([str(tmp_path)])
    done = pipeline.run(spark, paths, {}, overrides([f"{tmp_path}/x.txt=fax", "junk"]))
    assert set(people(done)) == {"Alan Turing"}
    assert any(w.startswith("skipped (unrecognized source type)") for w in done.warnings())


def test_expand(folder, tmp_path):
    assert [p.rsplit("/", 1)[1] for p in expand([f"{folder}/*.csv", f"{folder}/./ats.json", f"{folder}/ats.json", f"{folder}/none"])] == ["ats.json", "export.csv", "latin.csv"]
    assert not any("github_cache" in p for p in expand([str(folder)]))


def output(done, config):
    out = validate(done.canonical, config).orderBy("full_name").collect()
    return [(json.loads(r.output_json) if r.output_json else None, list(r.validation_errors)) for r in out]


def test_paths_hooks_and_omission(done):
    config = {"on_missing": "omit", "fields": [{"path": "name", "from": "full_name", "normalize": "upper"}, {"path": "mail", "from": "emails[1]"}, {"path": "skills", "from": "skills[].name", "type": "string[]"}, {"path": "first", "from": "skills[0].name"}, {"path": "src", "from": "skills[].sources[0]"}, {"path": "none", "from": "a.b", "required": True}, {"path": "deep", "from": "full_name.x"}, {"path": "years", "from": "years_experience", "type": "integer"}]}
    got = output(done, config)
    assert got[0][0] == {"name": "ADA LOVELACE", "skills": ["JavaScript", "Python", "Go"], "first": "JavaScript", "src": ["ats_json", "github"], "none": None, "years": 12}
    assert got[0][1] == ["required field 'none' is null"]
    assert got[2][0] == {"name": "GRACE HOPPER", "mail": "grace@navy.mil", "none": None}


def test_confidence_and_provenance(done):
    got, errors = output(done, {"include_confidence": True, "include_provenance": True, "fields": [{"path": "who", "from": "full_name"}, {"path": "phones"}]})[2]
    assert got["who"] == "Grace Hopper" and got["phones"] is None and got["field_confidence"] == {"who": 0.833}
    assert {p["field"] for p in got["provenance"]} == {"full_name"} and errors == []


def test_error_policy_and_types(done):
    got = output(done, {"on_missing": "error", "fields": [{"path": "phones"}, {"path": "full_name", "type": "number"}]})
    assert got[0] == ({"phones": ["+442079460958"], "full_name": "Ada Lovelace"}, ["field 'full_name' should be number but is str"])
    assert got[2] == (None, ["projection error: missing value for 'phones' (from 'phones')"])


def test_config_errors(done):
    with pytest.raises(ConfigError):
        project(done.canonical, {"fields": [{"path": "skills", "normalize": "canonical"}]})
    with pytest.raises(ValidationError):
        validate_or_raise(done.canonical, {"fields": [{"path": "emails", "type": "number[]"}]})
    assert validate_or_raise(done.canonical, {"fields": [{"path": "emails", "type": "string[]"}]}).count() == 4


def test_command_line(spark, folder, tmp_path, capsys):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"fields": [{"path": "full_name", "type": "string"}, {"path": "years_experience", "type": "number"}]}))
    out = tmp_path / "deep" / "o.json"
    assert cli.main(["-i", str(folder / "ats.json"), "-c", str(config), "-o", str(out)], spark) == 0
    assert out.read_text() == json.dumps([{"full_name": "Ada Lovelace", "years_experience": 12}], indent=2) + "\n"
    assert cli.main(["-i", str(folder / "none")], spark) == 2
    config.write_text(json.dumps({"fields": [{"path": "phones", "required": True}]}))
    assert cli.main(["-i", str(folder / "export.csv"), "-c", str(config), "-q", "--emit", "both"], spark) == 1
    assert [set(x) for x in json.loads(capsys.readouterr().out)] == [{"canonical", "output"}] * 2


def test_lines_are_written_by_executors(spark, folder, tmp_path):
    out = tmp_path / "lines"
    assert cli.main(["-i", str(folder), "--lines", str(out), "--emit", "canonical", "-q"], spark) == 0
    parts = [json.loads(line) for p in sorted(out.glob("part-*")) for line in p.read_text().splitlines()]
    assert [p["candidate_id"] for p in parts] == sorted(p["candidate_id"] for p in parts) and len(parts) == 4
    assert {p["full_name"] for p in parts} == {"Grace Hopper", "Katherine Johnson", "Ada Lovelace", "Alan Turing"}


def test_summary_and_array_file(spark, folder, tmp_path, capsys):
    config, out = tmp_path / "c.json", tmp_path / "o.json"
    config.write_text(json.dumps({"fields": [{"path": "phones", "required": True}]}))
    assert cli.main(["-i", str(folder / "export.csv"), str(folder / "latin.csv"), "-c", str(config), "-o", str(out), "--as", f"{folder}/x=y"], spark) == 1
    assert json.loads(out.read_text()) == [{"phones": None}] * 2 and out.read_text() == json.dumps([{"phones": None}] * 2, indent=2) + "\n"
    assert not list(tmp_path.glob(".*"))
    err = capsys.readouterr().err.splitlines()
    assert err[0] == "files 2, records 2 {'recruiter_csv': 2}, candidates 2, all valid False" and "  ! extractor 'recruiter_csv' failed on" in err[1]
    assert [line.split(": ", 1)[1] for line in err[2:]] == ["required field 'phones' is null"] * 2
    config.write_text(json.dumps({"on_missing": "error", "fields": [{"path": "phones"}]}))
    assert cli.main(["-i", str(folder / "export.csv"), "-c", str(config), "-q"], spark) == 1
    assert capsys.readouterr().out == "[]\n"


def test_patterns_and_folders(spark, tmp_path, monkeypatch):
    for name in ("a1.csv", "a2.csv", "b{x}.csv", ".hidden.csv", "sub/a3.csv", "sub/__pycache__/a4.csv", "sub/github_cache/a5.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    monkeypatch.chdir(tmp_path)
    assert expand(["*.csv"]) == ["a1.csv", "a2.csv", "b{x}.csv"]
    assert expand(["./a?.csv", "*/a*.csv", "a1.csv"]) == ["a1.csv", "a2.csv", "sub/a3.csv"]
    assert expand(["sub"]) == ["sub/a3.csv"] and expand(["b{x}.csv"]) == ["b{x}.csv"] and expand(["none", "n*"]) == []
    assert expand([f"file://{tmp_path}/sub"]) == [f"file://{tmp_path}/sub/a3.csv"]
    assert overrides(["a=b", "./c/../a=d", "x", "p=q=r"]) == {"a": "d", "p": "q=r"}


def test_nested_paragraphs():
    from amalgam.sources.resumes import docx_text

    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:t>a</w:t><w:p><w:t>b</w:t></w:p><w:t>c</w:t></w:p><w:p/><w:p><w:t>d</w:t></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {word}><w:body>{body}</w:body></w:document>")
    assert docx_text(out.getvalue()) == "abc\nb\n\nd"


def test_long_list_of_profiles(spark):
    n = 30_000
    lines = "\n".join(f"https://github.com/U{k}\nhttp://github.com/u{k}\ngithub.com/Orgs" for k in range(n))
    files = spark.createDataFrame([("d/list.txt", lines), ("list.txt", "GitHub.com/b github.com/A x github.com/B github.com/a github.com/about"), ("e/list.txt", ""), ("f/list.txt", None)], "path string, content string")
    begin = time.monotonic()
    found = {}
    for r in sorted(listed_users(files).collect()):
        found.setdefault(r.folder, []).append((r.rec_idx, r.user))
    assert found == {"d": [(k, f"U{k}") for k in range(n)], ".": [(0, "b"), (1, "A")]}
    # comparing all of a list with all of it takes hours here
    assert time.monotonic() - begin < 60


def test_live_profiles(spark, tmp_path):
    """Users without a cached profile are asked for, each once; unknown ones are left out."""
    import http.server
    import threading

    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            user, _, rest = self.path.removeprefix("/users/").partition("/")
            known = user == "grace-h"
            body = [{"language": x} for x in ("Go", None, "Rust", "Go")] + [{"language": f"L{i}"} for i in range(40)] if rest else {"login": "Grace-H", "name": "Grace Hopper", "company": "@navy"}
            self.send_response(200 if known else 404)
            self.end_headers()
            self.wfile.write(json.dumps(body if known else {"message": "Not Found"}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "github_cache").mkdir()
    (tmp_path / "github_cache" / "ada-l.json").write_text(json.dumps(CACHE))
    (tmp_path / "urls.txt").write_text("https://github.com/ada-l\nhttps://github.com/grace-h\nhttps://github.com/nobody\n")
    done = pipeline.run(spark, expand([str(tmp_path)]), {}, service=f"http://127.0.0.1:{server.server_port}")
    found = people(done)
    server.shutdown()
    assert set(found) == {"Ada Lovelace", "Grace Hopper"}
    skills = [s.name for s in found["Grace Hopper"].skills]
    assert {"Go", "Rust", "L25"} <= set(skills) and "L26" not in skills and len(skills) == 28
    assert sorted(asked) == ["/users/grace-h", "/users/grace-h/repos?per_page=100&sort=pushed", "/users/nobody"]


def test_large_delimited_files_are_read_by_line(spark, tmp_path, monkeypatch):
    """The same rows in the same order as from the whole file, by any number of tasks; a file with a line break in a cell has none."""
    from amalgam.sources import delimited
    from amalgam.sources.files import read_files

    body = '"Grace ""G"" Hopper", g@x.io;h@x.io ,"a, b",,T\r\n\r\nshort\n , ,\nA,a@x.io,+1,Co,Eng,extra,more\n"",,,,\n'
    (tmp_path / "a b+1.csv").write_text("\ufeffName,E-MAIL , Phone,company,Title,title\n" + body * 40, encoding="utf-8")
    (tmp_path / "plain.csv").write_text("x,y\n1,2\n")
    (tmp_path / "none.csv").write_text("")
    good = [f"{tmp_path}/a b+1.csv", f"{tmp_path}/plain.csv", f"{tmp_path}/none.csv"]
    monkeypatch.setattr(delimited, "LARGE_BYTES", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        got = delimited.rows_by_line(spark, good).orderBy("path", "rec_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = delimited.rows(read_files(spark, good)).orderBy("path", "rec_idx").collect()
    drop = lambda rs: [tuple(r)[:1] + tuple(r)[2:] for r in rs]
    assert drop(got) == drop(want) and len(want) == 5 * 40 + 1
    (tmp_path / "odd.csv").write_text('name,email\n"a\nb",x@y.io\n')
    (tmp_path / "latin.csv").write_bytes(b"name,email\nJos\xe9,jose@x.io\n")
    assert delimited.rows_by_line(spark, [f"{tmp_path}/odd.csv", f"{tmp_path}/latin.csv"]).count() == 0
    done = pipeline.run(spark, [*good, f"{tmp_path}/odd.csv"])
    assert set(people(done)) >= {"A"} and done.stats()["input_files"] == 4
    assert [w.rsplit("/", 1)[1] for w in done.warnings()] == ["none.csv (recruiter_csv)", "odd.csv (recruiter_csv)", "plain.csv (recruiter_csv)"]


def test_whole_profile(done, folder):
    """A profile as it follows by hand from one row: trust times certainty for each value, weighted for the whole."""
    made = next(r for r in done.results.collect() if "Katherine" in r.canonical_json)
    source = f"recruiter_csv:{folder}/export.csv"
    confidence = {"full_name": 0.833, "headline": 0.735, "emails": 0.882, "experience": 0.735}
    weights = {"full_name": 3.0, "headline": 1.0, "emails": 3.0, "experience": 1.5}
    assert json.loads(made.canonical_json) == {
        "candidate_id": "cand_" + hashlib.sha1(b"kj@nasa.gov").hexdigest()[:12],
        "full_name": "Katherine Johnson", "emails": ["kj@nasa.gov"], "phones": [], "location": {"city": None, "region": None, "country": None},
        "links": {"linkedin": None, "github": None, "portfolio": None, "other": []}, "headline": "Mathematician", "years_experience": None, "skills": [],
        "experience": [{"company": "NASA", "title": "Mathematician", "start": None, "end": "present", "summary": None}], "education": [],
        "provenance": [{"field": f, "source": source, "method": "csv_column"} for f in ("emails", "experience", "full_name", "headline")],
        "overall_confidence": round(sum(confidence[f] * w for f, w in weights.items()) / sum(weights.values()), 4), "field_confidence": confidence,
    }
    assert json.loads(made.output_json)["full_name"] == "Katherine Johnson" and list(made.validation_errors) == []
