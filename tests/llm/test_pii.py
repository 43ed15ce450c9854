import hashlib
import random
import re

from pyspark.sql import functions as F

from amalgam.llm import pii, queries

from .helpers import awkward, frame

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            g, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in g.split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_against_plain_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.2-@@+ ()9a%3\n5é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_stay_fast():
    for t in ("a" * 200_000, "1" * 200_000, "+" * 100_000, "1." * 100_000, "@" * 100_000, "a@" * 50_000):
        pii.base_spans(t)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


CASES = ["Mail é a.b@x.example.org or +1 (578) 555-6437.", "4111 1111 1111 1111 and 10.0.0.256 and 10.0.0.255", "a@b", "x@y.z@w.v"]


def corpus():
    rows = [(100 + i, f"met us number {i} at the gate, write to Dr Zorgon of Fizzbury zed@mail.example.org for more news") for i in range(6)]
    rows += [(200 + i, f"the gate at number {i} met us for more of the news, write to all {i * i}") for i in range(60)]
    return rows


def test_disclosing_terms_are_found(spark):
    got = {r.doc_id: r for r in pii.find(frame(spark, corpus())).collect()}
    for i, text in corpus():
        words = {text[s.start : s.end]: s.action for s in got[i].spans if s.kind == "term"}
        if i < 200:
            assert words.get("Zorgon") == "remove" and "the" not in words and "write" not in words
            clean = pii.sanitise(text, [tuple(s) for s in got[i].spans])
            assert "Zorgon" not in clean and "zed@" not in clean and "<email>" in clean and "the gate" in clean
        else:
            assert not got[i].spans


def test_query(spark, tmp_path):
    rows = awkward() + [(50 + i, t) for i, t in enumerate(CASES)] + corpus()
    frame(spark, rows).withColumn("spans", F.lit("mine")).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, *(sum(k == kind for k, _, _ in p) for kind in pii.KINDS[:4]), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in p).encode()).hexdigest()) for i, t in rows for p in [plain(t)])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        if r.doc_id and r.doc_id >= 50:
            base = [s for s in r.spans.split(",") if s and not s.startswith("term")]
            assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_copies_do_not_make_terms(spark):
    rows = [(i, "unique hapax words near me@x.example.org stay") for i in range(40)]
    assert all(not [s for s in r.spans if s.kind == "term"] for r in pii.find(frame(spark, rows)).collect())


def test_nothing(spark):
    assert pii.find(frame(spark, [])).count() == 0
    assert pii.sanitise(None, []) is None


def test_entities_of_one_text_have_terms(spark):
    one = "met us number 7 at the gate, write to Dr Zorgon of Fizzbury zed@mail.example.org for more news"
    for copies in (1, 2):
        rows = [(i, one) for i in range(copies)] + [r for r in corpus() if r[0] >= 200]
        got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
        for i in range(copies):
            words = {one[s.start : s.end]: s.action for s in got[i].spans if s.kind == "term"}
            assert words.get("Zorgon") == "remove" and words.get("Fizzbury") == "remove" and "gate" not in words and "news" not in words


def test_terms_far_from_the_entity(spark):
    fill = " ".join(["the gate at number met us for more of the news"] * 5)
    far = f"Dr Zorgon, {fill} zed@mail.example.org {fill} (Zorgon)"
    rows = [(i, far) for i in range(3)] + [(100 + i, f"{fill} to all") for i in range(60)]
    for r in pii.find(frame(spark, rows)).collect():
        places = [(s.start, far[s.start : s.end], s.action) for s in r.spans if s.kind == "term"]
        assert places == ([(3, "Zorgon", "remove"), (far.rindex("Zorgon"), "Zorgon", "remove")] if r.doc_id < 100 else [])
