import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from amalgam.llm import quality, queries
from amalgam.llm.common import utf8, word_hashes, words

from .helpers import SPACE, awkward, frame


def plain(text):
    text = text or ""
    w = re.findall(SPACE, text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered)}


TEXTS = [t for _, t in awkward()] + ["a b c d e\na b c d e\n a b c d e", "#*$%&|<> x", "l\nl\r\nl\n" * 9, "one two three four five one two three four five six", "x" * 5000 + "\n" + "x" * 5000]


def test_measures_against_brute_force():
    got = quality.measure(*utf8(pa.array([t or "" for t in TEXTS])))
    for i, t in enumerate(TEXTS):
        assert {k: int(v[i]) for k, v in got.items()} == plain(t), t[:40] if t else t


def labelled(spark, n=300):
    docs, labels = [], []
    for i in range(n):
        words = [f"{a}{b}" for a, b in zip("abcdefghijklmn", range(i, i + 14), strict=True)]
        bad, toxic = i % 5 == 1, i % 7 == 2
        text = " ".join(f"{w}%%%" if bad else w for w in words) + (" scum loser" if toxic else " fine day")
        docs.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return frame(spark, docs), frame(spark, labels, "doc_id long, quality int, toxic int"), labels


def test_classifier_learns(spark):
    docs, labels, truth = labelled(spark)
    model = quality.fit(docs, labels.where("doc_id < 200"))
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    for i, q, t in truth[200:]:
        assert got[i].kept == (q == 1 and t == 0), (i, q, t, got[i])


def test_awkward_rows(spark):
    docs, labels, _ = labelled(spark)
    model = quality.fit(docs, labels.union(frame(spark, [(None, 0, 0), (3, None, None), (4, 1, 0)], labels.schema)))
    df = frame(spark, awkward()).withColumns({"kept": F.lit("mine"), "n_words": F.lit(-1), "extra": F.lit(7)})
    got = quality.judge(df, model).collect()
    assert len(got) == len(awkward()) and all(r.extra == 7 for r in got)
    for r in got:
        p = plain(r.text)
        assert {k: r[k] for k in p} == p
        assert r.base_failed == (p["n_words"] < 10 or 100 * p["n_repeat_words"] > 20 * p["n_words"])
        assert not (r.base_failed and r.kept)


def test_without_labels(spark):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, " ".join(map(str, range(20)))), (2, "few words")])
    got = {r.doc_id: (r.kept, r.p_toxic) for r in quality.judge(docs, quality.fit(docs, none)).collect()}
    assert got == {1: (True, None), 2: (False, None)}
    assert quality.judge(frame(spark, []), quality.fit(docs, none)).count() == 0
    one_class = frame(spark, [(1, 1, 0), (2, 1, 0)], none.schema)
    assert quality.fit(docs, one_class).toxic is None


def plain_probability(head, text):
    """A head's probability of one text, feature by feature."""
    raw = (text or "").encode()
    start, end, doc = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    h = [int(x) for x in word_hashes(np.frombuffer(raw, np.uint8), start, end)]
    full, shift = (1 << 64) - 1, 64 - quality.FEATURE_BITS
    found = {x >> shift for x in h}
    found |= {((a * 3 + b) * 0xD6E8FEB86659FD93 & full) >> shift for a, b in zip(h, h[1:], strict=False)}
    low = raw.lower()
    found |= {(int.from_bytes(low[i : i + 5], "little") * 0x9E3779B97F4A7C15 & full) >> shift for i in range(len(low) - 4)}
    z = head.bias + sum(float(head.weights[f]) for f in found)
    return 1 / (1 + math.exp(-max(-30, min(30, head.slope * z + head.intercept))))


def test_query_against_brute_force(spark, tmp_path):
    docs, labels, truth = labelled(spark)
    more = [(1000 + i, t) for i, t in enumerate(TEXTS)]
    every = docs.union(frame(spark, more))
    every.write.parquet(str(tmp_path / "documents.parquet"))
    labels.where("doc_id < 250").write.parquet(str(tmp_path / "labels.parquet"))
    model = quality.fit(every, labels.where("doc_id < 250"))
    got = {r.doc_id: r for r in queries.op9_quality(spark, str(tmp_path)).collect()}
    rows = {r.doc_id: r.text for r in every.collect()}
    assert set(got) == set(rows)
    for i, text in rows.items():
        p, r = plain(text), got[i]
        assert {k: r[k] for k in p} == p
        low, toxic = plain_probability(model.low_quality, text), plain_probability(model.toxic, text)
        assert abs(r.p_low_quality - low) < 1e-6 and abs(r.p_toxic - toxic) < 1e-6
        failed = p["n_words"] < 10 or 100 * p["n_repeat_words"] > 20 * p["n_words"]
        assert r.base_failed == failed and r.kept == (not failed and low < quality.LOW_QUALITY_AT and toxic < quality.TOXIC_AT)
    held = [(got[i].kept, q == 1 and t == 0) for i, q, t in truth[250:]]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_fit_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels, _ = labelled(spark, 60)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 500)
    seen = []
    real = quality.features
    monkeypatch.setattr(quality, "features", lambda raw, offsets: seen.append(len(raw)) or real(raw, offsets))
    quality.fit(docs, labels)
    assert 0 < sum(seen) <= 500
