import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from amalgam.llm import queries, suffix

from .helpers import awkward, frame


def test_suffix_array_and_common_prefixes():
    rng = random.Random(5)
    for _ in range(150):
        pieces = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        lengths = np.array([len(p) for p in pieces])
        first = np.concatenate([[0], np.cumsum(lengths + 1)])
        symbols = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8).astype(np.uint16) + 1
        symbols[first[1:] - 1] = 0
        stop = np.repeat(first[1:] - 1, lengths + 1)
        sa, _ = suffix.suffix_array(symbols, stop)
        assert list(sa) == sorted(range(len(symbols)), key=lambda i: [*symbols[i : stop[i]].astype(int), int(stop[i]) - len(symbols)])
        shared = suffix.common_prefixes(symbols, sa)
        for k in range(1, len(sa)):
            a, b, n = sa[k - 1], sa[k], 0
            while a + n < stop[a] and b + n < stop[b] and symbols[a + n] == symbols[b + n]:
                n += 1
            assert shared[k] == n


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - 49) if i is not None else ():
            w = t[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 49) if i is not None else ():
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i is None, i or 0, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def documents():
    rng = random.Random(3)
    words = ["alpha", "béta", "gamma", "delta", "x", "of", "the"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(n))
    passage, other = text(60), text(15)
    rows = [(i, text(rng.randint(1, 80))) for i in range(40)]
    rows += [(100 + i, f"{text(20)} {passage if i % 2 else other} {text(20)} {other}") for i in range(30)]
    rows += [(200 + i, passage[:1] * (49 + i)) for i in range(4)] + [(300, passage + passage), (301, passage), (302, passage[:200] + "!" + passage[200:])]
    return rows + awkward() + [(400 + i, "same text, long enough to be longer than fifty bytes in all") for i in range(20)]


@pytest.mark.parametrize(("chunk", "shard"), [(suffix.CHUNK_BYTES, suffix.SHARD_BYTES), (4000, 1500), (800, 300)])
def test_removal_against_brute_force(spark, chunk, shard):
    rows = documents()
    rows = [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in rows]
    got = suffix.digest(suffix.repeated_strings(frame(spark, rows), False, chunk, shard)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def test_kept_text(spark):
    p = "0123456789" * 6
    rows = [(1, p), (2, f"ab {p} cd")]
    got = {r.doc_id: bytes(r.kept) for r in suffix.repeated_strings(frame(spark, rows), True).collect()}
    assert got == {1: p.encode(), 2: b"ab  cd"}


def test_nothing(spark):
    assert suffix.digest(suffix.repeated_strings(frame(spark, []))).count() == 0
    assert suffix.digest(suffix.repeated_strings(frame(spark, [(1, None), (2, "")]))).count() == 2


def test_frequent_short_texts_stay(spark):
    rows = [(i, "x" * n) for i in range(60) for n in (0, 20, 49, 50)]
    got = suffix.digest(suffix.repeated_strings(frame(spark, rows), False, 800, 300)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 900)
    monkeypatch.setattr(suffix, "RANGE_KEYS", 200)
    monkeypatch.setattr(suffix, "FEW_RANGES", 3)
    rows = [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in documents()] + [(700 + i, "y" * 20) for i in range(60)] + [(800 + i, "z" * 49) for i in range(60)] + [(900, "y" * 70), (901, "y" * 70 + "z")]
    rows += [(1000, "q" * 2000), (1001, "q" * 333), (1002, "ab" * 400), (1003, "ba" * 300)]
    frame(spark, rows).withColumn("h", F.lit("mine")).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_suffix(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def test_equal_hashes_are_told_apart():
    """Strings with one first hash are sorted, made distinct and looked up by the second one."""
    h, h2 = np.array([5, 5, 2, 5, 9, 5], np.uint64), np.array([7, 3, 1, 7, 0, 4], np.uint64)
    a, b, order, begins = suffix.distinct(h, h2)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 1), (5, 3), (5, 4), (5, 7), (9, 0)] and begins.tolist() == [0, 1, 2, 3, 5]
    assert suffix.look_up(a, b, np.array([5, 5, 9, 5], np.uint64), np.array([7, 3, 0, 4], np.uint64)).tolist() == [3, 1, 4, 2]
