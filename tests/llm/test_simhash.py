import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from amalgam.llm import queries, simhash
from amalgam.operators.components import connected_components

from .helpers import SPACE, ascii_lower, awkward, frame


def plain_print(text):
    w = re.findall(SPACE, ascii_lower(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, most):
    u = sorted(set(prints))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in u}


def clusters(seed, n=12, size=25):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 1 << 63, n, dtype=np.uint64):
        for _ in range(size):
            out.append(int(c))
            c ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
            c ^= np.uint64(1) << np.uint64(rng.integers(0, 64)) if rng.random() < 0.7 else np.uint64(0)
            c ^= np.uint64(1) << np.uint64(rng.integers(0, 64)) if rng.random() < 0.3 else np.uint64(0)
    return sorted(set(out))


@pytest.mark.parametrize(("hot", "most"), [(256, 2), (3, 2), (256, 3), (4, 3), (256, 0), (256, 1), (2, 1)])
def test_links_lose_nothing(spark, monkeypatch, hot, most):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    prints = clusters(hot + most, size=12 if most == 3 else 25)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    got = {r.node: r.component for r in connected_components(simhash.links(df, most)).collect()}
    sets = {}
    for s, p in zip(signed, prints, strict=True):
        sets.setdefault(got.get(s, s), set()).add(p)
    want = {}
    for p, r in plain_components(prints, most).items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, want.values()))


def test_allocation_is_unequal_where_that_is_cheaper():
    sample = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    for total in (1000, 10**6, 10**10):
        masks, thresholds = simhash.plan(sample, total, 2)
        assert sum(thresholds) == 2 - len(masks) + 1 and sum(m.bit_count() for m in masks) == 64
        assert not any(a & b for i, a in enumerate(masks) for b in masks[:i])
    assert sorted(simhash.plan(sample, 10**10, 2)[1]) == [0, 1]


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (2000, 64))
    bits[:, 40:44] = bits[:, :1]
    sample = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()
    mask = next(m for m in simhash.group_bits(sample, 3) if m & 1)
    assert all(mask >> b & 1 for b in (40, 41, 42, 43))


def near_copies():
    base = " ".join(f"word{i} and" for i in range(400))
    return [(60, base), (61, base.replace("word7 ", "Word7 ")), (62, base + " end"), (63, base.replace("word9 ", "other "))]


def test_query(spark, tmp_path):
    rows = awkward() + near_copies()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_simhash(spark, str(tmp_path)).collect()
    prints = {i: plain_print(t) for i, t in rows}
    roots = plain_components(prints.values(), 2)
    first = {}
    for i, p in prints.items():
        if i is not None:
            first[roots[p]] = min(first.get(roots[p], i), i)
    assert len(got) == len(rows)
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == first.get(roots[prints[r.doc_id]])


def test_deduplicate_keeps_one(spark):
    rows = awkward() + near_copies()
    df = frame(spark, rows).withColumns({"fingerprint": F.lit("mine"), **{c: F.lit(1) for c in ("key", "h", "h2", "n", "kept_id", "KEPT_H", "kept_rows", "_n", "_key", "a.b")}})
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    prints = {(i, t): plain_print(t) for i, t in rows}
    roots = plain_components(prints.values(), 2)
    want = {}
    for (i, t), p in prints.items():
        want.setdefault(roots[p], []).append(i)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(min((i is None, i or 0) for i in ids) for ids in want.values())


def test_nothing(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.deduplicate(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, [(4, None), (3, "")])).select("component_id").distinct().collect()[0][0] == 3


# ------------------------------------------------------------------ copies by similarity
def shingles(text):
    w = re.findall(SPACE, ascii_lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited(rng, words, share):
    return " ".join("changed" + str(rng.integers(10**6)) if rng.random() < share else w for w in words)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    base = [f"word{rng.integers(10**5)}" for _ in range(600)]
    for share in (0.0, 0.01, 0.03, 0.1):
        pair = [" ".join(base), edited(rng, base, share)]
        raw = [t.encode() for t in pair]
        _, _, signs = simhash.sketches(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]))
        true = len(shingles(pair[0]) & shingles(pair[1])) / len(shingles(pair[0]) | shingles(pair[1]))
        guess = ((signs[0] == signs[1]) & (signs[0] > 0)).sum() / ((signs > 0).any(axis=0)).sum()
        assert abs(true - guess) < 0.08


@pytest.mark.parametrize("block", [2048, 6])
def test_copies_go_and_others_stay(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, want = [], []
    for c in range(12):
        base = [f"w{rng.integers(10**6)}x" for _ in range(300)]
        rows += [(100 * c + 10, " ".join(base)), (100 * c + 11, " ".join(base)), (100 * c + 12, edited(rng, base, 0.006)), (100 * c + 13, edited(rng, base, 0.008))]
        rows += [(100 * c + 20, edited(rng, base, 0.25))]  # far below the threshold
        want += [100 * c + 10, 100 * c + 20]
    df = frame(spark, rows + awkward()).withColumns({"sign": F.lit("mine"), **{c: F.lit(1) for c in ("id", "h", "h2", "first", "n", "kept_id", "kept_h2", "_n", "_key")}})
    kept = simhash.drop_copies(df)
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id >= 10)
    assert got == want
    # equal texts of the awkward rows are one, blank ones too
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 10) == [1, 2, 5, 8, 9]


def test_short_texts_and_nothing(spark):
    assert simhash.drop_copies(frame(spark, [])).count() == 0
    rows = [(1, "one two"), (2, "ONE  two"), (3, "one two three"), (4, "x"), (5, None), (6, " ")]
    assert sorted(r.doc_id for r in simhash.drop_copies(frame(spark, rows)).collect()) == [1, 3, 4, 5]


def altered(rng, n):
    """Pairs whose similarity is 0.8 or little more: a copy with words appended, a truncated one, one with an end word changed, one with a passage replaced."""
    base = [f"word{rng.integers(10**5)}" for _ in range(n)]
    more = [f"word{rng.integers(10**5)}" for _ in range(n)]
    k = max(1, (n - 4) // 4)
    yield base, base + more[:k]
    yield base, base[: n - (n - 4) // 5]
    yield base, [*base[:-1], "other"]
    at, k = n // 3, max(1, (n - 4) // 9 - 4)
    yield base, base[:at] + more[:k] + base[at + k :]


def test_bands_hold_similar_texts(spark):
    rng = np.random.default_rng(6)
    met, lost, rows = 0, 0, []
    for n in (6, 9, 14, 20, 40, 100, 400, 1500):
        for _ in range(40 if n < 400 else 10):
            for pair in altered(rng, n):
                a, b = (shingles(" ".join(p)) for p in pair)
                if len(a & b) / len(a | b) >= simhash.COPY_SIMILARITY:
                    raw = [" ".join(p).encode() for p in pair]
                    keys, live, _ = simhash.sketches(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
                    met += 1
                    lost += not (live[0] & live[1] & (keys[0] == keys[1])).any()
    assert met > 500 and lost == 0
    for c in range(40):
        base = [f"word{rng.integers(10**5)}" for _ in range(100)]
        rows += [(2 * c, " ".join(base)), (2 * c + 1, " ".join([*base, *(f"more{rng.integers(10**5)}" for _ in range(15))]))]
    assert sorted(r.doc_id for r in simhash.drop_copies(frame(spark, rows)).collect()) == list(range(0, 80, 2))


def test_similarity_is_exact_near_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows, want = [], []
    for c in range(120):
        base = [f"word{rng.integers(10**6)}" for _ in range(304)]
        # 300 shingles and as many more as leave 0.8 exactly or just miss it
        more = [f"more{rng.integers(10**6)}" for _ in range(75 + c % 2)]
        assert (len(shingles(" ".join(base))) / len(shingles(" ".join(base + more))) >= 0.8) == (c % 2 == 0)
        rows += [(2 * c, " ".join(base)), (2 * c + 1, " ".join(base + more))]
        want += [2 * c, 2 * c + 1] if c % 2 else [2 * c]
    assert sorted(r.doc_id for r in simhash.drop_copies(frame(spark, rows)).collect()) == want


def plain_classes(texts):
    """The smallest place of each text's class, by comparing all pairs of shingle sets."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= simhash.COPY_SIMILARITY:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize(("block", "named"), [(2048, 4), (16, 1)])
def test_large_group_of_uncertain_pairs(spark, monkeypatch, block, named):
    """Copies of one text with a similarity to each other around the threshold, and a few texts in common with many: exact classes, few pairs verified."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "NAMED", named)
    monkeypatch.setattr(simhash, "LARGE", block // 2)
    checked = []
    real = simhash.verified

    def counted(pairs, *rest):
        checked.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "verified", counted)
    rng = np.random.default_rng(12)
    texts = []
    for c in range(3):
        base = [f"w{c}x{rng.integers(10**6)}" for _ in range(120)]
        texts += [edited(rng, base, share) for share in np.linspace(0.005, 0.045, 60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    kept = simhash.drop_copies(frame(spark, rows))
    want = sorted({r for r in plain_classes(texts)})
    assert sorted(r.doc_id for r in kept.collect()) == want
    print(len(want), checked)
    assert 3 < len(want) < 120 and sum(checked) < 3 * 60 * 59 / 2


def test_signatures_are_compared_in_two_turns(spark, monkeypatch):
    """Texts with many uncertain pairs list them once; verifying more of them needs no further turn over signatures, and classes are exact."""
    monkeypatch.setattr(simhash, "LARGE", 8)
    monkeypatch.setattr(simhash, "NAMED", 1)
    monkeypatch.setattr(simhash, "MORE", 4)
    turns, real = [], simhash.found_links
    monkeypatch.setattr(simhash, "found_links", lambda *a: turns.append(1) or real(*a))
    rng = np.random.default_rng(12)
    base = [f"wx{rng.integers(10**6)}" for _ in range(120)]
    texts = [edited(rng, base, share) for share in np.linspace(0.005, 0.045, 40)]
    kept = simhash.drop_copies(frame(spark, list(enumerate(texts))))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_classes(texts))) and len(turns) == 2


def test_fingerprints_link_copies(spark):
    """Texts link whose fingerprints are near, however few of their distinct five-word shingles they share, and classes go on through similar texts."""
    rng = np.random.default_rng(14)
    fresh = lambda n: " ".join(f"w{rng.integers(10**6)}" for _ in range(n))
    rows, want = [], []
    for c in range(10):
        line, tail, own = "alpha beta gamma" + str(c) + " ", fresh(30), fresh(30)
        # 0 and 1 have near fingerprints and different ends, 2 is similar to 1, and 3 is a text of its own
        rows += [(10 * c, line * 40 + own), (10 * c + 1, line * 40 + tail), (10 * c + 2, line * 12 + tail + " end"), (10 * c + 3, fresh(60))]
        want += [10 * c, 10 * c + 3]
    for c in range(10):
        a, b, d, _ = (t for _, t in rows[4 * c : 4 * c + 4])
        assert (plain_print(a) ^ plain_print(b)).bit_count() <= 2 and len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.5
        assert len(shingles(b) & shingles(d)) / len(shingles(b) | shingles(d)) >= simhash.COPY_SIMILARITY
    assert sorted(r.doc_id for r in simhash.drop_copies(frame(spark, rows)).collect()) == want


def test_signatures_use_all_bins():
    raw = " ".join(f"word{i}" for i in range(20_000)).encode()
    keys, live, signs = simhash.sketches(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert (signs > 0).all() and signs.shape == (1, simhash.BINS) and live.all() and keys.shape == (1, 43)
