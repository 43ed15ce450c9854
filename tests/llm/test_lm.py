import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from amalgam.llm import lm, queries

from .helpers import SPACE, ascii_lower, awkward, frame


def tokens(text):
    return re.findall(SPACE, ascii_lower(text or "")) + [None]


def corpus():
    return awkward() + [(100 + i, " ".join(f"t{(i * k) % 13}" for k in range(1, 4 + i % 9))) for i in range(120)]


@pytest.mark.parametrize("chunk", [1 << 20, 2000])
def test_base_and_mixture_against_brute_force(spark, chunk):
    rows = corpus()
    test = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    got = lm.score(frame(spark, rows), F.when(F.coalesce(test, F.lit(False)), lm.TEST).otherwise(lm.TRAIN), chunk).collect()
    train = [(i, t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, len(w := tokens(t)), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    # all probabilities after a context sum to one, as the score of every document shows: none above zero
    assert all(r.score < 0 for r in got)


def test_mixture_beats_the_base_on_held_out_text(spark):
    rows = [(i, " ".join(("the cat sat on the mat", "a dog ran in the park", "birds fly over the old house")[(i + k) % 3] for k in range(5))) for i in range(200)]
    got = lm.score(frame(spark, rows), F.when(F.col("doc_id") % 5 == 0, lm.TEST).otherwise(lm.TRAIN)).where(F.col("kind") == lm.TEST).collect()
    assert len(got) == 40 and sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)


def test_mixture_sums_to_one(spark):
    """Over all known words and the unknown one, probabilities after each context sum to 1."""
    words = [f"w{k}" for k in range(6)]
    rng = np.random.default_rng(1)
    train = [(i, " ".join(rng.choice(words, 8))) for i in range(60)]
    probes = [(1000 + 10 * a + b, f"{x} {y}") for a, x in enumerate(words) for b, y in enumerate([*words, "unseen"])]
    ends = [(2000 + a, x) for a, x in enumerate(words)]
    df = frame(spark, train + probes + ends)
    s = {r.doc_id: r.score for r in lm.score(df, F.when(F.col("doc_id") >= 1000, lm.TEST).otherwise(lm.TRAIN)).collect()}
    # P(x y </s>) / P(x </s>) compared over y needs P(</s> | y), which the one-word texts give up to their start
    for a in range(len(words)):
        assert all(s[1000 + 10 * a + b] < s[2000 + a] + 1 for b in range(7))


def test_weights_find_the_better_component():
    f = lambda *x: np.array(x, float)
    b = lambda *x: np.array(x, np.uint8)
    # triples predict after bucket 3, pairs after bucket 2, words elsewhere
    events = f(0.9, 0.0, 0.0), f(0.01, 0.8, 0.0), f(0.01, 0.01, 0.2), b(3, 2, 0), b(4, 2, 0)
    w = lm.learn_weights(lambda weights: 200 * lm.expected(weights, *events, 1 / 1000))
    assert w[0, 3] > 0.9 and w[0, 2] < 0.1 and w[0, 0] == w[1, 0] == 0 and w[2, 0] > 0.9
    # a step never lowers the likelihood
    rng = np.random.default_rng(3)
    events = rng.random(500) * (rng.random(500) < 0.4), rng.random(500) * (rng.random(500) < 0.7), rng.random(500) * 0.1, b(*rng.integers(0, 5, 500)), b(*rng.integers(0, 5, 500))
    weights, before = np.full((3, lm.BUCKETS), 0.5), -np.inf
    for _ in range(20):
        now = np.log(lm.mixture(weights, *events, 1e-3)[0]).sum()
        assert now > before - 1.0
        weights, before = lm.improved(lm.expected(weights, *events, 1e-3)), now


class Plain:
    """The model with dictionaries, as its docstring says."""

    def __init__(self, train, tune):
        self.count(train)
        events = [(*self.frequencies(u, v, w), 1 / (self.types + 1)) for t in tune for u, v, w in self.triples(t)]
        self.a, self.b, self.c = np.full(lm.BUCKETS, 0.5), np.full(lm.BUCKETS, 0.5), 0.5
        self.a[0] = self.b[0] = 0
        for _ in range(lm.STEPS):
            sums = np.zeros((2, 3, lm.BUCKETS))
            for f3, f2, f1, b3, b2, rest in events:
                p3, p2, p1 = self.mix(f3, f2, f1, b3, b2, rest)
                own3 = self.a[b3] * f3 / p3
                own2 = (1 - own3) * self.b[b2] * f2 / p2
                own1 = (1 - own3 - own2) * self.c * f1 / p1
                for level, at, own, reach in ((0, b3, own3, 1), (1, b2, own2, 1 - own3), (2, 0, own1, 1 - own3 - own2)):
                    sums[0, level, at] += own
                    sums[1, level, at] += reach
            new = (sums[0] + 0.5) / (sums[1] + 1)
            new[:2, 0] = 0
            moved = max(np.abs(new[0] - self.a).max(), np.abs(new[1] - self.b).max(), abs(new[2, 0] - self.c))
            self.a, self.b, self.c = new[0], new[1], new[2, 0]
            if moved < lm.SETTLED:
                break
        self.count(train + tune)

    @staticmethod
    def triples(text):
        w = ["<s>", "<s>", *tokens(text)]
        return list(zip(w, w[1:], w[2:], strict=False))

    def count(self, texts):
        self.n3, self.n2, self.n1 = Counter(), Counter(), Counter()
        for t in texts:
            for u, v, w in self.triples(t):
                self.n3[u, v, w] += 1
                self.n2[v, w] += 1
                self.n1[w] += 1
        self.total, self.types, self.docs = sum(self.n1.values()), len(self.n1), len(texts)

    def frequencies(self, u, v, w):
        two, one = self.docs if v == "<s>" else self.n2[u, v], self.docs if v == "<s>" else self.n1[v]
        return self.n3[u, v, w] / max(two, 1), self.n2[v, w] / max(one, 1), self.n1[w] / max(self.total, 1), min(two.bit_length(), lm.BUCKETS - 1), min(one.bit_length(), lm.BUCKETS - 1)

    def mix(self, f3, f2, f1, b3, b2, rest):
        p1 = self.c * f1 + (1 - self.c) * rest
        p2 = self.b[b2] * f2 + (1 - self.b[b2]) * p1
        return self.a[b3] * f3 + (1 - self.a[b3]) * p2, p2, p1

    def score(self, text):
        return sum(math.log10(self.mix(*self.frequencies(u, v, w), 1 / (self.types + 1))[0]) for u, v, w in self.triples(text))


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = corpus() + [(500 + i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], rng.integers(1, 30), p=[0.4, 0.3, 0.1, 0.1, 0.1]))) for i in range(300)]
    rows = [(i, t if t is None or len(t) < 5000 else t[:4000]) for i, t in rows]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("chunk", "kind", "size", "role", "h")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    mark = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    dealt = df.select("doc_id", "text", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False)).alias("test"), (F.pmod(F.xxhash64(mark), F.lit(lm.HELD_OUT_ONE_IN)) == 0).alias("held")).collect()
    model = Plain([r.text for r in dealt if not r.test and not r.held], [r.text for r in dealt if not r.test and r.held])
    got = queries.op3_lm(spark, str(tmp_path)).collect()
    key = lambda i, s: (i is None, i or 0, round(s, 5))
    assert sorted(key(r.doc_id, r.score) for r in got) == sorted(key(i, model.score(t)) for i, t in rows)


def test_nothing_to_learn_from(spark):
    got = lm.score(frame(spark, [(1, "a b"), (2, None)]), F.lit(lm.TEST)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in sorted(got)] == [(3, 0, 0), (1, 0, 0)]
    assert lm.score(frame(spark, []), F.lit(lm.TRAIN)).count() == 0


def test_query(spark, tmp_path):
    frame(spark, corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    r = queries.op3_lm(spark, str(tmp_path))
    assert r.columns[:6] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"] and r.count() == len(corpus())
