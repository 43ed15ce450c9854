import hashlib
import math

import pytest
from pyspark.sql import functions as F

from amalgam.llm import mixing

from .helpers import frame

SCHEMA = "doc_id long, source string, text string"


def rows(n=600):
    return [(i, "hot" if i % 3 == 0 else f"s{i % 7}", "x") for i in range(n)] + [(None, None, None), (5000, None, ""), (5000, None, ""), (5001, "one", "y")]


def poisson(rate, key):
    u = int(hashlib.md5(key.encode()).hexdigest()[:12], 16) / 16**12
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u and k < 10_000:
        k += 1
        p *= rate / k
        c += p
    return k


@pytest.mark.parametrize(("targets", "total"), [(None, None), ({"hot": 3.0, "s1": 1.0, "absent": 2.0}, 4000), ({"s2": 1.0}, 90_000)])
def test_counts_against_brute_force(spark, targets, total):
    data = rows()
    got = mixing.copies(frame(spark, data, SCHEMA), targets, total, seed=3).collect()
    n = {}
    for _, s, _ in data:
        n[s] = n.get(s, 0) + 1
    weight = {s: math.sqrt(k) if targets is None else targets.get(s, 0.0) for s, k in n.items()}
    scale = (total or len(data)) / sum(weight.values())
    assert len(got) == len(data)
    for r in got:
        rate = weight[r.source] * scale / n[r.source]
        assert math.isclose(r.rate, rate, rel_tol=1e-12, abs_tol=1e-12)
        parts = max(1, math.ceil(rate / mixing.LARGEST_RATE))
        who = "" if r.doc_id is None else r.doc_id
        assert r.copies == sum(poisson(rate / parts, f"3:{who}:{i}") for i in range(1, parts + 1))


def test_mix_meets_its_weights_and_shuffles(spark):
    df = frame(spark, rows(3000), SCHEMA).withColumns({"copy": F.lit("mine"), "rate": F.lit(None)})
    got = mixing.mix(df, {"hot": 1.0, "s1": 1.0, "s2": 2.0}, 8000).collect()
    share = {}
    for r in got:
        share[r.source] = share.get(r.source, 0) + 1 / len(got)
    assert abs(len(got) - 8000) < 400 and abs(share["hot"] - 0.25) < 0.03 and abs(share["s2"] - 0.5) < 0.03 and set(share) == {"hot", "s1", "s2"}
    keys = [r.shuffle_key for r in got]
    assert len(set(keys)) > 0.999 * len(keys)
    assert abs(sum(a < b for a, b in zip([r.doc_id for r in got], [r.doc_id for r in got][1:], strict=False)) / len(got) - 0.5) < 0.05


def test_nothing(spark):
    assert mixing.mix(frame(spark, [], SCHEMA)).count() == 0
    assert mixing.mix(frame(spark, rows(30), SCHEMA), {"absent": 1.0}).count() == 0
