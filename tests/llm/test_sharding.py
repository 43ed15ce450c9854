import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from amalgam.llm import queries, sharding

from .helpers import awkward, frame


def plain_jump(key, shards):
    b, j, key = -1, 0, key % (1 << 64)
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_against_plain_loop():
    keys = [0, 1, 2, 10**6, -1, -(2**63), 2**63 - 1, *range(1000, 1300)]
    for shards in (1, 2, 16, 17, 1000):
        got = sharding.jump_hash(np.array(keys, np.int64).view(np.uint64), shards)
        assert got.tolist() == [plain_jump(k, shards) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20_000, dtype=np.int64).view(np.uint64)
    a, b = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert (b[a != b] == 16).all() and abs((a != b).mean() - 1 / 17) < 0.01


@pytest.mark.parametrize("rows", [awkward(), [(3, "x")] * 50, []])
def test_slots_are_gapless(spark, rows):
    df = frame(spark, rows).withColumns({"shard": F.lit(99), "extra": F.lit("e")})
    got = sharding.assign_shards(df, 4).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.shard == plain_jump(r.doc_id or 0, 4) and r.grown_shard == plain_jump(r.doc_id or 0, 5) and r.extra == "e"
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_bad_count(spark):
    with pytest.raises(ValueError, match="at least 1"):
        sharding.assign_shards(frame(spark, awkward()), 0)


def test_query(spark, tmp_path):
    rows = awkward()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_sharding(spark, str(tmp_path)).collect()
    size = sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got)
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert size == want and {r.law for r in got} == {"key"}
