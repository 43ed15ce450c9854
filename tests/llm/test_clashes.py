"""Every operator on a table that has its internal names, and those of its results, as further columns; and what operators leave behind."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from amalgam.llm import decontam, lm, mixing, pii, quality, sharding, simhash, suffix, tokenout, urls
from amalgam.operators import components

from .helpers import awkward, frame

FOLDER = Path(simhash.__file__).parent


def names():
    """Every quoted name of the operators' sources, and each with underscores before it."""
    found = set()
    for p in FOLDER.glob("*.py"):
        found |= set(re.findall(r"\"(_?[a-z][a-z0-9_]{0,20})\"", p.read_text()))
    return sorted(found - {"doc_id", "text", "url", "source"})


def crowded(df):
    extra = names()
    more = [*extra, *(f"_{n}" for n in extra if f"_{n}" not in extra), "a.b", "A`b"]
    return df.withColumns({n: F.lit(f"mine {n}") for n in more if n.lower() not in {c.lower() for c in df.columns}})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s1" if i and i % 2 else "s2") for i, t in awkward()]
    return crowded(frame(spark, rows, "doc_id long, text string, source string"))


def intact(before, after, results=()):
    """All columns of before but those named like results are there with their values."""
    same = [c for c in before.columns if c not in results]
    assert set(same) <= set(after.columns)
    row = after.first()
    assert all(row[c] == f"mine {c}" for c in same if c not in ("doc_id", "text", "url", "source"))


def test_operators_that_keep_columns(spark, docs):
    assert len(names()) > 150
    sharded = sharding.assign_shards(docs, 3)
    intact(docs, sharded, ("shard", "slot", "grown_shard"))
    assert sorted(r.slot for r in sharded.where("shard = 0").select("slot").collect()) == list(range(sharded.where("shard = 0").count()))
    mixed = mixing.mix(docs, rows=40, seed=1)
    intact(docs, mixed, ("rate", "copies", "copy", "shuffle_key"))
    for kept in (simhash.drop_copies(docs), simhash.deduplicate(docs), decontam.clean(docs, frame(spark, [(1, "hello world")], "item_id long, text string"))):
        assert kept.columns == docs.columns and kept.count() > 0
        intact(docs, kept)
    judged = quality.judge(docs, quality.QualityModel(None, None))
    intact(docs, judged, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_low_quality", "p_toxic", "kept"))
    pages = docs.withColumnRenamed("text", "url")
    found = urls.judge(pages, [urls.Rule("block", "com/en/")], urls.train([], None))
    intact(pages.drop("text"), found, ("host", "path", "rule", "rule_verdict", "p_block", "verdict"))


def test_operators_with_columns_of_their_own(spark, docs):
    n = docs.count()
    assert pii.find(docs).count() == n and suffix.repeated_strings(docs).count() == n and simhash.near_duplicates(docs).count() == n
    assert lm.score(docs, F.lit(lm.TRAIN)).count() == n
    assert decontam.find_leaks(docs, crowded(frame(spark, [(1, "hello world hello world")], "item_id long, text string"))).count() > 0
    model = quality.fit(docs, crowded(frame(spark, [(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")))
    assert model is not None


def test_settings_and_tables(spark, docs, tmp_path):
    """Building or running one operator changes no setting of the session, so what runs after it is as it would be alone."""
    before = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    first = quality.judge(docs, quality.QualityModel(None, None)).select("kept")
    for built in (lm.score(docs, F.lit(lm.TRAIN)), suffix.repeated_strings(docs), simhash.drop_copies(docs), pii.find(docs)):
        built.count()
    after = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    ours = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}
    assert {k: v for k, v in after.items() if before.get(k) != v and ours.get(k) != v} == {}
    assert first.count() == docs.count()
    path = components.scratch(spark, "test")
    docs.select("doc_id").write.parquet(path)
    components.clear(spark)
    assert not Path(path.removeprefix("file:").removeprefix("//")).exists()
