import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from amalgam.llm import queries
from amalgam.llm.common import words, utf8

from .helpers import awkward, frame
from .test_quality import labelled


def test_stages_take_effect(spark, tmp_path):
    docs, labels, truth = labelled(spark, 200)
    item = "which of the seven wizards boxed quietly while the lazy dog jumped over a fence"
    fixed = [(1000, f"a clean beginning of ten words or more then {item} and a clean end"), (1001, " ".join(f"copy{i}" for i in range(40))), (1002, " ".join(f"copy{i}" for i in range(40)))]
    every = docs.union(frame(spark, fixed)).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    every.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    frame(spark, [(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, df = {}, every
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path)).persist()
        seen[name] = {r.doc_id for r in df.select("doc_id").collect()}
        if name != "tokens":
            assert df.columns == every.columns
    good = {i for i, q, t in truth if q == 1 and t == 0}
    assert seen["quality"] >= good | {1000, 1001, 1002} and not seen["quality"] & {i for i, q, t in truth if not (q == 1 and t == 0)}
    assert 1001 in seen["simhash"] and 1002 not in seen["simhash"]
    assert seen["simhash"] - seen["decontamination"] == {1000}
    assert seen["mixing"] <= seen["decontamination"] and seen["tokens"] == seen["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == df.count()


def test_registry():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]


def test_words_of_a_buffer():
    import pyarrow as pa

    raw, offsets = utf8(pa.array(["skipped", "a b", "c", "", " d\u3000e "]).slice(1))
    start, end, doc = words(raw, offsets)
    assert [bytes(raw[s:e]).decode() for s, e in zip(start, end, strict=True)] == ["a", "b", "c", "d\u3000e"]
    assert np.array_equal(doc, [0, 0, 1, 3])


def test_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, blanks, repeated rows and further columns go through all stages; empty tables give an empty result."""
    names = ("copy", "rate", "copies", "h", "h2", "n", "kept", "shuffle_key", "sign", "c0", "p_toxic_")
    rows = awkward() + [(100 + i, " ".join(f"word{i}x{k}" for k in range(30))) for i in range(20)]
    every = frame(spark, rows).withColumns({"lang": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") % 2 == 0, "s"), "n_chars": F.lit(None).cast("long"), **{n: F.lit(f"mine {n}") for n in names}})
    for part, docs in (("some", every), ("none", every.limit(0))):
        at = tmp_path / part
        docs.write.parquet(str(at / "documents.parquet"))
        frame(spark, [], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        frame(spark, [(None, None), (1, "")], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        df = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(at))
            assert df.columns == docs.columns, name
        assert all(r[n] == f"mine {n}" for r in df.collect() for n in names)
        got = corpus_pipeline.run(spark, str(at)).collect()
        assert (len(got) > 5) == (part == "some") and all(r.n_tokens >= 1 for r in got)
