import random
import time

from pyspark.sql import functions as F

from amalgam.llm import decontam, queries

from .helpers import awkward, frame


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, e in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


def test_matcher_against_dynamic_programming():
    rng = random.Random(0)
    for _ in range(1500):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 80)))
        if rng.random() < 0.6:
            q = list(p)
            for _ in range(rng.randint(0, 8)):
                i = rng.randrange(len(q) + 1)
                q[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
            t = t[:30] + "".join(q) + t[30:]
        want, k = distance(p, t), int(len(p) * 0.15)
        assert decontam.myers(decontam.character_masks(p), len(p), t)[0] == want
        found = decontam.Matcher([(7, p)], 0.15).find(t)
        assert (found[0][1] == want if want <= k else not found), (p, t)


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly box"


def test_leaks_and_clean(spark):
    rows = [*awkward(), (20, f"Before. {ITEM.upper()}!! after"), (21, f"x {ITEM.replace('quick', 'quikc').replace('lazy', 'lzy')} y"), (22, ITEM[:40]), (23, "the fox and the dog")]
    bench = frame(spark, [(1, ITEM), (2, "short"), (3, None), (None, ITEM), (1, ITEM)], "item_id long, text string")
    docs = frame(spark, rows).withColumn("distance", F.lit("mine"))
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(docs, bench).collect())
    assert [g[:2] for g in got] == [(20, 1), (21, 1)] and got[0][2] == 0 and 0 < got[1][2] <= 7
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 2 and not {20, 21} & {r.doc_id for r in kept.collect()}


def test_blocks_of_items_cover_all(spark, monkeypatch):
    items = [(i, f"item number {i} speaks of subject {i * 7919} and then of nothing else {i * 31}") for i in range(40)]
    docs = frame(spark, [(i, f"prefix {t} suffix") for i, t in items])
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 500)
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, frame(spark, items, "item_id long, text string"), 0.0).collect()}
    assert {(i, i) for i, _ in items} <= found


def test_nothing(spark):
    none = frame(spark, [], "item_id long, text string")
    assert decontam.find_leaks(frame(spark, awkward()), none).count() == 0
    assert decontam.clean(frame(spark, []), frame(spark, [(1, ITEM)], "item_id long, text string")).count() == 0


def test_repetitive_texts_take_linear_time():
    matcher = decontam.Matcher([(1, "a" * 200 + "b")], short=decontam.SHORT_CHARS)
    took = time.process_time()
    assert matcher.find("a" * 100_000)[0][1] == 1
    assert time.process_time() - took < 2
    # the first half of an item, time and again, and passages of its pieces alone
    item = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    took = time.process_time()
    assert not decontam.Matcher([(1, item)]).find((item[: len(item) // 2] + " and ") * 60)
    assert time.process_time() - took < 5


def test_short_items_are_whole_words(spark):
    items = [(1, "cat"), (2, "Hot dog!"), (3, "x"), (4, "日本語"), (None, "null id"), (5, "?!")]
    rows = [(1, "A cat sat"), (2, "concatenate"), (3, "the hot, dog"), (4, "hot dogs"), (5, "x"), (6, "これは日本語です"), (7, "a null-id here"), (8, ""), (None, "cat")]
    bench = frame(spark, items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(frame(spark, rows), bench).collect()}
    assert got == {(1, 1, 0), (3, 2, 0), (5, 3, 0), (6, 4, 0), (7, None, 0), (None, 1, 0)}
    assert {r.doc_id for r in decontam.clean(frame(spark, rows), bench).collect()} == {2, 4, 8}


def test_query_against_dynamic_programming(spark, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "of", "the"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(25)]
    rows = awkward()[:5] + awkward()[7:]
    for i in range(120):
        text = list(rng.choice(items)[1] if i % 3 else " ".join(rng.choice(words) for _ in range(30)))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "t", " "])
        rows.append((1000 + i, f"start. {''.join(text)} END"))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = []
    for doc_id, text in rows:
        t = decontam.normalise(text)
        for item_id, item in items:
            p = decontam.normalise(item)
            if len(p) < decontam.SHORT_CHARS:
                d = 0 if f" {p} " in f" {t} " else None
            else:
                d = distance(p, t)
                d = d if d <= int(len(p) * decontam.RATIO) else None
            if d is not None:
                want.append((doc_id is None, doc_id or 0, item_id, d))
    got = [(r.doc_id is None, r.doc_id or 0, r.item_id, r.distance) for r in queries.op4_decontam(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 60
