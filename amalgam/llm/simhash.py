"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints within `most` differing bits are found by cutting the 64 bits into
partitions with thresholds that sum to most - partitions + 1: two such fingerprints
are within its threshold in one partition at least. Correlated bits share a partition,
so the others tell more apart. Thresholds, unequal if that is cheaper, come from
dynamic programming over the rows to look at that a bounded sample predicts.
"""

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import columns, free, lean, mix64, smallest, split_batches, stored, utf8, word_hashes, words

#: Distinct fingerprints (those with the smallest hashes) that bit correlation and candidate counts are estimated on.
SAMPLE = 4000
#: Most partitions that are tried.
MOST_PARTITIONS = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A bucket with more entries is linked through midpoints, without comparing its members.
HOT_BUCKET = 256


def fingerprint(raw: bytes, shingle: int) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    tokens = raw.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), 42)]
    else:
        joined = b" ".join(tokens)
        lengths = [len(t) for t in tokens]
        starts = list(itertools.accumulate((n + 1 for n in lengths[:-1]), initial=0))
        ends = [s + n for s, n in zip(starts[shingle - 1 :], lengths[shingle - 1 :], strict=True)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends)]  # noqa: B905
    h = np.array(hashes, np.uint64)
    count = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[lo : lo + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def text_keys(text: Column) -> list[Column]:
    """h and h2: two hashes of a text, which stand for it. Of 10^12 texts no two share both."""
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2")]


def fingerprints(documents: DataFrame, shingle: int = 3, keyed: bool = False) -> DataFrame:
    """doc_id, fingerprint (long) and, if wanted, h and h2 of every text; a null text counts as empty, and its fingerprint is 0."""

    def scan(batches):
        for batch in split_batches(batches, 0):
            raw, offsets = utf8(batch.column(0))
            data = raw.tobytes()
            marks = np.array([fingerprint(data[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(marks.view(np.int64))], names=[*batch.schema.names[1:], "fingerprint"])

    text = F.coalesce("text", F.lit(""))
    return documents.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *(text_keys(text) if keyed else [])).mapInArrow(scan, "doc_id long, " + "h long, h2 long, " * keyed + "fingerprint long")


def group_bits(sample: np.ndarray, partitions: int) -> list[int]:
    """Masks of near equal width; each starts from a free bit and takes the bits most correlated with it."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    centred = bits - bits.mean(axis=0)
    spread = centred.std(axis=0)
    corr = np.abs(centred.T @ centred) / max(1, len(sample)) / np.maximum(np.outer(spread, spread), 1e-9)
    free, masks = list(range(64)), []
    for p in range(partitions):
        width = len(free) // (partitions - p)
        chosen = [free.pop(0)]
        while len(chosen) < width:
            best = max(free, key=lambda b: (corr[b, chosen].sum(), -b))
            free.remove(best)
            chosen.append(best)
        masks.append(sum(1 << b for b in chosen))
    return masks


def allocate(sample: np.ndarray, total: int, masks: list[int], most: int, row_cost: float = 1.0) -> tuple[float, list[int]]:
    """(expected cost of a fingerprint, threshold of each partition; -1: not probed). A candidate costs 1, a row that is dealt out row_cost."""
    half = sample[: max(1, len(sample) // 2)][:1000], sample[len(sample) // 2 :][:1000]
    cost = []
    for mask in masks:
        width = mask.bit_count()
        apart = np.bitwise_count((half[0][:, None] ^ half[1][None, :]) & np.uint64(mask))
        row = [0.0]
        for t in range(most + 1):
            probes = sum(comb(width, k) for k in range(t + 1))
            # rows dealt out, and expected candidates; a share of none is taken as uniform bits give
            share = max(float((apart <= t).mean()), probes / 2.0**width)
            row.append(probes * row_cost + share * total)
        cost.append(row)
    budget = most - len(masks) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(-1, most + 1):
                x = (c + row[t + 1], [*chosen, t])
                if used + t not in step or x < step[used + t]:
                    step[used + t] = x
        best = step
    return best[budget]


def plan(sample: np.ndarray, total: int, most: int, partitions: int = MOST_PARTITIONS, row_cost: float = 1.0) -> tuple[list[int], list[int]]:
    """The cheapest (masks, thresholds) over numbers of partitions."""
    options = []
    for m in range(1, min(partitions, most + 1) + 1):
        masks = group_bits(sample, m)
        cost, thresholds = allocate(sample, total, masks, most, row_cost)
        options.append((cost, masks, thresholds))
    _, masks, thresholds = min(options)
    return masks, thresholds


def flips(mask: int, threshold: int) -> np.ndarray:
    """All changes of at most `threshold` bits of mask."""
    bits = [b for b in range(64) if mask >> b & 1]
    return np.array([sum(1 << b for b in c) for k in range(threshold + 1) for c in itertools.combinations(bits, k)], np.uint64)


def probes(prints: DataFrame, masks: list[int], thresholds: list[int]) -> DataFrame:
    """(part, value, fingerprint, own) of every probe; own marks the fingerprint's own value, under which it is found."""
    changes = [(p, np.uint64(m), flips(m, t)) for p, (m, t) in enumerate(zip(masks, thresholds, strict=True)) if t >= 0]

    def emit(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for part, mask, change in changes:
                for lo in range(0, len(change), max(1, (1 << 18) // max(1, len(fp)))):
                    some = change[lo : lo + max(1, (1 << 18) // max(1, len(fp)))]
                    value = (fp & mask)[:, None] ^ some[None, :]
                    n = value.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, np.int32)), pa.array(value.ravel().view(np.int64)), pa.array(np.repeat(fp, len(some)).view(np.int64)), pa.array(np.tile(some == 0, len(fp)))],
                        names=["part", "value", "fingerprint", "own"],
                    )

    return prints.select("fingerprint").mapInArrow(emit, "part int, value long, fingerprint long, own boolean")


def links(prints: DataFrame, most: int, total: int | None = None) -> DataFrame:
    """(src, dst) that join the distinct fingerprints of `prints` within `most` bits into their components.

    Within a bucket, found pairs are reduced to a spanning forest before they leave the
    task. Buckets over HOT_BUCKET entries are not compared: every two fingerprints at
    most 2r bits apart share a value that is at most r bits from both, so their members
    are linked through such midpoints, exactly if most is even, and by comparing the
    few members of each midpoint if it is odd. Either way no link is lost.
    """
    prints = prints.select("fingerprint")
    if total is None:
        total = prints.count()
    drawn = smallest(prints, SAMPLE, "fingerprint").toArrow()["fingerprint"].to_numpy().view(np.uint64)
    if total < 2:
        return prints.sparkSession.createDataFrame([], "src long, dst long")
    masks, thresholds = plan(np.ascontiguousarray(drawn), total, most)
    all_probes = probes(prints, masks, thresholds)
    sizes = all_probes.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own"))
    live = stored(sizes.where("n > 1 and n_own > 0"), "buckets")
    small = all_probes.join(live.where(f"n <= {HOT_BUCKET}").select("part", "value"), ["part", "value"])
    hot = all_probes.join(live.where(f"n > {HOT_BUCKET}").select("part", "value"), ["part", "value"]).select("fingerprint").distinct()
    met = small.groupBy("part", "value").agg(F.collect_list(F.struct("fingerprint", "own")).alias("entries")).select("entries")
    middle = flips((1 << 64) - 1, (most + 1) // 2)

    def midpoints(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(fp), max(1, (1 << 18) // len(middle))):
                some = fp[lo : lo + max(1, (1 << 18) // len(middle))]
                value = some[:, None] ^ middle[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(value.ravel().view(np.int64)), pa.array(np.repeat(some, len(middle)).view(np.int64))], names=["value", "fingerprint"])

    around = hot.mapInArrow(midpoints, "value long, fingerprint long").groupBy("value").agg(F.collect_list(F.struct("fingerprint", F.lit(True).alias("own"))).alias("entries")).where("size(entries) > 1").select("entries")

    def compare(batches):
        for batch in batches:
            column = batch.column(0)
            bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
            flat = column.flatten()
            fp, own = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy(zero_copy_only=False)
            src, dst = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                u, v = forest(fp[a:b], own[a:b], most)
                src.append(u)
                dst.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], names=["src", "dst"])

    return met.unionByName(around).mapInArrow(compare, "src long, dst long").distinct()


def forest(fp: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket, each of its components as a star around its smallest fingerprint."""
    nodes, place = np.unique(fp, return_inverse=True)
    near = np.bitwise_count(nodes[:, None] ^ nodes[None, :]) <= most
    found = np.zeros(len(nodes), bool)
    found[place[own]] = True
    near &= found[:, None] | found[None, :]
    label = np.arange(len(nodes))
    while True:
        new = np.where(near, label[None, :], len(nodes)).min(axis=1, initial=len(nodes))
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[label[apart]], nodes[apart]


def classes(documents: DataFrame, shingle: int, most: int, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(fingerprints() of every document; fingerprint, root and first_doc of every fingerprint): equal roots, linked documents.

    Documents with equal fingerprints meet as one fingerprint before anything is
    compared, whatever their number.
    """
    marks = stored(fingerprints(documents, shingle, keyed), "fingerprints")
    return marks, rooted_prints(marks, most)


def rooted_prints(marks: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """fingerprint, root and first_doc (its smallest key) of every fingerprint of marks; equal roots, linked."""
    prints = stored(marks.groupBy("fingerprint").agg(F.min(key).alias("first_doc")), "prints")
    found = connected_components(links(prints, most))
    return prints.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("root"), "first_doc")


def near_duplicates(documents: DataFrame, shingle: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id reachable over fingerprints within `most` bits.

    Null and empty texts have fingerprint 0 and link like any other; documents with a
    null doc_id take part, but name no component unless it has no other. Repeated rows
    each get a row. Columns other than doc_id and text are not read, so their names
    matter nothing. An empty table gives an empty result.
    """
    marks, rooted = classes(documents, shingle, most)
    first = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = rooted.join(first, "root").select("fingerprint", "component_id")
    return marks.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def row_order() -> Column:
    """Rows by doc_id, nulls last; equal ids by the hashes of their texts."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "h2")


def deduplicate(documents: DataFrame, shingle: int = 3, most: int = 2) -> DataFrame:
    """documents with one row of each class, all columns as they were.

    The row with the smallest doc_id stays, nulls last; of equal ids the one with the
    smallest hash of its text; of equal rows any. Rows without words are one class. An
    empty table gives an empty result.
    """
    marks, rooted = classes(documents, shingle, most, keyed=True)
    # per fingerprint first: a hot class is then as many rows as it has fingerprints
    per_print = marks.groupBy("fingerprint").agg(F.min(row_order()).alias("first"))
    kept = per_print.join(rooted.select("fingerprint", "root"), "fingerprint").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.h", "first.h2")
    return keep_rows(documents, kept, marks)


def keep_rows(documents: DataFrame, kept: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents with a kept (doc_id, h, h2), all columns as they were; of rows with equal ids and texts, one. marks has doc_id, h and h2 of every document."""
    ours = free(documents, "kept_id", "kept_h", "kept_h2", "kept_rows")
    same = [F.col("doc_id").eqNullSafe(F.col("other_id")), F.col("h") == F.col("other_h"), F.col("h2") == F.col("other_h2")]
    repeats = marks.groupBy("doc_id", "h", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toDF("other_id", "other_h", "other_h2", "n")
    # rows that are there once, as nearly all are, need no counting
    chosen = kept.join(repeats, same[0] & same[1] & same[2], "left").select("doc_id", "h", "h2", F.coalesce("n", F.lit(1)).alias("n")).toDF(*ours)
    mark, h, h2, n = (F.col(c) for c in ours)
    whole = text_keys(F.coalesce("text", F.lit("")))
    keyed = documents.join(chosen, F.col("doc_id").cast("long").eqNullSafe(mark) & (whole[0] == h) & (whole[1] == h2))
    single = keyed.where(n == 1).select(*columns(documents))
    several = keyed.where(n > 1).dropDuplicates(ours[:3]).select(*columns(documents))
    return single.unionByName(several)


# ------------------------------------------------------------------ copies by fingerprint and similarity
#: Words in a shingle of a fingerprint, and differing bits up to which fingerprints link.
PRINT_WORDS, PRINT_BITS = 3, 2
#: Words in a shingle, and similarity from which two texts are copies of each other.
COPY_WORDS, COPY_SIMILARITY = 5, 0.8
#: Bins of a similarity signature; for bands, each two of them are one.
BINS = 512
#: Bins of a band, so that there are 43. Of texts of similarity 0.8, all but 3 pairs in a million agree in a whole band: (1 - 0.8 ** 6) ** 42.
BAND = 6
#: Estimates nearer to the threshold than this many deviations, and two shingles more, are verified on the shingles themselves.
DEVIATIONS = 5
#: Texts that are compared with each other in one place; larger buckets are split into blocks.
BLOCK = 2048
#: If a bucket has over LARGE texts, one bucket in FIRST_BUCKETS takes part in the first turn.
LARGE, FIRST_BUCKETS = 256, 5
#: Pairs that a text has verified at first, and how many times as many after each next time.
NAMED, MORE = 4, 16
#: Pairs to verify that a text names in the turn after the large buckets' first one; in each next turn MORE times as many.
LISTED = 1024
#: Named pairs that a batch of places holds at most, or those of one place.
PAIRS_OUT = 1 << 17
#: Most texts whose ids are broadcast to the documents; beyond that the join is left to Spark.
BROADCAST_TEXTS = 500_000


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every five-word shingle of a buffer in lower case; a text of fewer words has one shingle, of all its words."""
    start, end, doc = words(raw, offsets)
    h = word_hashes(raw, start, end)
    shingle, size = h.copy(), np.bincount(doc, minlength=len(offsets) - 1)
    for k in range(1, COPY_WORDS):
        reach = (np.arange(len(h)) + k < len(h)) & (np.append(doc[k:], np.full(min(k, len(doc)), -1)) == doc)
        shingle[reach] = mix64(shingle[reach] * np.uint64(0x9E3779B97F4A7C15) + h[k:][reach[: max(0, len(h) - k)]])
    begins = np.concatenate([[0], np.cumsum(size)])[doc]
    whole = np.arange(len(h)) - begins <= np.maximum(size[doc] - COPY_WORDS, 0)
    return mix64(shingle[whole]), doc[whole]


def sketches(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band keys, whether a band holds anything, one-permutation signature of the five-word shingles) of each text of a buffer.

    A signature has 8 bits of the smallest hash of each bin, 0 for an empty bin; a band
    key is of the whole hashes. A text without words has one key.
    """
    shingle, doc = shingle_hashes(_LOWER[raw], offsets)
    n = len(offsets) - 1
    place = doc * BINS + (shingle >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    least = np.full(n * BINS, ~np.uint64(0))
    np.minimum.at(least, place, shingle)
    full = np.bincount(place, minlength=n * BINS) > 0
    signs = np.where(full, (least % np.uint64(255)).astype(np.uint8) + np.uint8(1), np.uint8(0)).reshape(n, BINS)
    wide = BINS // 2
    least, full = least.reshape(n, wide, 2).min(axis=2), full.reshape(n, wide, 2).any(axis=2)
    least[~full] = 0
    at = range(0, wide, BAND)
    keys = np.empty((n, len(at)), np.uint64)
    for band, lo in enumerate(at):
        key = np.full(n, band, np.uint64)
        for k in range(lo, min(lo + BAND, wide)):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
        keys[:, band] = key
    live = np.logical_or.reduceat(full, list(at), axis=1)
    live[:, 0] |= ~live.any(axis=1)
    return keys, live, signs


def estimates(some: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated similarity of every signature of `some` to every one of `signs`, what the estimate may be off); texts without words are alike."""
    both = BINS - ((some == 0).astype(np.float32) @ (signs == 0).astype(np.float32).T)
    equal = np.empty((len(some), len(signs)), np.float32)
    low = np.uint64(0x00FF00FF00FF00FF)
    for k in range(len(some)):
        # eight flags are a word; the words' bytes count up to 64 each
        lanes = (signs == some[k]).view(np.uint64).sum(axis=1)
        equal[k] = (((lanes & low) + (lanes >> np.uint64(8) & low)) * np.uint64(0x0001000100010001)) >> np.uint64(48)
    return np.where(both > 0, (equal - (BINS - both)) / np.maximum(both, 1), 1), _OFF[both.astype(np.int64)]


def _margins() -> np.ndarray:
    """How far an estimate from so many bins may be off near the threshold.

    So many bins hold about -BINS ln(1 - bins / BINS) shingles; those that share a bin
    with a smaller one are missing, and few are if the bins are many.
    """
    bins = np.arange(BINS + 1)
    shingles = -BINS * np.log1p(-np.minimum(bins, BINS - 1) / BINS)
    missing = 1 - bins / np.maximum(shingles, 1e-9)
    return np.where(bins > 0, DEVIATIONS * np.sqrt(COPY_SIMILARITY * (1 - COPY_SIMILARITY) / np.maximum(bins, 1) * missing.clip(0, 1)) + 2 / np.maximum(bins, 1), 0).astype(np.float32)


_OFF = _margins()


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] in `root`, which names the smallest place of each set."""
    while len(a):
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root[:] = root[root]


def place_links(ids: np.ndarray, signs: np.ndarray, label: np.ndarray, asks: np.ndarray, threshold: float, named: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray, bool]]]:
    """(src, dst, named pairs) of the texts of a place.

    The texts that ask are compared with all of other labels. Of surely similar labels
    each set comes as a star around its smallest one. Of the uncertain pairs that remain
    between sets, each asking text names the `named` most similar: (text, others,
    estimates, whether it left some out).
    """
    labels, at = np.unique(label, return_inverse=True)
    root = np.arange(len(labels))
    ask = np.flatnonzero(asks)
    parts = [ask[lo : lo + 256] for lo in range(0, len(ask), 256)]
    near = off = None
    for who in parts:
        near, off = estimates(signs[who], signs)
        i, j = np.nonzero((near >= threshold + off) & (root[at[who]][:, None] != root[at][None, :]))
        merge(root, at[who[i]], at[j])
    out = []
    for who in parts:
        if len(parts) > 1:
            near, off = estimates(signs[who], signs)
        open_ = (near >= threshold - off) & (root[at[who]][:, None] != root[at][None, :])
        for k in np.flatnonzero(open_.any(axis=1)).tolist():
            found = np.flatnonzero(open_[k])
            found = found[np.lexsort((ids[found], -near[k, found]))]
            out.append((int(ids[who[k]]), ids[found[:named]], near[k, found[:named]], len(found) > named))
    apart = np.flatnonzero(root != np.arange(len(root)))
    return labels[root[apart]], labels[apart], out


def placed_texts(keyed: DataFrame) -> DataFrame:
    """(band, id, n) of the texts in buckets of two or more; buckets with the same members are one."""
    members = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b")).where("n > 1")
    return keyed.join(members.groupBy("n", "a", "b").agg(F.min("band").alias("band")).select("band", "n"), "band")


def with_work(placed: DataFrame, labels: DataFrame, open_: DataFrame | None) -> DataFrame:
    """(band, id, n, label, may) of the buckets with work left; labels name the component of each text so far, and may tells who may ask: all, or those in open_.

    A bucket has work if it has several components and a text that may ask. Components
    only grow and open_ only shrinks, so one that has none left needs no further turn.
    Buckets over BLOCK texts all stay; they are not held in one place.
    """
    some = placed.select("band", "id", "n").join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("label"))
    some = some.withColumn("may", F.lit(True)) if open_ is None else some.join(open_.select(F.col("src").alias("id"), F.lit(True).alias("may")), "id", "left").withColumn("may", F.coalesce("may", F.lit(False)))
    left = some.groupBy("band").agg(F.max("n").alias("n"), F.max("may").alias("may"), F.min("label").alias("least"), F.max("label").alias("most")).where(f"n > {BLOCK} OR may AND least < most")
    return stored(some.join(left.select("band"), "band", "left_semi"), "work")


def found_links(some: DataFrame, texts: DataFrame, first: bool, threshold: float, named: int) -> DataFrame:
    """(src, dst, others, near, more): sure links (src, dst) of the buckets' texts as place_links() finds them, and, where dst is null, what the text src names.

    The texts of a bucket of with_work() up to BLOCK meet in one place: those outside its
    largest component ask, if they may, and all answer. A larger bucket is compared with
    one block of its own at first: work that grows with its texts. Later its askers and
    answerers meet in blocks, so no task holds a bucket.
    """
    signed = lambda rows, asks: rows.join(texts.select("id", "sign"), "id").withColumn("text", F.struct("id", "sign", "label", F.col(asks).alias("asks")))
    small, large = some.where(F.col("n") <= BLOCK), some.where(F.col("n") > BLOCK)
    met = signed(small, "may").groupBy("band").agg(F.collect_list("text").alias("texts")).select("texts", F.lit(True).alias("whole"))
    if not large.isEmpty():
        met = met.unionByName(large_places(large, first, signed))

    def table(src, dst, others, near, more):
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(others, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.float32())), pa.array(more, pa.bool_())], names=["src", "dst", "others", "near", "more"])

    def compare(batches):
        lean()
        for batch in batches:
            column = batch.column(0)
            bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).tolist()
            flat = column.flatten()
            ids, label, asks = flat.field(0).to_numpy(), flat.field(2).to_numpy(), flat.field(3).to_numpy(zero_copy_only=False)
            signs = utf8(flat.field(1))[0].reshape(-1, BINS)
            src, dst, others, near, more, pairs = [], [], [], [], [], 0
            for whole, lo, hi in zip(batch.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                ask = asks[lo:hi]
                if whole:
                    # the largest component, the smallest of equals, need not ask
                    known, at, count = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
                    ask = ask & (at != count.argmax())
                u, v, out = place_links(ids[lo:hi], signs[lo:hi], label[lo:hi], ask, threshold, named)
                src += u.tolist() + [x[0] for x in out]
                dst += v.tolist() + [None] * len(out)
                others += [None] * len(u) + [x[1] for x in out]
                near += [None] * len(u) + [x[2] for x in out]
                more += [False] * len(u) + [x[3] for x in out]
                pairs += sum(len(x[1]) for x in out)
                if pairs > PAIRS_OUT:
                    yield table(src, dst, others, near, more)
                    src, dst, others, near, more, pairs = [], [], [], [], [], 0
            yield table(src, dst, others, near, more)
        lean()

    return met.mapInArrow(compare, "src long, dst long, others array<long>, near array<float>, more boolean")


def large_places(some: DataFrame, first: bool, signed) -> DataFrame:
    """(texts, whole) of buckets over BLOCK texts in places of an asking and an answering block; in the first turn one block asks."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    if first:
        asking = some.select("band", "id", "label", blocks).withColumns({"asks": F.pmod(F.xxhash64("id"), "blocks") == 0, "ablocks": F.lit(1)})
    else:
        per = some.groupBy("band", "label").agg(F.count(F.lit(1)).alias("size"), F.count_if("may").alias("asking"))
        parts = per.groupBy("band").agg(F.max(F.struct("size", "label", "asking")).alias("most"), F.sum("asking").alias("asking")).select("band", F.col("most.label").alias("most"), (F.col("asking") - F.col("most.asking")).alias("asking")).where("asking > 0")
        asking = some.join(parts, "band").select("band", "id", "label", blocks, (F.col("may") & (F.col("label") != F.col("most"))).alias("asks"), F.ceil(F.col("asking") / BLOCK).cast("int").alias("ablocks"))
    dealt = asking.withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("seat", F.when(F.col("ablocks") > 1, F.pmod(F.xxhash64("id", F.lit(1)), "ablocks").cast("int")).otherwise(0))
    answers = F.transform(F.sequence(F.lit(0), F.col("ablocks") - 1), lambda a: F.struct(a.alias("a"), F.col("mine").alias("b")))
    asked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.col("seat").alias("a"), b.alias("b")))
    places = dealt.withColumn("place", F.explode(F.when(F.col("asks"), F.array_union(answers, asked)).otherwise(answers)))
    rows = places.select("band", "place", "id", "label", (F.col("asks") & (F.col("place.a") == F.col("seat"))).alias("asks"))
    return signed(rows, "asks").groupBy("band", "place").agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").select("texts", F.lit(False).alias("whole"))


def most_similar(near: DataFrame, named: int) -> DataFrame:
    """(src, dst, rank, more): of what each text names in all its places, the `named` most similar, ranks from 0; more, if any place or this left some out."""

    def pick(batches):
        lean()
        for batch in batches:
            src, dst, rank, more = [], [], [], []
            for who, others, values, cut in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                ids, first = np.unique(others.values.to_numpy(), return_index=True)
                best = np.lexsort((ids, -values.values.to_numpy()[first]))[:named]
                src += [who] * len(best)
                dst += ids[best].tolist()
                rank += range(len(best))
                more += [cut or len(ids) > named] * len(best)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(rank, pa.int32()), pa.array(more, pa.bool_())], names=["src", "dst", "rank", "more"])

    every = near.where("dst IS NULL").groupBy("src").agg(F.flatten(F.collect_list("others")).alias("others"), F.flatten(F.collect_list("near")).alias("near"), F.max("more").alias("more"))
    return every.mapInArrow(pick, "src long, dst long, rank int, more boolean")


def verified(pairs: DataFrame, texts: DataFrame, documents: DataFrame, threshold: float = COPY_SIMILARITY) -> DataFrame:
    """The (src, dst) of pairs whose sets of five-word shingles are similar to the threshold; texts has id, first, h and h2, documents the text of each."""

    def gather(batches):
        lean()
        for batch in split_batches(batches, 1):
            raw, offsets = utf8(batch.column(1))
            shingle, doc = shingle_hashes(_LOWER[raw], offsets)
            bounds = np.searchsorted(doc, np.arange(len(offsets)))
            sets = [np.unique(shingle[a:b]).astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    def compare(batches):
        lean()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                most, least = max(len(a), len(b)), min(len(a), len(b))
                both = len(np.intersect1d(a, b, assume_unique=True)) if least >= threshold * most - 1 else 0
                # a quotient is rounded as the threshold is, so equality holds
                keep.append(most == 0 or both / (most + least - both) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    wanted = stored(texts.join(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id").select("id", F.col("first.doc_id").alias("first_id"), "h", "h2"), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    text = F.coalesce("text", F.lit(""))
    whole = documents.select("doc_id", *text_keys(text), text.alias("text"))
    # one row of each text, however many copies it has; repeats of that row are made one by their sets
    found = whole.join(few, whole["doc_id"].eqNullSafe(few["first_id"]) & (whole["h"] == few["h"]) & (whole["h2"] == few["h2"]))
    sets = stored(found.select("id", "text").mapInArrow(gather, "id long, set binary").groupBy("id").agg(F.first("set").alias("set")), "sets")
    sides = [sets.select(F.col("id").alias(side), F.col("set").alias(f"{side}_set")) for side in ("src", "dst")]
    return pairs.select("src", "dst").join(sides[0], "src").join(sides[1], "dst").select("src", "dst", "src_set", "dst_set").mapInArrow(compare, "src long, dst long")


def copy_classes(texts: DataFrame, documents: DataFrame, threshold: float = COPY_SIMILARITY) -> DataFrame:
    """(node, component) of the texts of (id, first, h, h2, fingerprint, bands, sign) that are linked to another by fingerprint or similarity, directly or through others.

    SimHash comes first: fingerprints within PRINT_BITS link, found by the general
    pigeonhole principle, and these classes are what the turns begin with. Similar texts
    whose fingerprints are further apart follow: texts with a band in common are
    candidates, and turns link those that no class joins yet. If a bucket is large,
    the first turn takes a part of the buckets and joins most large groups at a cost that
    grows with their texts. The next one compares what is still apart. Of the pairs that
    signatures leave uncertain, a text lists the most similar ones; a few are verified
    first, and then more of those that no component joins by then, without another look
    at signatures. If a list was too short, there is one more turn for its text, with a
    longer one. So no pair is left out, and few are verified.
    """
    rooted = rooted_prints(texts, PRINT_BITS, "id")
    first = rooted.groupBy("root").agg(F.min("first_doc").alias("component"))
    labels = stored(texts.select(F.col("id").alias("node"), "fingerprint").join(rooted.select("fingerprint", "root"), "fingerprint").join(first, "root").where("node <> component").select("node", "component"), "linked")
    placed = stored(placed_texts(texts.select("id", F.explode("bands").alias("band"))), "placed")
    large = (placed.agg(F.max("n")).first()[0] or 0) > LARGE
    open_, listed = None, LISTED
    while True:
        some = with_work(placed.where(F.pmod("band", F.lit(FIRST_BUCKETS)) == 0) if large else placed, labels, open_)
        if not large:
            placed = some
        named = NAMED if large else listed
        # a row is a place with its texts, and may be 2 MB
        near = stored(found_links(some, texts, large, threshold, named), "near", batch_rows=16)
        # a row is a text with what it names in all its places, and may be 0.5 MB
        picked = stored(most_similar(near, named), "picked", batch_rows=32)
        lo, hi, similar = 0, NAMED, near.where("dst IS NOT NULL").select("src", "dst")
        while True:
            pairs = picked.where(F.col("rank").between(lo, hi - 1)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
            pairs = stored(apart(pairs, labels) if lo else pairs, "unsure")
            if lo == 0 or not pairs.isEmpty():
                found = stored(verified(pairs, texts, documents, threshold), "verified", batch_rows=64)
                # what was found before stands as a star around each component's smallest text
                labels = connected_components((found if lo else found.unionByName(similar)).unionByName(labels.toDF("src", "dst")))
            lo, hi = hi, hi * MORE
            if lo >= named or picked.where(F.col("rank") >= lo).isEmpty():
                break
        if not large:
            open_ = stored(picked.where("more").select("src").distinct(), "open")
            if open_.isEmpty():
                return labels
            listed *= MORE
        large = False


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The (src, dst) of pairs that are in different components by labels."""
    for side in ("src", "dst"):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_label")), side, "left")
    return pairs.where(F.coalesce("src_label", "src") != F.coalesce("dst_label", "dst")).select("src", "dst")


def drop_copies(documents: DataFrame, threshold: float = COPY_SIMILARITY) -> DataFrame:
    """documents with one row of each class of copies, all columns as they were.

    Copies are equal texts, texts whose SimHash fingerprints (of three-word shingles)
    differ in PRINT_BITS or fewer bits, and texts whose five-word shingles are similar to
    the threshold, directly or through others. Signatures decide where they are far enough
    from the threshold, else the shingles. The row with the smallest doc_id stays, nulls
    last; of equal ids the one with the smallest hash of its text; of equal rows any.
    Nulls count as empty; texts without words are one class. Other columns may have any
    name. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))

    def scan(batches):
        lean()
        for batch in split_batches(batches, 0, 1 << 20):
            raw, offsets = utf8(batch.column(0))
            keys, live, signs = sketches(raw, offsets)
            prints = np.array([fingerprint(raw[a:b].tobytes(), PRINT_WORDS) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(live.sum(axis=1))]), pa.int32()), pa.array(keys[live].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints.view(np.int64)), bands, pa.array([s.tobytes() for s in signs], pa.binary())], names=["doc_id", "h", "h2", "fingerprint", "bands", "sign"])

    marks = stored(documents.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *text_keys(text)).mapInArrow(scan, "doc_id long, h long, h2 long, fingerprint long, bands array<long>, sign binary"), "copies")
    texts = marks.groupBy("h", "h2").agg(F.min(row_order()).alias("first"), F.first("fingerprint").alias("fingerprint"), F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    # a number of its own for each text; it is stored, so it stays
    texts = stored(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    found = copy_classes(texts, documents, threshold)
    kept = texts.select("id", "first").join(found.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("component", "id").alias("root")).agg(F.min("first").alias("first"))
    return keep_rows(documents, kept.select("first.doc_id", "first.h", "first.h2"), marks)
