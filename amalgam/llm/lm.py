"""Language-model scores by deleted interpolation.

Relative frequencies of a word after two words, after one word and on its own, and
1 / (V + 1), are mixed level by level: P3 = a f(w | u v) + (1 - a) P2, P2 = b f(w | v) +
(1 - b) P1, P1 = c f(w) + (1 - c) / (V + 1). The weights a and b depend on how often
their context was seen, in buckets of powers of two. They come from
expectation-maximisation: a tenth of the training documents is held out, the counts of
the others predict it, and the mixture that predicts it best is taken. Each step adds up
its statistics over all held-out tokens where they lie. The final counts are those of
all training documents.

Documents are dealt into chunks by a hash. A chunk asks for the counts of its distinct
words, pairs and triples (as sorted keys, cut into key ranges), each range adds up what
all chunks report and answers every chunk in the order it asked. So the model is never
in one place, and what moves is a few bytes for each distinct n-gram of a chunk. A chunk
sends a row to each range that it has keys for: chunks times ranges at first, and never
over one for each key; a range takes RANGE_KEYS keys.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored, utf8, word_hashes, words

#: Text bytes of a chunk; small inputs have up to FEW_CHUNKS chunks of at least LEAST_BYTES for the sake of parallel work.
CHUNK_BYTES, FEW_CHUNKS, LEAST_BYTES = 6 << 20, 32, 1 << 20
#: Keys that a range should answer, and ranges that small inputs have, one for each chunk.
RANGE_KEYS, FEW_RANGES = 4 << 20, 128
#: One in so many training documents is held out for the weights.
HELD_OUT_ONE_IN = 10
#: Context-frequency buckets: unseen, 1, 2-3, 4-7 and so on.
BUCKETS = 40
#: Most steps of expectation-maximisation, and the change of all weights below which it ends.
STEPS, SETTLED = 25, 2e-3

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
TRAIN, TUNE, TEST = 0, 1, 2


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every token: the words of each document, then an end."""
    raw = _LOW[raw]
    start, end, doc = words(raw, offsets)
    n = len(offsets) - 1
    h = np.full(len(doc) + n, END, np.uint64)
    h[np.arange(len(doc)) + doc] = word_hashes(raw, start, end)
    return h, np.repeat(np.arange(n), np.bincount(doc, minlength=n) + 1)


def squeeze(x: np.ndarray) -> bytes:
    """Zstandard of the bytes of x, all lowest bytes first."""
    plain = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def stretch(blob: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    plain = np.frombuffer(pa.decompress(blob[8:], decompressed_size=n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(plain.reshape(size, -1).T).view(kind).ravel()


def squeeze_counts(x: np.ndarray) -> bytes:
    """squeeze() of counts in as few bytes as the largest needs."""
    size = next(k for k in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * k))
    return bytes([size]) + squeeze(x.astype(f"<u{size}"))


def stretch_counts(blob: bytes) -> np.ndarray:
    return stretch(blob[1:], f"<u{blob[0]}").astype(np.int64)


def cut(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Bounds of `ranges` equal parts of the key space in a sorted key array."""
    inner = np.array([(1 << bits) * r // ranges for r in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]]).astype(np.int64)


def key_bits(size: int) -> int:
    """Bits of a pair's or triple's key: 20 more than count them, so that one in some million is taken for another. Words have all WORD_BITS."""
    return min(WORD_BITS, max(32, int(size // 4).bit_length() + 20))


#: Bits of a key besides the two that tell words, pairs and triples.
WORD_BITS = 62


class Ngrams:
    """The distinct words, pairs and triples of a chunk, and those of each token.

    The first token of a document has no context but the start, which is no word; the
    second has a pair with the start. `first` marks first tokens.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, ranges: int, bits: int):
        h, self.doc = tokens(raw, offsets)
        n = len(h)
        self.first = np.ones(n, bool)
        self.first[1:] = self.doc[1:] != self.doc[:-1]
        before = np.where(self.first, START, np.roll(h, 1))
        words_, self.word = np.unique(mix64(h ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - WORD_BITS), return_inverse=True)
        narrow = np.uint64(64 - bits)
        mixed = mix64(before * np.uint64(0x9E3779B97F4A7C15) + mix64(h))
        pairs, self.pair = np.unique(mixed >> narrow, return_inverse=True)
        older = np.where(self.first, START, np.roll(before, 1))
        triples, self.triple = np.unique(mix64(older * np.uint64(0xD1342543DE82EF95) + mixed) >> narrow, return_inverse=True)
        kinds = [words_, pairs, triples]
        self.sizes = [len(k) for k in kinds]
        keys = np.concatenate([k | np.uint64(i << WORD_BITS) for i, k in enumerate(kinds)])
        # each kind is cut into the same ranges; a range has its words, then its pairs, then its triples
        part = np.concatenate([np.repeat(np.arange(ranges), np.diff(cut(k, ranges, b))) for k, b in zip(kinds, (WORD_BITS, bits, bits), strict=True)])
        self.order = np.argsort(part, kind="stable")
        self.keys = keys[self.order]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=ranges))])
        #: Word and pair before each token; those of first tokens mean nothing.
        self.last_word, self.last_pair = np.roll(self.word, 1), np.roll(self.pair, 1)

    def counts(self, use: np.ndarray) -> np.ndarray:
        """How often each key stands in the tokens `use`, in the order of keys."""
        each = [np.bincount(place[use], minlength=size) for place, size in zip((self.word, self.pair, self.triple), self.sizes, strict=True)]
        return np.concatenate(each)[self.order]

    def split(self, counts: np.ndarray) -> list[np.ndarray]:
        """Counts of words, pairs and triples from those in the order of keys."""
        plain = np.empty(len(self.order), np.int64)
        plain[self.order] = counts
        return np.split(plain, np.cumsum(self.sizes)[:-1])

    def frequencies(self, counts: np.ndarray, n_tokens: int, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(f(w | u v), f(w | v), f(w), count of u v, of v, of w) of every token; 0 after an unseen context."""
        word, pair, triple = self.split(counts)
        two = np.where(self.first, n_docs, pair[self.last_pair])
        one = np.where(self.first, n_docs, word[self.last_word])
        c = word[self.word]
        return triple[self.triple] / np.maximum(two, 1), pair[self.pair] / np.maximum(one, 1), c / max(n_tokens, 1), two, one, c


def ask_counts(dealt: DataFrame, ranges: int, bits: int) -> DataFrame:
    """(range, chunk, tune, keys, counts): what each chunk asks of each key range, with its own training counts."""
    schema = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("tune", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])

    def ask(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        grams = Ngrams(*utf8(table["text"]), ranges, bits)
        counts = grams.counts(kind[grams.doc] != TEST)
        chunk, tune = table["chunk"][0].as_py(), bool((kind == TUNE).any())
        rows = [(r, chunk, tune, squeeze(np.diff(grams.keys[a:b], prepend=np.uint64(0))), squeeze_counts(counts[a:b])) for r, (a, b) in enumerate(zip(grams.bounds[:-1].tolist(), grams.bounds[1:].tolist(), strict=True)) if a < b]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return dealt.groupBy("chunk").applyInArrow(ask, "range int, chunk int, tune boolean, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """(chunk, range, counts, train, types, train_types, train_tokens, all_tokens): the counts over all chunks, in the order each chunk asked.

    train is without the documents held out for the weights, and for their chunks only.
    The figures of a range's words stand in one of its rows.
    """

    def add(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(stretch(b.as_py(), "<u8"), dtype=np.uint64) for b in table["keys"]]
        tune = table["tune"].to_numpy()
        ends = np.cumsum([len(k) for k in keys])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        own = np.concatenate([stretch_counts(b.as_py()) for b in table["counts"]])
        total = np.bincount(place, weights=own, minlength=len(distinct)).astype(np.int64)
        held = np.bincount(place, weights=own * np.repeat(tune, [len(k) for k in keys]), minlength=len(distinct)).astype(np.int64)
        word, train = distinct >> np.uint64(WORD_BITS) == 0, total - held
        first = np.arange(len(keys)) == 0
        figures = [int((word & (total > 0)).sum()), int((word & (train > 0)).sum()), int(train[word].sum()), int(total[word].sum())]
        places = np.split(place, ends[:-1])
        return pa.table(
            [table["chunk"], table["range"], pa.array([squeeze_counts(total[p]) for p in places], pa.binary()), pa.array([squeeze_counts(train[p]) if t else None for p, t in zip(places, tune, strict=True)], pa.binary()), *(pa.array(first * np.int64(f)) for f in figures)],
            names=["chunk", "range", "counts", "train", "types", "train_types", "train_tokens", "all_tokens"],
        )

    return asked.groupBy("range").applyInArrow(add, "chunk int, range int, counts binary, train binary, types long, train_types long, train_tokens long, all_tokens long")


def gathered(answer: pa.Table, name: str) -> np.ndarray:
    """A chunk's counts in the order of its keys, from its answers."""
    return np.concatenate([np.zeros(0, np.int64), *(stretch_counts(b.as_py()) for b in answer.sort_by("range")[name])])


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one bucket for each power of two."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1).astype(np.uint8)


def mixture(weights: np.ndarray, f3: np.ndarray, f2: np.ndarray, f1: np.ndarray, b3: np.ndarray, b2: np.ndarray, rest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P3, P2, P1); weights has a row for a, b and c, the last one in its first place."""
    p1 = weights[2, 0] * f1 + (1 - weights[2, 0]) * rest
    p2 = weights[1, b2] * f2 + (1 - weights[1, b2]) * p1
    return weights[0, b3] * f3 + (1 - weights[0, b3]) * p2, p2, p1


def expected(weights: np.ndarray, f3: np.ndarray, f2: np.ndarray, f1: np.ndarray, b3: np.ndarray, b2: np.ndarray, rest: float) -> np.ndarray:
    """(2, 3, BUCKETS): how often tokens are expected to come from each level's own frequency, and how often they reach the level."""
    p3, p2, p1 = mixture(weights, f3, f2, f1, b3, b2, rest)
    own3 = weights[0, b3] * f3 / p3
    own2 = (1 - own3) * weights[1, b2] * f2 / p2
    reach1 = 1 - own3 - own2
    own1 = reach1 * weights[2, 0] * f1 / p1
    out = np.zeros((2, 3, BUCKETS))
    for level, (b, own, reach) in enumerate(((b3, own3, None), (b2, own2, 1 - own3))):
        out[0, level] = np.bincount(b, weights=own, minlength=BUCKETS)
        out[1, level] = np.bincount(b, weights=reach, minlength=BUCKETS)
    out[:, 2, 0] = own1.sum(), reach1.sum()
    return out


def improved(total: np.ndarray) -> np.ndarray:
    """Weights from the expectations of a step. Half an occurrence on either side keeps each between 0 and 1; unseen contexts have no frequency."""
    weights = (total[0] + 0.5) / (total[1] + 1)
    weights[:2, 0] = 0
    return weights


def learn_weights(step) -> np.ndarray:
    """(3, BUCKETS) weights by expectation-maximisation; step gives the expectations under weights."""
    weights = np.full((3, BUCKETS), 0.5)
    weights[:2, 0] = 0
    for _ in range(STEPS):
        new = improved(step(weights))
        moved = np.abs(new - weights).max()
        weights = new
        if moved < SETTLED:
            break
    return weights


def parts(keys: float, least: int) -> int:
    """Key ranges for so many keys."""
    return max(1, min(least, FEW_RANGES), -(-int(keys) // RANGE_KEYS))


def score(documents: DataFrame, kind: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """documents' doc_id, kind, n_tokens, n_known, train_tokens, base_score and score.

    kind is TRAIN or TEST; the model learns from TRAIN alone. base_score adds one to
    every word's count. A null text is empty: its one token is the end. Without training
    documents every probability is 1 / (V + 1) = 1. Repeated rows and equal ids are scored
    row by row. Columns other than doc_id, text and those of kind are not read, so their
    names matter nothing. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    mark = F.xxhash64("doc_id", text)
    tune = (kind == TRAIN) & (F.pmod(F.xxhash64(mark), F.lit(HELD_OUT_ONE_IN)) == 0)
    role = F.when(tune, TUNE).otherwise(kind).cast("int")
    known = documents.select(F.octet_length(text).cast("long").alias("size"), role.alias("role"))
    whole = known.agg(F.sum("size").alias("size"), F.count_if(F.col("role") == TRAIN).alias("train"), F.count_if(F.col("role") == TUNE).alias("tune")).first()
    size, train_docs, all_docs = whole["size"] or 0, whole["train"], whole["train"] + whole["tune"]
    chunks = max(1, -(-size // chunk_bytes), min(FEW_CHUNKS, size // LEAST_BYTES))
    few = max(1, -(-chunks // HELD_OUT_ONE_IN))
    ranges, bits = parts(size / 4, chunks), key_bits(size)
    # documents for the weights have chunks of their own, so that only those are read for them
    chunk = F.when(tune, F.pmod(mark, F.lit(few)) + chunks).otherwise(F.pmod(mark, F.lit(chunks))).cast("int")
    dealt = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), role.alias("kind"), chunk.alias("chunk"))
    found = stored(answers(ask_counts(dealt, ranges, bits)), "counts")
    figures = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "train_types", "train_tokens", "all_tokens")]).first()
    n_train, n_all, types, train_types = (figures[c] for c in ("train_tokens", "all_tokens", "types", "train_types"))

    def watch(key, docs: pa.Table, answer: pa.Table) -> pa.Table:
        out = pa.schema([(c, pa.binary()) for c in ("f3", "f2", "f1", "b3", "b2")])
        if not docs.num_rows:
            return out.empty_table()
        grams = Ngrams(*utf8(docs["text"]), ranges, bits)
        f3, f2, f1, two, one, _ = grams.frequencies(gathered(answer, "train"), n_train, train_docs)
        return pa.table([pa.array([squeeze(x)], pa.binary()) for x in (f3, f2, f1, bucket(two), bucket(one))], schema=out)

    held = dealt.where(F.col("chunk") >= chunks).groupBy("chunk").cogroup(found.where(F.col("chunk") >= chunks).select("chunk", "range", "train").groupBy("chunk"))
    events = stored(held.applyInArrow(watch, "f3 binary, f2 binary, f1 binary, b3 binary, b2 binary"), "events")

    def step(weights: np.ndarray) -> np.ndarray:
        def add(batches):
            total = np.zeros((2, 3, BUCKETS))
            for batch in batches:
                for row in range(batch.num_rows):
                    f3, f2, f1 = (stretch(batch.column(c)[row].as_py(), "<f8") for c in range(3))
                    b3, b2 = (stretch(batch.column(c)[row].as_py(), "u1") for c in (3, 4))
                    total += expected(weights, f3, f2, f1, b3, b2, 1 / (train_types + 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "x"])

        # one number for each place of a small array, whatever the input
        rows = events.mapInArrow(add, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(6 * BUCKETS)
        for r in rows:
            out[r["at"]] = r["x"]
        return out.reshape(2, 3, BUCKETS)

    weights = learn_weights(step)

    def rate(key, docs: pa.Table, answer: pa.Table) -> pa.Table:
        out = pa.schema([("doc_id", pa.int64()), ("kind", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not docs.num_rows:
            return out.empty_table()
        grams = Ngrams(*utf8(docs["text"]), ranges, bits)
        f3, f2, f1, two, one, c = grams.frequencies(gathered(answer, "counts"), n_all, all_docs)
        p = mixture(weights, f3, f2, f1, bucket(two), bucket(one), 1 / (types + 1))[0] if n_all else np.ones(len(c))
        doc, n = grams.doc, docs.num_rows
        base = np.bincount(doc, weights=np.log10((c + 1) / (n_all + types + 1)), minlength=n)
        return pa.table(
            [docs["doc_id"], docs["kind"], pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[c > 0], minlength=n)), pa.array(np.full(n, n_all)), pa.array(base), pa.array(np.bincount(doc, weights=np.log10(p), minlength=n))],
            schema=out,
        )

    return dealt.groupBy("chunk").cogroup(found.select("chunk", "range", "counts").groupBy("chunk")).applyInArrow(rate, "doc_id long, kind int, n_tokens long, n_known long, train_tokens long, base_score double, score double")
