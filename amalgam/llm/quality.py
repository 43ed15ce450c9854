"""Quality rules: text measures, fixed rules, and a hashed n-gram classifier.

The classifier is logistic regression over hashed presence features (words, word
pairs and five-byte strings), one head for low quality and one for toxicity, fitted
on labelled rows. Features start from their naive-Bayes log-count ratio, and Platt
scaling on held-out rows turns scores into probabilities, which are compared with
fixed thresholds. Scoring runs in Arrow batches.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, map_rows, slices, smallest, split_batches, utf8, word_hashes, words, worker_state

#: Size of the hashed feature space, as a power of two.
FEATURE_BITS = 20
#: Bytes in a character n-gram.
CHAR_N = 5
#: A feature counts if its shares in the two classes differ by so many standard errors.
LEAST_Z = 5.0
#: Text bytes that are scored at a time.
STEP_BYTES = 1 << 19
#: Most labelled rows that a fit uses, those with the smallest hash of their id, and most bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 4000, 64 << 20
#: A document goes if its low-quality or toxic probability reaches these.
LOW_QUALITY_AT, TOXIC_AT = 0.5, 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: The symbols that count as such.
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _keyed(hashes: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Hashes that differ between documents."""
    return (hashes ^ (document.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)


def measure(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Word, symbol, line and repetition counts of each document of a byte buffer."""
    n = len(offsets) - 1
    start, end, doc = words(raw, offsets)
    solid = ~IS_SPACE[raw]
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": _per_document(solid & ((raw & 0xC0) != 0x80), offsets),
        "n_symbols": _per_document(_IS_SYMBOL[raw], offsets),
    }
    breaks = np.flatnonzero(raw == 10)
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.argsort(line_start, kind="stable")
    line_doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])[order]
    line_start = line_start[order]
    # a line ends before the next line break of its document, or at its document's end
    stop = np.append(breaks, len(raw))[np.searchsorted(breaks, line_start)]
    line_end = np.maximum(np.minimum(stop, offsets[line_doc + 1]), line_start)
    seen = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    full = seen[line_end] > seen[np.minimum(line_start, len(raw))]
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    key = _keyed(word_hashes(raw, line_start, line_end), line_doc)
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[first], minlength=n)

    h = word_hashes(raw, start, end)
    repeated = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 5:
        w = h[:-4].copy()
        for k in range(1, 5):
            w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - 4 + k]
            w ^= w >> np.uint64(29)
        whole = np.flatnonzero(doc[:-4] == doc[4:])
        _, group, count = np.unique(_keyed(w[whole], doc[whole]), return_inverse=True, return_counts=True)
        hit = whole[count[group] > 1]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + 5, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(repeated)[:-1] > 0], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each feature that a document has, without repeats, ordered by document."""
    start, end, doc = words(raw, offsets)
    shift = np.uint64(64 - FEATURE_BITS)
    h = word_hashes(raw, start, end)
    keys = [(doc, h >> shift)]
    if len(h) > 1:
        pair = np.flatnonzero(doc[:-1] == doc[1:])
        keys.append((doc[pair], ((h[:-1] * np.uint64(3) + h[1:]) * np.uint64(0xD6E8FEB86659FD93))[pair] >> shift))
    if len(raw) >= CHAR_N:
        low = _LOWER[raw]
        m = len(raw) - CHAR_N + 1
        x = low[:m].astype(np.uint64)
        for k in range(1, CHAR_N):
            x |= low[k : k + m].astype(np.uint64) << np.uint64(8 * k)
        at = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        whole = np.flatnonzero(at[:m] == at[CHAR_N - 1 :])
        keys.append((at[whole], (x * np.uint64(0x9E3779B97F4A7C15) >> shift)[whole]))
    # few documents fit 32 bits, which sort faster
    kind = np.uint32 if len(offsets) <= 1 << (32 - FEATURE_BITS) else np.uint64
    both = np.concatenate([(d.astype(kind) << kind(FEATURE_BITS)) | f.astype(kind) for d, f in keys])
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both >> kind(FEATURE_BITS)).astype(np.int64), (both & kind((1 << FEATURE_BITS) - 1)).astype(np.int64)


@dataclass
class Head:
    """A fitted classifier: weights of the features, and Platt's slope and intercept."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    intercept: float = 0.0

    def probability(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(doc, weights=self.weights[feature], minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.intercept, -30, 30)))


def _logistic(columns: list[np.ndarray], y: np.ndarray, l2: float, steps: int = 200) -> np.ndarray:
    """Weights of a few dense columns and a bias, by Newton's method."""
    x = np.column_stack([*columns, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + l2 * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + (l2 + 1e-9) * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_head(parts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, held: np.ndarray, l2: float = 1e-3, steps: int = 60) -> Head | None:
    """A classifier for labels y of 0, 1 or nan (not used). None if either class has no training row.

    parts are (document, feature) pairs. The rows of held only calibrate.
    """
    train = ~held & ~np.isnan(y)
    if not train.any() or y[train].min() == y[train].max():
        return None
    size, n = 1 << FEATURE_BITS, len(y)
    df, pos = np.zeros(size), np.zeros(size)
    for doc, feature in parts:
        use = train[doc]
        df += np.bincount(feature[use], minlength=size)
        pos += np.bincount(feature[use], weights=y[doc[use]], minlength=size)
    n_pos, n_neg = y[train].sum(), (1 - y[train]).sum()
    ratio = np.log((pos + 0.5) / (n_pos + 1)) - np.log((df - pos + 0.5) / (n_neg + 1))
    share = df / (n_pos + n_neg)
    spread = np.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg)) + 1e-12
    ratio[np.abs(pos / n_pos - (df - pos) / n_neg) < LEAST_Z * spread] = 0
    chosen = [(doc[use], feature[use]) for doc, feature in parts for use in [ratio[feature] != 0]]
    d, f = (np.concatenate(x) for x in zip(*chosen, strict=True))
    known, f = np.unique(f, return_inverse=True)
    scale = ratio[known] / np.abs(ratio[known]).max(initial=1)
    weight = train * np.where(y > 0, 0.5 / n_pos, 0.5 / n_neg)
    goal = np.nan_to_num(y)
    w, bias, m, v, mb, vb = np.zeros(len(known)), 0.0, np.zeros(len(known)), np.zeros(len(known)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = bias + np.bincount(d, weights=(w * scale)[f], minlength=n)
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal) * weight
        g, gb = scale * np.bincount(f, weights=r[d], minlength=len(known)) + l2 * w / max(1, len(known)), r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    z = bias + np.bincount(d, weights=(w * scale)[f], minlength=n)
    weights = np.zeros(size, np.float32)
    weights[known] = w * scale
    head = Head(weights, float(bias))
    rows = held & ~np.isnan(y)
    rows = rows if 0 < y[rows].sum() < rows.sum() else train
    # Platt's targets, short of 0 and 1, keep the slope finite
    n1, n0 = y[rows].sum(), (1 - y[rows]).sum()
    slope, intercept = _logistic([z[rows]], np.where(y[rows] > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), 1e-4)
    if slope > 0:
        head.slope, head.intercept = float(slope), float(intercept)
    return head


@dataclass
class QualityModel:
    low_quality: Head | None
    toxic: Head | None


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit both heads on at most `rows` labelled documents, those with the smallest hash of doc_id, as far as their texts are within TRAIN_BYTES.

    Labels or ids that are null are left out; a document or label that is repeated counts once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = smallest(known, rows, "doc_id")
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    table = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    # a window over `rows` rows at most
    reach = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("reach", F.sum(F.octet_length("text").cast("long")).over(reach)).where(F.col("reach") <= TRAIN_BYTES).drop("reach").toArrow().sort_by("doc_id")
    if not table.num_rows:
        return QualityModel(None, None)
    parts, at = [], 0
    for piece in table["text"].chunks:
        raw, offsets = utf8(piece)
        for lo, hi in slices(offsets, STEP_BYTES):
            doc, feature = features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            parts.append((doc.astype(np.int32) + np.int32(at + lo), feature.astype(np.int32)))
        at += len(piece)
    held = np.asarray(table["doc_id"].to_numpy() * 2654435761 % 4294967296 % 5 == 0)

    def head(label: str, positive: int) -> Head | None:
        value = np.array([np.nan if x is None else float(x == positive) for x in table[label].to_pylist()])
        return fit_head(parts, value, held)

    return QualityModel(head("quality", 0), head("toxic", 1))


def judge(documents: DataFrame, model: QualityModel) -> DataFrame:
    """documents with the measures, base_failed, p_low_quality, p_toxic and kept.

    A null text counts as empty: no words, so base_failed. A head that could not be
    fitted gives a null probability and rejects nothing. Repeated rows each get a row.
    Columns of documents named like the results are replaced; others stay, whatever
    their names. An empty table gives an empty result.
    """
    kinds = {k: "long" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": "boolean", "p_low_quality": "double", "p_toxic": "double", "kept": "boolean"}
    added = list(kinds)
    documents = documents.drop(*added)
    at = documents.columns.index("text")

    def score(batches):
        # Spark itself broadcasts a function of this size; pickled with it, the model needs no installed package
        m = model
        worker_state().clear()
        for batch in split_batches(batches, at):
            raw, offsets = utf8(batch.column(at).fill_null(""))
            n = batch.num_rows
            pieces = []
            for lo, hi in slices(offsets, STEP_BYTES):
                part, bounds = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                doc, feature = features(part, bounds)
                pieces.append((measure(part, bounds), [h.probability(doc, feature, hi - lo) if h else None for h in (m.low_quality, m.toxic)]))
            if not pieces:
                continue
            got = {k: np.concatenate([x[0][k] for x in pieces]) for k in added[:5]}
            p = [None if pieces[0][1][i] is None else np.concatenate([x[1][i] for x in pieces]) for i in (0, 1)]
            failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
            kept = ~failed
            for x, most in zip(p, (LOW_QUALITY_AT, TOXIC_AT), strict=True):
                if x is not None:
                    kept &= x < most
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(got[k]) for k in added[:5]), pa.array(failed), *(pa.nulls(n, pa.float64()) if x is None else pa.array(x) for x in p), pa.array(kept)],
                names=[*batch.schema.names, *added],
            )

    return map_rows(documents, score, kinds)
