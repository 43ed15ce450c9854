"""What several operators share: tables in the shared folder, Arrow batches as byte buffers, words, free column names."""

import contextlib
import ctypes
import hashlib
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import scratch, written as stored

__all__ = ["scratch", "stored"]

#: Text bytes that a worker handles at a time. Spark itself ends an Arrow batch at 64 MB, so no session setting is needed.
PIECE_BYTES = 4 << 20


def split_batches(batches: Iterable[pa.RecordBatch], column: int | str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices with at most `most` bytes of a text column each, or one longer row."""
    for batch in batches:
        at = column if isinstance(column, int) else batch.schema.get_field_index(column)
        _, offsets = utf8(batch.column(at))
        for lo, hi in slices(offsets, most):
            yield batch.slice(lo, hi - lo)


def free(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores before it as it takes to differ from every column of df, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list:
    """The columns of df, by their literal names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def sheltered(df: DataFrame, needed: tuple[str, ...], apply) -> DataFrame:
    """apply(df) with df's own columns alone and as they were: those that are not needed have other names while it is applied, so that it replaces none."""
    safe = [c if c in needed else f"column {i}" for i, c in enumerate(df.columns)]
    out = apply(df.toDF(*safe))
    return out.select(*[F.col(f"`{s}`") for s in safe]).toDF(*df.columns)


def map_rows(df: DataFrame, fn, added: dict[str, str] | None = None) -> DataFrame:
    """fn over Arrow batches of df, with the fields `added` after its own. In the batches df's columns are c0, c1 and so on, as Spark cannot pass every name to Python."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(fn, extended(plain.schema, added or {})).toDF(*df.columns, *(added or {}))


def smallest(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """The `rows` rows with the smallest hashes of key, which are a sample that does not depend on order.

    Rows over twice the share that is wanted are left out before the sort, so a
    partition sends a few rows and not `rows` of them.
    """
    total = df.count()
    digest = F.xxhash64(*key)
    if total > 2 * rows:
        df = df.where(digest < F.lit(int(-(1 << 63) + min(1.0, 2 * rows / total) * ((1 << 64) - 1))))
    return df.orderBy(digest, *key).limit(rows)


def text_column(df: DataFrame, text: str) -> DataFrame:
    """Nulls become empty texts."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls, as numpy views; offsets count from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


#: White space of the word pattern [^\x20\x09-\x0D]+.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; a word never crosses documents."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = np.empty(n + 1, bool)
    solid[:n] = ~IS_SPACE[raw]
    solid[n] = False
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:]
    start = np.flatnonzero(starts)
    ends = solid[:-1] & (~solid[1:] | first[1:])
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range.

    Eight bytes are taken at a time; ranges over 256 bytes are hashed one by one.
    """
    h = (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if len(raw) == 0 or len(start) == 0:
        return mix64(h)
    for i in np.flatnonzero(end - start > 256):
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
    left, at = end - start, start.copy()
    live = np.flatnonzero((left > 0) & (left <= 256))
    while len(live):
        k = np.minimum(left[live], 8)
        lane = np.ascontiguousarray(lanes[at[live]]).view("<u8").ravel()
        keep = np.where(k == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(k, 7) * 8).astype(np.uint64)) - np.uint64(1))
        h[live] = mix64(h[live] ^ (lane & keep))
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return h


def segment_sum(values: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by segment number, n segments."""
    return np.bincount(segment, weights=values, minlength=n)


def extended(schema: T.StructType, added: dict[str, str]) -> T.StructType:
    """schema with fields after its own."""
    more = T.StructType()
    for name, kind in added.items():
        more = more.add(name, kind)
    return T.StructType([*schema.fields, *more.fields])


def slices(offsets: np.ndarray, most: int = 2 << 20):
    """Row ranges (lo, hi) of at most `most` bytes each, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def worker_state() -> dict:
    """A dictionary that a Python worker keeps between its tasks. Tasks that need much memory clear it first."""
    return sys.modules.setdefault("_amalgam_kept", types.ModuleType("_amalgam_kept")).__dict__


def lean() -> None:
    """Forget what this Python worker kept for tasks of another kind, and give memory that is free back to the system, as executors count it until then."""
    worker_state().clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
