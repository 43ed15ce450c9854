"""Removal of byte strings that an earlier document holds, by suffix arrays.

1. Exact copies of a text with a smaller id go as a whole.
2. Winnowing leaves the rest out: each window of LENGTH bytes has an anchor, the ANCHOR
   bytes with the smallest hash in it, and equal windows have equal anchors. Chunks of
   documents ask key ranges which of their anchors another document has. Bytes outside
   windows with such an anchor cannot be in any match. (Anchor keys are short hashes;
   a chance collision only leaves more for the next step.)
3. The documents with such windows are dealt into shards. Each shard's candidate pieces,
   cut into blocks that overlap by a window, get a suffix array by Larsson-Sadakane
   refinement and common prefixes by Kasai's rule, and so runs of suffixes that share
   LENGTH bytes; within a run the smallest doc_id keeps its bytes.
4. Across shards, each run's first LENGTH bytes stand as a hash of over 64 bits, with the
   smallest doc_id of the run. Key ranges merge the shards' sorted lists and find by
   binary search which strings a smaller doc_id has elsewhere.

Nothing is compared pair by pair, and hashes spread hot strings evenly over ranges. A
chunk or shard sends a row to each range that it has keys for, so rows grow with chunks
times ranges at first and never over one for each key; a range takes RANGE_KEYS keys.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, stored
from .lm import cut, squeeze, squeeze_counts, stretch, stretch_counts

#: Bytes of a string that counts as repeated, and bytes of an anchor.
LENGTH, ANCHOR = 50, 24
#: Text bytes of a chunk; candidate bytes of a shard.
CHUNK_BYTES, SHARD_BYTES = 6 << 20, 3 << 19
#: Bytes that are hashed at a time.
STEP_BYTES = 1 << 19
#: Keys that a range should answer, and ranges that small inputs have for the sake of parallel work, one for each chunk or shard.
RANGE_KEYS, FEW_RANGES = 2 << 20, 128
#: Windows of a block: repeats over that are not sorted any further.
BLOCK_WINDOWS = 256


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as uint64; zeros follow the end."""
    n = len(raw)
    padded, out = np.concatenate([raw, np.zeros(16, np.uint8)]), np.empty(n, np.uint64)
    for k in range(8):
        every = out[k::8]
        every[:] = padded[k : k + 8 * len(every)].view("<u8")
    return out


def string_hashes(raw: np.ndarray, length: int, eight: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each position on; the last ones, which lack bytes, mean nothing."""
    eight = lanes(raw) if eight is None else eight
    h = np.full(len(raw), np.uint64(0x243F6A8885A308D3 ^ length))
    spare = np.empty(len(raw), np.uint64)
    for at in lane_places(length):
        h[: max(0, len(raw) - at)] ^= eight[at:]
        h *= np.uint64(0x9E3779B97F4A7C15)
        np.right_shift(h, np.uint64(29), out=spare)
        h ^= spare
    return mix64(h)


def second_hashes(eight: np.ndarray, length: int, bits: int) -> np.ndarray:
    """`bits` more, from a polynomial over the same lanes."""
    h = np.full(len(eight), np.uint64(0x13198A2E03707344))
    for at in lane_places(length):
        h *= np.uint64(0xD1342543DE82EF95)
        h[: max(0, len(eight) - at)] += eight[at:]
    return mix64(h) >> np.uint64(64 - bits)


def more_bits(size: int) -> int:
    """Bits beyond 64 that tell so many strings apart, but for a chance of one in a million."""
    return min(62, max(8, 2 * int(size).bit_length() + 20 - 64))


def lane_places(length: int) -> list[int]:
    return sorted({*range(0, length - 7, 8), length - 8})


def slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over x[i : i + width]; shorter at the end."""
    out, span = x.copy(), 1
    while span < width:
        step = min(span, width - span, len(out))
        if not step:
            break
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        span += step
    return out


def anchors(raw: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the runs of windows with one anchor; room tells which windows lie within a document."""
    least = np.where(room, slide(string_hashes(raw, ANCHOR) | np.uint64(1), LENGTH - ANCHOR + 1, np.minimum), np.uint64(0))
    edge = np.flatnonzero(np.diff(least, prepend=np.uint64(0), append=np.uint64(0)))
    start, end = edge[:-1], edge[1:]
    full = least[start] > 0
    return start[full], end[full], least[start[full]]


def windows_inside(offsets: np.ndarray) -> np.ndarray:
    """Whether a window of LENGTH bytes from each position stays within its document."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(offsets[-1]) + LENGTH <= ends


def anchor_keys(h: np.ndarray, bits: int) -> np.ndarray:
    return mix64(h) >> np.uint64(64 - bits)


class Chunk:
    """The texts of a chunk, in an order that does not depend on how they came, and the anchors of those that no equal text of a smaller id precedes."""

    def __init__(self, table: pa.Table):
        ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        first: dict[bytes, int] = {}
        self.copy = []
        for i, t in zip(self.ids, self.texts, strict=True):
            f = first.setdefault(t, i)
            self.copy.append(i is not None and f is not None and f < i)
        self.rest = np.array([k for k, (c, i) in enumerate(zip(self.copy, self.ids, strict=True)) if not c and i is not None], np.int64)

    def windows(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end, key) of the runs of windows with one anchor; positions count from the document's start."""
        out = []
        offsets = np.concatenate([[0], np.cumsum([len(self.texts[k]) for k in self.rest], dtype=np.int64)])
        for lo, hi in slices(offsets, STEP_BYTES):
            raw, bounds = np.frombuffer(b"".join(self.texts[k] for k in self.rest[lo:hi]), np.uint8), offsets[lo : hi + 1] - offsets[lo]
            start, end, h = anchors(raw, windows_inside(bounds))
            # equal neighbours may make a run go on into the next document
            doc = np.searchsorted(bounds, start, side="right") - 1
            last = np.searchsorted(bounds, end - 1, side="right") - 1
            out.append((self.rest[lo + doc], start - bounds[doc], end - bounds[doc], anchor_keys(h, bits)))
            assert (doc == last).all()
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none.astype(np.uint64))

    @staticmethod
    def keys(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct keys, place of each key among them, whether two documents of the chunk have it)."""
        distinct, place = np.unique(key, return_inverse=True)
        low, high = np.full(len(distinct), 1 << 60), np.full(len(distinct), -1)
        np.minimum.at(low, place, doc)
        np.maximum.at(high, place, doc)
        return distinct, place, high > low


def key_bits(text_bytes: int) -> int:
    """Bits of an anchor key: 16 more than count the anchors, so that one in some 65,000 collides."""
    return min(63, max(32, int(text_bytes // 8).bit_length() + 16))


def ask_anchors(dealt: DataFrame, ranges: int, bits: int) -> DataFrame:
    schema = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("shared", pa.binary())])

    def ask(table: pa.Table) -> pa.Table:
        doc, _, _, key = Chunk(table).windows(bits)
        keys, _, shared = Chunk.keys(doc, key)
        chunk, bounds = table["chunk"][0].as_py(), cut(keys, ranges, bits)
        rows = [(r, chunk, squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(np.packbits(shared[a:b]))) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    return dealt.groupBy("chunk").applyInArrow(ask, "range int, chunk int, keys binary, shared binary")


def answer_anchors(asked: DataFrame) -> DataFrame:
    """(chunk, range, shared): one bit for each key that a chunk asked for, set if two documents have it."""

    def add(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(stretch(b.as_py(), "<u8"), dtype=np.uint64) for b in table["keys"]]
        shared = [np.unpackbits(stretch(b.as_py(), "u1"), count=len(k)).astype(bool) for b, k in zip(table["shared"], keys, strict=True)]
        _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        several = count > 1
        several[place[np.concatenate(shared)]] = True
        bits = np.split(several[place], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table([table["chunk"], table["range"], pa.array([squeeze(np.packbits(b)) for b in bits], pa.binary())], names=["chunk", "range", "shared"])

    return asked.groupBy("range").applyInArrow(add, "chunk int, range int, shared binary")


def read_bits(answer: pa.Table, keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """The answered bits of sorted keys, put together from the ranges."""
    out, bounds = np.zeros(len(keys), bool), cut(keys, ranges, bits)
    for r, blob in zip(answer["range"].to_pylist(), answer["bits" if "bits" in answer.schema.names else "shared"], strict=True):
        a, b = bounds[r], bounds[r + 1]
        out[a:b] = np.unpackbits(stretch(blob.as_py(), "u1"), count=b - a)
    return out


def candidates(dealt: DataFrame, answers: DataFrame, ranges: int, bits: int) -> DataFrame:
    """(chunk, k, doc_id, starts, lengths, data): the pieces of a chunk's k-th document whose windows may occur elsewhere, one after another in data."""
    schema = pa.schema([("chunk", pa.int32()), ("k", pa.int32()), ("doc_id", pa.int64()), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("data", pa.binary())])

    def find(key, table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        chunk = Chunk(table)
        doc, start, end, key_of = chunk.windows(bits)
        keys, place, _ = Chunk.keys(doc, key_of)
        live = read_bits(answer, keys, ranges, bits)[place]
        doc, start, end = doc[live], start[live], end[live] - 1 + LENGTH
        if not len(doc):
            return schema.empty_table()
        # runs come in order of documents and places; pieces that touch become one
        new = np.ones(len(doc), bool)
        new[1:] = (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        doc, start, length = doc[first], start[first], end[np.append(first[1:], len(end)) - 1] - start[first]
        rows = []
        number = table["chunk"][0].as_py()
        bounds = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            k = int(doc[a])
            text = chunk.texts[k]
            rows.append((number, k, chunk.ids[k], start[a:b], length[a:b], b"".join([text[x : x + n] for x, n in zip(start[a:b].tolist(), length[a:b].tolist(), strict=True)])))
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(find, "chunk int, k int, doc_id long, starts array<int>, lengths array<int>, data binary")


def suffix_array(symbols: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) by Larsson-Sadakane refinement.

    symbols are bytes plus one; 0 ends a piece and differs from every other 0. stop is
    each position's piece end. Suffixes start out in groups by their first seven
    symbols; each round sorts the groups that still have several members by the group
    of the suffix twice as far on, and leaves sorted ones alone.
    """
    n = len(symbols)
    # seven bytes, first ones highest, none from beyond the piece; then how many there are, so that an end sorts before a zero byte
    left = np.minimum(stop - np.arange(n), 7).astype(np.uint64)
    key = lanes(np.where(symbols > 0, symbols - 1, 0).astype(np.uint8)).byteswap()
    key &= ~(~np.uint64(0) >> (left * np.uint64(8)))
    key |= left
    sa = np.argsort(key)
    # ends of pieces sort first and are told apart by their place at once
    ends = int((symbols == 0).sum())
    sa[:ends].sort()
    ordered = key[sa]
    start = np.ones(n, bool)
    start[1:] = ordered[1:] != ordered[:-1]
    start[:ends] = True
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    span = 7
    while True:
        alone = start & np.append(start[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return sa, rank
        who = sa[open_]
        far = rank[np.minimum(who + span, stop[who])]
        order = np.argsort((rank[who].astype(np.uint64) << np.uint64(32)) | far.astype(np.uint64))
        group, who, far = rank[who][order], who[order], far[order]
        sa[open_] = who
        new = np.ones(len(open_), bool)
        new[1:] = (group[1:] != group[:-1]) | (far[1:] != far[:-1])
        start[open_] = new
        rank[who] = np.maximum.accumulate(np.where(new, open_, 0))
        span *= 2


def common_prefixes(symbols: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the suffix array (0 for the first), by Kasai's rule.

    In text order, a suffix whose neighbour's previous byte equals its own shares one
    byte less than the suffix before it; only the others are compared, eight bytes at a
    time, and the rest follow from the last compared one.
    """
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    carried = np.zeros(n, bool)
    inner = (before > 0) & (place > 0)
    i = place[inner]
    carried[inner] = (symbols[i - 1] == symbols[before[i] - 1]) & (symbols[i - 1] > 0)
    shared = np.zeros(n, np.int64)
    eight = lanes(np.where(symbols > 0, symbols - 1, 0).astype(np.uint8))
    stop = np.minimum.accumulate(np.where(symbols == 0, place, n)[::-1])[::-1]
    live = np.flatnonzero(~carried & (before >= 0))
    room = np.minimum(stop[live] - live, stop[before[live]] - before[live])
    while len(live):
        have = shared[live]
        apart = eight[np.minimum(live + have, n - 1)] ^ eight[np.minimum(before[live] + have, n - 1)]
        # bytes below the lowest bit that differs; eight if none does
        same = (np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        reach = np.minimum(have + same, room)
        shared[live] = reach
        going = (same == 8) & (reach < room)
        live, room = live[going], room[going]
    compared = np.maximum.accumulate(np.where(carried, 0, place))
    permuted = shared[compared] - (place - compared)
    return np.maximum(permuted, 0)[sa]


class Shard:
    """The candidate pieces of a shard in blocks, one after another, each followed by an end mark.

    A block starts BLOCK_WINDOWS windows, and goes on for the rest of the last of them;
    so each window is in one block, and no common prefix is much longer than a block.
    """

    def __init__(self, table: pa.Table):
        columns = [table[c].to_pylist() for c in ("doc_id", "chunk", "k", "starts", "lengths", "data")]
        self.rows = sorted(zip(*columns, strict=True))
        row = np.repeat(np.arange(len(self.rows)), [len(r[3]) for r in self.rows])
        start = np.array([a for r in self.rows for a in r[3]], np.int64)
        length = np.array([n for r in self.rows for n in r[4]], np.int64)
        before = np.cumsum(length) - length
        blocks = np.maximum(1, -(-(length - LENGTH + 1) // BLOCK_WINDOWS))
        piece = np.repeat(np.arange(len(length)), blocks)
        offset = (np.arange(len(piece)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK_WINDOWS
        size = np.minimum(length[piece] - offset, BLOCK_WINDOWS + LENGTH - 1)
        self.first = np.concatenate([[0], np.cumsum(size + 1)])
        #: Row of each block, and where in the row's text it starts.
        self.row, self.start = row[piece], start[piece] + offset
        stop = self.first[1:] - 1
        self.stop = np.repeat(stop, size + 1)
        inside = np.arange(self.first[-1]) - np.repeat(self.first[:-1], size + 1)
        data = np.frombuffer(b"".join(r[5] for r in self.rows), np.uint8)
        source = np.minimum(np.repeat(before[piece] + offset, size + 1) + inside, max(0, len(data) - 1))
        self.raw = data[source] if len(data) else np.zeros(len(inside), np.uint8)
        self.raw[stop] = 0
        self.symbols = self.raw.astype(np.uint16) + 1
        self.symbols[stop] = 0
        self.doc = np.repeat(np.array([r[0] for r in self.rows], np.int64)[self.row], size + 1)
        self.room = np.arange(len(self.raw)) + LENGTH <= self.stop

    def hashes(self, at: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, `more` bits of second ones) of the windows at the positions `at`."""
        first, second = np.empty(len(self.raw), np.uint64), np.empty(len(self.raw), np.uint64)
        for a in range(0, len(self.raw), STEP_BYTES):
            part = self.raw[a : a + STEP_BYTES + LENGTH]
            eight, n = lanes(part), min(STEP_BYTES, len(self.raw) - a)
            first[a : a + n] = string_hashes(part, LENGTH, eight)[:n]
            second[a : a + n] = second_hashes(eight, LENGTH, more)[:n]
        return first[at], second[at]

    def local(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions whose LENGTH bytes an earlier document of the shard has, one position of each run, its smallest doc_id)."""
        sa, _ = suffix_array(self.symbols, self.stop)
        shared = common_prefixes(self.symbols, sa)
        begins = np.flatnonzero(shared < LENGTH)
        least = np.minimum.reduceat(self.doc[sa], begins)
        covered = np.zeros(len(sa), bool)
        covered[sa] = self.doc[sa] > np.repeat(least, np.diff(np.append(begins, len(sa))))
        heads = sa[begins]
        full = self.room[heads]
        return covered & self.room, heads[full], least[full]


def by_hashes(h: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The order of strings by both hashes."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    # strings of one first hash are rare, unless they are the same
    return np.lexsort((h2, h)) if (same & (h2[order][1:] != h2[order][:-1])).any() else order


def distinct(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h, h2 of the distinct strings in order, order of all strings, where each distinct one begins in it)."""
    order = by_hashes(h, h2)
    a, b = h[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begins = np.flatnonzero(new)
    return a[begins], b[begins], order, begins


def look_up(h: np.ndarray, h2: np.ndarray, key: np.ndarray, key2: np.ndarray) -> np.ndarray:
    """Places of strings in a sorted list of distinct strings that holds them all, by binary search."""
    at = np.searchsorted(h, key)
    while len(wrong := np.flatnonzero(h2[at] != key2)):
        at[wrong] += 1
    return at


def in_shards(found: DataFrame, ranges: int, more: int) -> DataFrame:
    """(place, shard, keys, second, docs, who): in places from 0 on, the key ranges, sorted hashes of each shard's distinct strings, doc_ids, and which of these is the smallest of each string; below 0, at a place of its own, the positions that the shard itself covers."""
    schema = pa.schema([("place", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("keys", "second", "docs", "who"))])

    def sort(table: pa.Table) -> pa.Table:
        shard = Shard(table)
        covered, heads, least = shard.local()
        h, h2 = shard.hashes(heads, more)
        order = by_hashes(h, h2)
        h, h2, least = h[order], h2[order], least[order]
        number, bounds = table["shard"][0].as_py(), cut(h, ranges, 64)
        rows = [(-1 - number, number, squeeze(np.packbits(covered)), b"", b"", b"")]
        for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if a < b:
                docs, who = np.unique(least[a:b], return_inverse=True)
                rows.append((r, number, squeeze(np.diff(h[a:b], prepend=np.uint64(0))), squeeze_counts(h2[a:b]), squeeze(np.diff(docs, prepend=0)), squeeze_counts(who)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return found.groupBy("shard").applyInArrow(sort, "place int, shard int, keys binary, second binary, docs binary, who binary")


def merge_shards(sorted_: DataFrame) -> DataFrame:
    """(shard, range, bits): for each string of a shard, whether a smaller doc_id has it elsewhere; in range -1, the shard's own positions.

    The lists of a range become one sorted list of strings with the smallest doc_id of
    each, in which every shard looks its own up by binary search.
    """

    def merge(table: pa.Table) -> pa.Table:
        place = table["place"][0].as_py()
        if place < 0:
            return pa.table([table["shard"], pa.array([-1] * table.num_rows, pa.int32()), table["keys"]], names=["shard", "range", "bits"])
        lists = []
        for keys, second, docs, who in zip(*(table[c] for c in ("keys", "second", "docs", "who")), strict=True):
            lists.append((np.cumsum(stretch(keys.as_py(), "<u8"), dtype=np.uint64), stretch_counts(second.as_py()).astype(np.uint64), np.cumsum(stretch(docs.as_py(), "<i8"))[stretch_counts(who.as_py())]))
        h, h2, order, begins = distinct(*(np.concatenate([x[c] for x in lists]) for c in (0, 1)))
        first = np.minimum.reduceat(np.concatenate([x[2] for x in lists])[order], begins)
        bits = [squeeze(np.packbits(first[look_up(h, h2, key, key2)] < doc)) for key, key2, doc in lists]
        return pa.table([table["shard"], pa.array([place] * len(bits), pa.int32()), pa.array(bits, pa.binary())], names=["shard", "range", "bits"])

    return sorted_.groupBy("place").applyInArrow(merge, "shard int, range int, bits binary")


def removed_runs(found: DataFrame, merged: DataFrame, ranges: int, more: int) -> DataFrame:
    """(chunk, k, starts, ends): the byte runs that a chunk's k-th document loses; documents that lose nothing are left out."""
    schema = pa.schema([("chunk", pa.int32()), ("k", pa.int32()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def apply(key, table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        shard = Shard(table)
        place = answer["range"].to_pylist()
        covered = np.unpackbits(stretch(answer["bits"][place.index(-1)].as_py(), "u1"), count=len(shard.raw)).astype(bool)
        at = np.flatnonzero(shard.room)
        h, _, order, begins = distinct(*shard.hashes(at, more))
        earlier = read_bits(answer.filter(pa.array([r != -1 for r in place])), h, ranges, 64)
        covered[at[order]] |= np.repeat(earlier, np.diff(np.append(begins, len(order))))
        # windows that begin where the row's text is covered; blocks of a piece follow one another
        at = np.flatnonzero(covered)
        block = np.searchsorted(shard.first, at, side="right") - 1
        row, start = shard.row[block], shard.start[block] + at - shard.first[block]
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + LENGTH)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(at)) - 1
        lost = row[begin]
        bounds = np.flatnonzero(np.diff(lost, prepend=-1, append=-1)).tolist()
        starts, ends = start[begin].tolist(), (start[last] + LENGTH).tolist() if len(at) else []
        rows = [(shard.rows[lost[a]][1], shard.rows[lost[a]][2], starts[a:b], ends[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()

    return found.groupBy("shard").cogroup(merged.groupBy("shard")).applyInArrow(apply, "chunk int, k int, starts array<int>, ends array<int>")


def cut_texts(dealt: DataFrame, removed: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, n_bytes, starts and ends of removed runs, sha of what is left, and, if wanted, what is left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("sha", pa.string()), ("kept", pa.binary())])

    def apply(key, table: pa.Table, runs: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        chunk = Chunk(table)
        lost = {k: (a, b) for k, a, b in zip(runs["k"].to_pylist(), runs["starts"].to_pylist(), runs["ends"].to_pylist(), strict=True)}
        rows = []
        for k, (doc_id, text, copy) in enumerate(zip(chunk.ids, chunk.texts, chunk.copy, strict=True)):
            starts, ends = ([0], [len(text)]) if copy and len(text) >= LENGTH else lost.get(k, ([], []))
            kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)) if starts else text
            rows.append((doc_id, len(text), starts, ends, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return dealt.groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInArrow(apply, "doc_id long, n_bytes long, starts array<int>, ends array<int>, sha string, kept binary")


def parts(keys: float, least: int) -> int:
    """Key ranges for so many keys."""
    return max(1, min(least, FEW_RANGES), -(-int(keys) // RANGE_KEYS))


def repeated_strings(documents: DataFrame, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, starts, ends, sha (and kept): for every document the byte runs that strings of LENGTH bytes from documents with smaller ids cover.

    Null texts are empty. A document with a null id loses nothing and takes nothing.
    Rows with equal ids do not count as earlier than each other; each gets a row. Texts
    under LENGTH bytes stay. Columns other than doc_id and text are not read, so their
    names matter nothing. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    # texts under LENGTH bytes hold no string that counts, so however frequent they are, they stay out of everything below
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    short = every.where(F.octet_length("text") < LENGTH)
    hashed = every.where(F.octet_length("text") >= LENGTH).withColumn("h", F.xxhash64("text"))
    sizes = hashed.select("h", F.octet_length("text").cast("long").alias("n"), F.xxhash64(F.lit(1), "text").alias("c"), "doc_id").groupBy("h", "c", "n").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first"))
    sizes = stored(sizes, "texts")
    total = sizes.agg(F.sum(F.col("rows") * F.col("n"))).first()[0] or 0
    # texts whose copies would fill half a chunk: at most two for each chunk. The copies go as a whole, as any chunk that held them would find
    hot = sizes.where(F.col("rows") * F.col("n") > chunk_bytes // 2).where("rows > 1").select("h", F.col("c").alias("other"), F.col("n").alias("size"), "first")
    hot = stored(hot, "hot")
    # Spark broadcasts the stored table if it is small, and else splits what is hot
    marked = hashed.join(hot, "h", "left")
    is_copy = F.coalesce((F.xxhash64(F.lit(1), "text") == F.col("other")) & (F.octet_length("text") == F.col("size")) & (F.col("doc_id") > F.col("first")), F.lit(False))
    chunks = max(1, -(-total // chunk_bytes))
    dealt = marked.where(~is_copy).select("doc_id", F.col("text").cast("binary").alias("text"), F.pmod("h", F.lit(chunks)).cast("int").alias("chunk"))
    whole = marked.where(is_copy).select("doc_id", F.col("size").cast("long").alias("n_bytes"))
    bits, ranges = key_bits(total), parts(total / ((LENGTH - ANCHOR + 2) / 2), chunks)
    answers = stored(answer_anchors(ask_anchors(dealt, ranges, bits)), "anchors")
    found = stored(candidates(dealt, answers, ranges, bits), "candidates")
    size = found.agg(F.sum(F.length("data").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    ranges, more = parts(size, shards), more_bits(size)
    sharded = found.withColumn("shard", F.pmod(F.xxhash64("chunk", "k"), F.lit(shards)).cast("int"))
    merged = stored(merge_shards(in_shards(sharded, ranges, more)), "shards")
    removed = stored(removed_runs(sharded, merged, ranges, more), "removed")
    done = cut_texts(dealt, removed, with_text)
    empty = hashlib.sha256(b"").hexdigest()
    copies = whole.select("doc_id", "n_bytes", F.array(F.lit(0)).alias("starts"), F.array(F.col("n_bytes").cast("int")).alias("ends"), F.lit(empty).alias("sha"), F.lit(None).cast("binary").alias("kept"))
    none = F.array().cast("array<int>")
    left = short.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("starts"), none.alias("ends"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.col("text").cast("binary").alias("kept"))
    out = done.unionByName(copies).unionByName(left)
    return out if with_text else out.drop("kept")


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    removed = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (s, x) -> s + x)")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
