"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by at most k = ratio * m edits. Of
its k + 1 pieces one at least is then untouched in the passage, so an Aho-Corasick
scan for pieces finds every passage, and Myers' bit-parallel distance verifies it.
"""

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, split_batches, worker_state

#: Edits allowed for each character of an item.
RATIO = 0.1
#: Normalised items with fewer characters must stand in a text exactly, and as whole words.
SHORT_CHARS = 20
#: Characters of items that one scan over the documents carries; more items take more scans.
BLOCK_CHARS = 4 << 20
#: Hits of an item as dense as one in so many characters are verified by one pass over where they stand.
DENSE = 32

_GAPS = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case, and one space for each run of anything but letters and digits."""
    return _GAPS.sub(" ", (text or "").lower()).strip()


def budget(m: int, ratio: float = RATIO) -> int:
    return int(m * ratio)


def unspaced(c: str) -> bool:
    """Whether a character is of a script that sets no spaces between words: Chinese, Japanese, Thai and their like."""
    return "\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u2e80" <= c <= "\ua4cf" or "\uf900" <= c <= "\ufaff" or c >= "\U00020000"


def on_borders(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins and ends where words do."""
    return all(x == " " or y == " " or unspaced(x) or unspaced(y) for x, y in ((text[start - 1 : start] or " ", text[start]), (text[end - 1], text[end : end + 1] or " ")))


def pieces(item: str, k: int) -> Iterator[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of near equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield a, item[a:b]


def character_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to a substring of text, and where the first such ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds items in normalised texts.

    Hits of an item stand in regions, whose neighbourhoods touch. In a region, a hit is
    verified from its piece upwards: of a passage within its budget, one piece is
    untouched, and so is, for each doubling of its neighbourhood to j pieces, j - 1 edits
    enough (were both halves of a range over theirs, so would be the whole). Chance hits
    mostly end at two pieces. Where a hit holds, or hits are dense, one pass of Myers'
    distance over the region gives its best passage, so the time is linear in the text
    however repetitive it is. Items of under `short` characters must stand exactly, and
    begin and end where words do.
    """

    def __init__(self, items: list[tuple[int | None, str]], ratio: float = RATIO, short: int = 0):
        self.items = [(i, t, budget(len(t), ratio) if len(t) >= short else 0) for i, t in items]
        self.short = short
        at: dict[str, list[tuple[int, int, int]]] = {}
        self.cuts: list[list[int]] = []
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        for n, (_, text, k) in enumerate(self.items):
            self.cuts.append([o for o, _ in pieces(text, k)] + [len(text)])
            for i, (offset, piece) in enumerate(pieces(text, k)):
                at.setdefault(piece, []).append((n, i, offset))
        self.automaton = ahocorasick.Automaton()
        self.places = list(at.values())
        for p, piece in enumerate(at):
            self.automaton.add_word(piece, (p, len(piece)))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    @staticmethod
    def ranges(i: int, n: int) -> list[tuple[int, int]]:
        """The ranges of pieces around piece i, from two or three pieces up to half of all n or more."""
        lo, hi, out = 0, n, []
        while hi - lo > 1:
            out.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if i < mid else (mid, hi)
        return out[:0:-1]

    def distance(self, n: int, a: int, b: int, text: str) -> tuple[int, int]:
        """myers() of characters a to b of item n."""
        masks = self.masks.get((n, a, b))
        if masks is None:
            masks = self.masks[n, a, b] = character_masks(self.items[n][1][a:b])
        return myers(masks, b - a, text)

    def holds(self, n: int, i: int, guess: int, text: str, seen: dict) -> bool:
        """Whether the ranges around piece i may stand where the item would begin near guess; seen remembers them."""
        cuts = self.cuts[n]
        for a, b in self.ranges(i, len(cuts) - 1):
            key = (a, b, guess)
            if key not in seen:
                k, lo, hi = b - a - 1, cuts[a], cuts[b]
                seen[key] = self.distance(n, lo, hi, text[max(0, guess + lo - k) : guess + hi + k])[0] <= k
            if not seen[key]:
                return False
        return True

    def best(self, n: int, hits: list[tuple[int, int, list[int]]], text: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best passage of item n, the first of equals; hits are (piece, its offset, where it stands)."""
        _, item, k = self.items[n]
        m = len(item)
        if m < self.short:
            start = next((g for g in hits[0][2] if on_borders(text, g, g + m)), None)
            return None if start is None else (0, start, start + m)
        # an exact passage has all pieces
        if len(hits) > k:
            start = text.find(item)
            if start >= 0:
                return 0, start, start + m
        if not k:
            return None
        total = sum([len(at) for _, _, at in hits])
        if total * DENSE > m:
            low, high = max(0, min(at[0] - offset for _, offset, at in hits) - k), max(at[-1] - offset for _, offset, at in hits) + m + k
            if total * DENSE > high - low:
                distance, end = self.distance(n, 0, m, text[low:high])
                return (distance, max(0, low + end - m - k), low + end) if distance <= k else None
        elif total == 1:
            # most are chance hits that go no further
            i, offset, at = hits[0]
            if not self.holds(n, i, at[0] - offset, text, {}):
                return None
        order, found, lo = sorted({(a - offset, i) for i, offset, at in hits for a in at}), None, 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and order[hi][0] - order[hi - 1][0] <= m + 2 * k:
                hi += 1
            first, last = max(0, order[lo][0] - k), order[hi - 1][0] + m + k
            seen: dict = {}
            if (hi - lo) * DENSE > last - first or any(self.holds(n, i, g, text, seen) for g, i in order[lo:hi]):
                distance, end = self.distance(n, 0, m, text[first:last])
                if distance <= k and (found is None or distance < found[0]):
                    found = (distance, max(0, first + end - m - k), first + end)
            lo = hi
        return found

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, start, end) of the best passage of each item within its budget; start is where the passage was looked for from."""
        if not self.any:
            return []
        at: dict[int, list[int]] = {}
        for end, (p, length) in self.automaton.iter(text):
            at.setdefault(p, []).append(end + 1 - length)
        hits: dict[int, list[tuple[int, int, list[int]]]] = {}
        for p, starts in at.items():
            for n, i, offset in self.places[p]:
                hits.setdefault(n, []).append((i, offset, starts))
        out = []
        for n, some in hits.items():
            found = self.best(n, some, text)
            if found:
                out.append((self.items[n][0], *found))
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Normalised items in blocks of about BLOCK_CHARS characters; only one block is on the driver at a time.

    Items without a letter or digit, and null ones, have nothing to look for. An item
    without an id has a null one, unless an item with an id has the same text.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        named = {r["text"] for r in rows if r["item_id"] is not None}
        found = {(r["item_id"], t) for r in rows if (r["item_id"] is not None or r["text"] not in named) and (t := normalise(r["text"]))}
        block = sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if block:
            yield block


def worker_matcher(name: str, block: list[tuple[int | None, str]], ratio: float) -> Matcher:
    """One matcher for a Python worker, kept between its tasks."""
    kept = worker_state()
    if kept.get("matcher", (None, None))[0] != name:
        kept["matcher"] = (name, Matcher(block, ratio, SHORT_CHARS))
    return kept["matcher"][1]


def find_leaks(documents: DataFrame, benchmark: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(doc_id, item_id, distance, start, end): every document and item within the item's error budget, with the best passage in the normalised text.

    Of equally good passages the first counts. Items are taken in blocks of bounded size;
    each block is one pass over the documents, which are never shuffled. Items under
    SHORT_CHARS characters must stand exactly, as whole words. Null and empty texts match
    nothing, and neither do items without a letter or digit; an item without an id is
    looked for, too, and has a null one unless an item with an id has its text. Repeated documents give repeated results, repeated items
    do not; a null doc_id stays null. Other columns are not read, so their names matter
    nothing. Without documents or items the result is empty.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    schema = "doc_id long, item_id long, distance int, start int, end int"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block, ratio))

        def look(batches, shared=shared):
            matcher = worker_matcher(*shared.value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            for batch in split_batches(batches, 1):
                found = [(doc_id, *f) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in matcher.find(normalise(text))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

        out = out.unionByName(rows.mapInArrow(look, schema))
    return out


def clean(documents: DataFrame, benchmark: DataFrame, ratio: float = RATIO) -> DataFrame:
    """documents without those that hold an item, all columns as they were, whatever their names.

    Each row is judged by its own text: a null or empty text stays. Rows are neither
    shuffled nor joined. Without documents the result is empty, without items nothing goes.
    """
    spark, at = documents.sparkSession, documents.columns.index("text")
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block, ratio))

        def keep(batches, shared=shared):
            matcher = worker_matcher(*shared.value)
            for batch in split_batches(batches, at):
                yield batch.filter(pa.array([not matcher.find(normalise(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        documents = map_rows(documents, keep)
    return documents
