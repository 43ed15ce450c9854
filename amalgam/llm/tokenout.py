"""Token ids as Simple-8b files.

A file is a Parquet table of blocks, so Spark's commit protocol makes a lost task
harmless and any store that Spark reaches can hold it. A block's body is binary:

    magic b"AS8B", then little-endian
    uint64 n_docs, n_ids, n_words, n_escapes
    int64  doc_id[n_docs]
    uint8  doc_id_is_null[n_docs], padded to a multiple of 8 bytes
    uint64 id_offset[n_docs + 1], word_offset[n_docs + 1]
    uint64 words[n_words], escapes[n_escapes]

Each document starts a word. A word holds a selector in its top four bits and as many
ids as the selector says in the other 60, lowest first; a document's last word may
have room to spare. Selector 0 stands for an id of over 60 bits, which is in the
block's escapes at the place that the payload gives. So a block decodes without
looking at its words one after another.
"""

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import BATCH_ROWS, WRITING, settings
from .common import scratch, split_batches, stored, utf8, worker_state

#: Ids per word and bits per id of the selectors 1 to 15. Selector 0 is the escape.
COUNTS = [1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]

MAGIC = b"AS8B"
#: Words whose ids a worker remembers.
CACHE_WORDS = 500_000
#: Bytes of text that one block should get, and those that one file part should get.
BLOCK_BYTES = 1 << 20
PART_BYTES = 32 << 20


#: Bits that the ids below 65,536 need.
_NEED = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)


def pack(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offsets of the documents, escapes) of uint64 ids; document i has ids[offsets[i]:offsets[i+1]]."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.uint64), np.zeros(0, np.uint64)
    large = ids >> np.uint64(60) != 0
    need = _NEED[ids] if int(ids.max()) < len(_NEED) else np.where(large, 64, np.minimum(np.frexp(ids.astype(np.float64))[1], 60)).astype(np.int8)
    lengths = np.diff(offsets)
    end = np.repeat(offsets[1:].astype(np.int32), lengths)
    place = np.arange(n, dtype=np.int32)
    # after each document as many zeros as a word may hold: room to spare fits any selector
    spare = max(COUNTS)
    spread = place + np.repeat(np.arange(len(lengths), dtype=np.int32) * spare, lengths)
    widest = np.zeros(n + spare * len(lengths) + spare, np.int8)
    widest[spread] = need
    # widest[i] becomes the most bits of ids i to i + span - 1, span by span; where a selector fits, so do all wider ones
    fitting, span = np.zeros(len(widest), np.uint8), 1
    for s in range(15, 0, -1):
        while span < COUNTS[s]:
            step = min(span, COUNTS[s] - span)
            widest[:-step] = np.maximum(widest[:-step], widest[step:])
            span += step
        fitting += widest <= BITS[s]
    selector = (16 - fitting[spread]) & 15
    # where the word after one that starts at an id would start; four words at a time are walked, as only that is a loop
    after = np.append(np.minimum(place + np.asarray(COUNTS, np.int32)[selector], end), np.int32(n))
    second = after[after]
    fourth, starts, i = memoryview(second[second]), [], 0
    while i < n:
        starts.append(i)
        i = fourth[i]
    first = np.array(starts)
    at = np.stack([first, after[first], second[first], after[second[first]]], axis=1).ravel()
    at = at[at < n]
    chosen = selector[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    values = np.zeros(len(widest), np.uint64)
    values[spread] = ids
    for s in range(1, 16):
        group = np.flatnonzero(chosen == s)
        if not BITS[s] or not len(group):
            continue
        place_of, word = spread[at[group]], words[group]
        for k in range(COUNTS[s]):
            word |= values[place_of + k] << np.uint64(k * BITS[s])
        words[group] = word
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, np.searchsorted(at, offsets).astype(np.uint64), ids[at[escaped]]


def unpack(words: np.ndarray, word_offsets: np.ndarray, id_offsets: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids that pack() was given."""
    ids = np.zeros(int(id_offsets[-1]), np.uint64)
    if not len(words):
        return ids
    wo, io = word_offsets.astype(np.int64), id_offsets.astype(np.int64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(np.asarray(COUNTS)[chosen])])
    per = np.diff(wo)
    at = np.repeat(io[:-1] - before[wo[:-1]], per) + before[:-1]
    end = np.repeat(io[1:], per)
    for s in range(1, 16):
        group = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]) if BITS[s] and len(group) else ():
            p = at[group] + k
            live = p < end[group]
            if not live.any():
                break
            ids[p[live]] = (words[group[live]] >> np.uint64(k * BITS[s])) & mask
    escaped = np.flatnonzero(chosen == 0)
    ids[at[escaped]] = escapes[words[escaped].astype(np.int64)]
    return ids


def block(doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """Body of a block."""
    words, word_offsets, escapes = pack(ids.astype(np.uint64), offsets)
    n = len(doc_ids)
    null = np.zeros(-(-n // 8) * 8, np.uint8)
    null[:n] = doc_ids.is_null().to_numpy(zero_copy_only=False)
    parts = [np.array([n, len(ids), len(words), len(escapes)], "<u8"), doc_ids.fill_null(0).to_numpy().astype("<i8"), null, offsets.astype("<u8"), word_offsets.astype("<u8"), words.astype("<u8"), escapes.astype("<u8")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def parse(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, which of them are null, ids, id offsets) of a block's body."""
    if body[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    n, n_ids, n_words, n_escapes = (int(x) for x in np.frombuffer(body, "<u8", 4, 4))
    at = 36
    out = []
    for kind, size in (("<i8", n), ("u1", -(-n // 8) * 8), ("<u8", n + 1), ("<u8", n + 1), ("<u8", n_words), ("<u8", n_escapes)):
        out.append(np.frombuffer(body, kind, size, at))
        at += out[-1].nbytes
    doc_ids, null, id_offsets, word_offsets, words, escapes = out
    return doc_ids, null[:n].astype(bool), unpack(words, word_offsets, id_offsets, escapes), id_offsets.astype(np.int64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1 for ASCII letters, 2 for ASCII punctuation and digits.
_SORT = np.zeros(256, np.uint8)
_SORT[33:127] = 2
_SORT[97:123] = 1


def parted(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) in lower case, with a space between each ASCII or Latin-1 letter and ASCII punctuation or a digit after it.

    There a piece ends in every pattern that separable() admits.
    """
    low = _LOWER[raw]
    sort = _SORT[low]
    letter = sort == 1
    # the second byte of a Latin-1 letter; 0x97 and 0xB7 are the signs of multiplication and division
    letter[1:] |= (low[:-1] == 0xC3) & (low[1:] != 0x97) & (low[1:] != 0xB7)
    ends = np.zeros(len(low) + 1, np.int64)
    np.cumsum(letter[:-1] & (sort[1:] == 2), out=ends[2:])
    out = np.full(len(low) + int(ends[-1]), 0x20, np.uint8)
    out[np.arange(len(low)) + ends[1:]] = low
    return out, offsets + ends[offsets]


#: A key that no piece has, as pieces hold no white space.
END = b" "
#: Matches pieces of letters that no other step than lower case changes and no pattern of separable() divides, whatever stands between them: a to z and the letters of Latin-1.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


class WordEncoder:
    """Ids of whole texts by a tokenizer that neither joins nor splits differently across ASCII white space.

    The text is cut at ASCII white space, and each distinct piece is given to the
    library once; separable() tells whether a tokenizer allows that. Such a tokenizer
    lower-cases, so pieces meet in lower case, unless a combining mark or an added
    token could make a difference.
    """

    def __init__(self, tokenizer_json: str, cached: bool, end_id: int = 0, limit: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.cached, self.end_id, self.limit = cached, end_id, limit
        #: How ids are held: two bytes are enough for most vocabularies.
        self.kind = "<u2" if max(end_id, *self.tokenizer.get_vocab().values()) < 1 << 16 else "<u4"
        # a control character that is one id lets one call encode many pieces
        mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.mark_id = mark[0] if len(mark) == 1 else None
        self.added = [t[1].content.encode() for t in self.tokenizer.get_added_tokens_decoder().items()]
        self.model, self.forms = self.tokenizer.model, self.letter_forms() if cached else {}
        self.forget()

    def letter_forms(self) -> dict[int, str]:
        """What the model gets for each letter of PLAIN; empty if a run of such letters may be more than one piece to the library."""
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        letters = [x for x in map(chr, range(256)) if PLAIN(x.encode())]
        forms = [self.tokenizer.pre_tokenizer.pre_tokenize_str(normal(x)) for x in letters]
        if any(PLAIN(normal(t.decode()).encode()) for t in self.added) or any(len(f) != 1 for f in forms):
            return {}
        return {ord(x): f[0][0] for x, f in zip(letters, forms, strict=True)}

    def forget(self) -> None:
        """Know no piece. END, which has the end id, is number 0."""
        self.known: dict[bytes, int] = defaultdict(count(1).__next__, {END: 0})
        #: Ids of the pieces by their numbers, and where each one's start and how many they are.
        self.ids, self.first, self.size = np.array([self.end_id], self.kind), np.zeros(1, np.int64), np.ones(1, np.int64)

    def learn(self, pieces: list[bytes]) -> None:
        """Append the ids of pieces, which have the next numbers."""
        simple = [bool(self.forms) and PLAIN(p) is not None for p in pieces]
        texts = b" ".join([p for p, s in zip(pieces, simple, strict=True) if s]).decode().translate(self.forms).split(" ")
        tokenize = self.model.tokenize
        by_model = ([t.id for t in tokenize(text)] for text in texts)
        by_library = iter(self.whole([p for p, s in zip(pieces, simple, strict=True) if not s]))
        each = [next(by_model) if s else next(by_library) for s in simple]
        size = np.array(list(map(len, each)), np.int64)
        self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(each), self.kind, int(size.sum())))
        self.size = np.append(self.size, size)

    def whole(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of any kind, through all steps of the library."""
        joint = [] if self.mark_id is None else [p for p in pieces if b"\x01" not in p]
        out = {p: self.tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in set(pieces).difference(joint)}
        for lo in range(0, len(joint), 250):
            part = joint[lo : lo + 250]
            ids, start = self.tokenizer.encode_batch_fast([(b" \x01 ".join(part) + b" \x01").decode()], add_special_tokens=False)[0].ids, 0
            for piece, end in zip(part, np.flatnonzero(np.array(ids) == self.mark_id).tolist(), strict=True):
                out[piece], start = ids[start:end], end + 1
        return [out[p] for p in pieces]

    def pieces(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[list[bytes]]:
        """The pieces of each text, then END. Texts with combining marks or what may be an added token are left as they are."""
        low, bounds = parted(raw, offsets)
        data, plain = low.tobytes(), raw.tobytes()
        marks = np.flatnonzero((raw == 0xCC) | (raw == 0xCD))
        for added in {b"<|", *self.added}:
            at = plain.find(added)
            while at >= 0:
                marks = np.append(marks, at)
                at = plain.find(added, at + 1)
        as_is = set((np.searchsorted(offsets, marks, side="right") - 1).tolist())
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            out = plain[offsets[i] : offsets[i + 1]].split() if i in as_is else data[a:b].split()
            out.append(END)
            yield out

    def ended(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in kind, offsets) of the texts of a byte buffer, each with the end id after its own."""
        if not self.cached:
            each = [[*self.tokenizer.encode(raw[a:b].tobytes().decode(), add_special_tokens=False).ids, self.end_id] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            bounds = np.cumsum([0, *map(len, each)])
            return np.fromiter(chain.from_iterable(each), self.kind, int(bounds[-1])), bounds
        if len(self.known) > self.limit:
            self.forget()
        # a piece that is not known gets the next number by being looked up; a text's pieces are looked up as soon as it is cut
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(self.pieces(raw, offsets))), np.int32)
        if len(self.known) > len(self.size):
            self.learn(list(islice(reversed(self.known), len(self.known) - len(self.size)))[::-1])
        size = self.size[numbers]
        bounds = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.first[numbers] - bounds[:-1], size)
        at += np.arange(len(at))
        return self.ids[at], np.concatenate([[0], bounds[1:][numbers == 0]])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text of a byte buffer, little-endian in kind, without the end."""
        ids, bounds = self.ended(raw, offsets)
        return [ids[a : b - 1].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def worker_encoder(tokenizer_json: str, cached: bool, end_id: int, limit: int) -> WordEncoder:
    """One encoder for a Python worker, kept between its tasks."""
    kept = worker_state()
    key = hash((tokenizer_json, end_id, limit))
    if kept.get("encoder", (None, None))[0] != key:
        kept.clear()
        kept["encoder"] = (key, WordEncoder(tokenizer_json, cached, end_id, limit))
    return kept["encoder"][1]


def separable(tokenizer_json: str) -> bool:
    """Whether white space only ends pieces: it is dropped, no piece holds any, and no added token is white space or strips it."""
    import json

    spec = json.loads(tokenizer_json)
    norm = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = norm["normalizers"] if norm["type"] == "Sequence" else [norm]
    pre = spec["pre_tokenizer"] or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    # fixed value: a pattern whose matches hold no white space, used to keep only its matches
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    rest = [p for p in pre.get("pretokenizers", [])[1:]]
    byte = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in rest)
    tokens = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in spec["added_tokens"])
    return bool(plain and drops and byte and tokens and not spec["post_processor"] and not spec["truncation"] and not spec["padding"])


def write_tokens(documents: DataFrame, path: str, tokenizer_json: str, end_id: int, parts: int | None = None, by_id: bool = True, cache_words: int = CACHE_WORDS) -> str:
    """Encode doc_id and text of all documents into Simple-8b files below path, in ascending doc_id order or, without by_id, in the order they come in.

    Each document gets end_id after its own ids. Null texts are empty, null ids come
    first, equal ids follow in order of their texts' hashes; repeated rows are all
    written. Part numbers follow the order of the documents. By id, the text is shuffled
    once, by ranges of (doc_id, hash), so a repeated id may spread over parts; else a
    part is one that Spark reads, and nothing is shuffled. Columns other than doc_id and
    text are not read, so their names matter nothing. An empty table gives no blocks.
    """
    spark = documents.sparkSession
    shared, cached = spark.sparkContext.broadcast(tokenizer_json), separable(tokenizer_json)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if parts is None and by_id:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def encode(batches):
        encoder, part, before = worker_encoder(shared.value, cached, end_id, cache_words), TaskContext.get().partitionId(), 0
        for batch in split_batches(batches, 1, BLOCK_BYTES):
            ids, bounds = encoder.ended(*utf8(batch.column(1)))
            body = block(batch.column(0), ids, bounds)
            n = int(bounds[-1])
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()), "n_docs": pa.array([batch.num_rows], pa.int64()), "n_ids": pa.array([n], pa.int64()), "body": pa.array([body], pa.binary())})
            before += n

    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order) if by_id else rows
    blocks = dealt.mapInArrow(encode, "part int, before long, n_docs long, n_ids long, body binary")
    with settings(spark, WRITING | {BATCH_ROWS: "256"}):
        blocks.write.parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if wanted, ids of the files below path.

    A block knows the ids of its part before it, and a part's first start is the sum of
    the parts before it. One row for each part (32 MB of text) is all that the driver
    sees and broadcasts: 12 bytes each, so 100 TB make 40 MB.
    """
    blocks = spark.read.parquet(path)
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    first, at = [], 0
    for part in sorted(totals):
        first.append((part, at))
        at += totals[part]
    base = spark.createDataFrame(first, "part int, first long")
    placed = blocks.join(F.broadcast(base), "part").select("body", (F.col("first") + F.col("before")).alias("start"))

    def decode(batches):
        for batch in batches:
            for body, start in zip(batch.column(0), batch.column(1).to_numpy(), strict=True):
                doc_ids, null, ids, offsets = parse(body.as_py())
                ids = ids.astype("<u4") if not len(ids) or int(ids.max()) < 1 << 32 else ids
                out = [pa.array(doc_ids, mask=null), pa.array(offsets[:-1] + start), pa.array(np.diff(offsets)), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def tokenize(documents: DataFrame, tokenizer_path: str, end_id: int = 1, by_id: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Write documents' ids to the shared folder, in order of their ids or as they come, and read them back: doc_id, start, n_tokens, ids_crc32. An empty table gives an empty result."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    spark = documents.sparkSession
    # few rows of a block of ids each fill a worker, so what is read is written once more; it is 32 bytes a document
    return stored(read_tokens(spark, write_tokens(documents, scratch(spark, "tokens"), spec, end_id, by_id=by_id, cache_words=cache_words), with_ids=False), "ids", batch_rows=16)
