"""Personal data: patterns find the protected entities, corpus statistics find the terms that give them away.

A term in a document of an entity discloses it by PMI(entity; term) / IC(entity), which is 1 if the
term never occurs without the entity and 0 if it says nothing of it. Probabilities are
shares of all documents. Terms over one threshold are generalised, over a higher one
removed.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split_batches, stored, utf8, word_hashes, words

#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE_AT, REMOVE_AT = 0.7, 0.9
KINDS = ("email", "ip", "card", "phone", "term")

# The base patterns. Where a plain form would be quadratic on long runs
# (e-mail names, digits before a dot), the scan starts at run starts only, which finds
# the same matches.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "\"'()[]{}<>.,;:!?"
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of e-mail addresses, IP addresses, card and phone numbers, by start and then kind."""
    out = []
    at = text.find("@")
    free = 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        # a failed match leaves its characters to the next one
        free = m.end() if m else max(free, at + 1)
        at = text.find("@", free)
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """The distinct entities of spans: hashes of a span's kind and its value (digits only for numbers, lower case for addresses)."""
    values = [(kind, ascii_lower(text[a:b]) if kind in ("email", "ip") else _NOT_DIGIT.sub("", text[a:b])) for kind, a, b in spans]
    return sorted({_hash(f"{kind}:{value}") for kind, value in values})


def all_terms(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a text: stripped of punctuation, lower-cased, three letters at least, outside all spans."""
    starts, ends, terms, at, reach = [], [], [], 0, 0
    for m in _WORD.finditer(text):
        word = m.group()
        s = m.start() + len(word) - len(word.lstrip(_EDGES))
        word = word.strip(_EDGES)
        e = s + len(word)
        if len(word) < 3:
            continue
        # spans come by start, so those that begin before a word end at `reach` at most
        while at < len(spans) and spans[at][1] < e:
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= s:
            starts.append(s)
            ends.append(e)
            terms.append(ascii_lower(word).encode("utf-8", "surrogatepass"))
    offsets = np.cumsum([0, *map(len, terms)])
    h = word_hashes(np.frombuffer(b"".join(terms), np.uint8), offsets[:-1], offsets[1:])
    return h.view(np.int64), np.array(starts, np.int32), np.array(ends, np.int32)


def scan(documents: DataFrame) -> DataFrame:
    """One row for each document: the base spans, and, if there are any, their entities and all words outside them."""
    span, word = "array<struct<kind:string,start:int,end:int>>", "array<struct<term:long,start:int,end:int>>"
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def look(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in split_batches(batches, 1):
            spans, named, held = [], [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text)
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
                named.append(entities(text, found))
                held.append(all_terms(text, found) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)))
            n = batch.num_rows
            if n == 0:
                continue
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["term", "start", "end"])
            terms = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(h[0]) for h in held)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(row, row + n), pa.int64()), pa.array(spans, kinds), pa.array(named, pa.list_(pa.int64())), terms], names=["doc_id", "row", "spans", "entities", "words"])
            row += n

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(look, f"doc_id long, row long, spans {span}, entities array<long>, words {word}")


def term_frequencies(documents: DataFrame) -> DataFrame:
    """(term_hash, df): the number of documents that hold each word, stripped and lower-cased as context terms are."""
    edge = np.zeros(256, bool)
    edge[list(_EDGES.encode())] = True
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32

    def count(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets):
                part, bounds = low[raw[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
                start, end, doc = words(part, bounds)
                # strip punctuation from both ends, a byte of every word at a time
                for _ in range(len(part)):
                    cut = (start < end) & edge[part[np.minimum(start, len(part) - 1)]]
                    if not cut.any():
                        break
                    start = start + cut
                for _ in range(len(part)):
                    cut = (start < end) & edge[part[end - 1]]
                    if not cut.any():
                        break
                    end = end - cut
                h = word_hashes(part, start, end)[end - start >= 3]
                doc = doc[end - start >= 3]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                term, df = np.unique(h[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df)], names=["term_hash", "df"])

    partial = documents.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "term_hash long, df long")
    return partial.groupBy("term_hash").agg(F.sum("df").alias("df"))


def disclosures(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(row, term, disclosure) of the terms that disclose an entity of their row to GENERALISE_AT, from scan()'s rows and all documents' words."""
    n = found.count()
    held = found.where("size(entities) > 0").select("row", F.explode("entities").alias("entity"))
    sizes = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") < n)
    terms = found.where("size(entities) > 0").select("row", F.explode(F.array_distinct(F.expr("transform(words, w -> w.term)"))).alias("term"))
    # a pair can reach GENERALISE_AT only if the term stands in no more documents than this, with a little for rounding
    bound = lambda size: F.pow(size, F.lit(GENERALISE_AT)) * F.lit(max(1.0, float(n)) ** (1 - GENERALISE_AT) * 1.000001)
    rare = term_frequencies(documents).withColumnRenamed("term_hash", "term").where(F.col("df") <= bound(F.lit(float(sizes.agg(F.max("n_entity")).first()[0] or 0))))
    pairs = terms.join(rare, "term").join(held.join(sizes, "entity"), "row").where(F.col("df") <= bound(F.col("n_entity").cast("double"))).select("row", "entity", "term", "df", "n_entity")
    pairs = stored(pairs, "pairs")
    both = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("df").alias("df"), F.first("n_entity").alias("n_entity"))
    pmi = F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_entity") * F.greatest("df", "n_both")))
    information = F.log2(F.lit(float(n)) / F.col("n_entity"))
    found_pairs = both.select("entity", "term", (pmi / information).alias("disclosure")).where(F.col("disclosure") >= GENERALISE_AT)
    return pairs.select("row", "entity", "term").join(found_pairs, ["entity", "term"]).groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))


def find(documents: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, action) of every document, by start and then kind.

    Base spans are masked; terms are generalised or removed, wherever they stand in a
    document of the entity that they disclose. Positions are code points,
    ends exclusive. A null text counts as empty and has no spans; a null doc_id stays
    null; repeated rows each get a row. Spans that start together come by kind, equal
    ones by their end; a term that discloses several entities has one span, with the
    stronger action. Columns other than doc_id and text are not read, so their names
    matter nothing. An empty table gives an empty result.
    """
    found = stored(scan(documents), "pii")
    held = found.where("size(entities) > 0").select("row", F.explode("words").alias("w")).select("row", "w.*")
    terms = (
        held.join(disclosures(found, documents), ["row", "term"])
        .groupBy("row").agg(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", F.when(F.col("disclosure") >= REMOVE_AT, "remove").otherwise("generalise").alias("action"))).alias("terms"))
    )
    base = F.expr("transform(spans, s -> struct(s.kind AS kind, s.start AS start, s.end AS end, 'mask' AS action))")
    order = "(x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start ELSE int(array_position(kinds, x.kind) - array_position(kinds, y.kind)) END"
    both = found.join(terms, "row", "left").select("doc_id", F.concat(base, F.coalesce("terms", F.array().cast("array<struct<kind:string,start:int,end:int,action:string>>"))).alias("spans"), F.array(*map(F.lit, KINDS)).alias("kinds"))
    return both.select("doc_id", F.expr(f"array_sort(spans, {order})").alias("spans"))


def sanitise(text: str | None, spans: list) -> str | None:
    """text with its spans masked, generalised to their kind of word, or removed; later spans yield where they overlap."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end, action in spans:
        if start < at:
            at = max(at, end)
            continue
        word = text[start:end]
        general = "<number>" if any(c.isdigit() for c in word) else "<name>" if word[:1].isupper() else "<word>"
        out += [text[at:start], f"<{kind}>" if action == "mask" else general if action == "generalise" else ""]
        at = end
    return "".join([*out, text[at:]])


def digest(spans: DataFrame) -> DataFrame:
    """The columns that the query returns, from find()'s rows."""
    say = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return spans.select("doc_id", *counts, F.sha2(F.expr(say.format("filter(spans, s -> s.kind <> 'term')")), 256).alias("base_sha256"), F.expr(say.format("spans")).alias("spans"))
