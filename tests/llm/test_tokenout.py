import zlib

import numpy as np
import pytest

from amalgam.llm import queries, tokenout

from .helpers import awkward, frame


@pytest.fixture(scope="module")
def spec():
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        return f.read()


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for t in range(200):
        n = int(rng.integers(0, 400))
        ids = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> rng.choice([0, 3, 4, 5, 34, 44, 48, 60, 63], n).astype(np.uint64)
        if t % 3 == 0:
            ids[:] = t % 2
        if n > 4:
            ids[:4] = [2**64 - 1, 2**60, 2**60 - 1, 2**59]
        offsets = np.sort(np.concatenate([[0, n], rng.integers(0, n + 1, 4)]))
        words, at, escapes = tokenout.pack(ids, offsets)
        assert (tokenout.unpack(words, at, offsets, escapes) == ids).all()


def test_packing_is_tight():
    ids = np.full(6000, 900, np.uint64)
    assert len(tokenout.pack(ids, np.array([0, 6000]))[0]) == 1000


def test_block_holds_null_ids():
    import pyarrow as pa

    body = tokenout.block(pa.array([5, None, 7], pa.int64()), np.array([1, 2, 3], np.uint32), np.array([0, 1, 1, 3]))
    ids, null, values, offsets = tokenout.parse(body)
    assert null.tolist() == [False, True, False] and values.tolist() == [1, 2, 3] and offsets.tolist() == [0, 1, 1, 3] and ids[0] == 5
    with pytest.raises(ValueError, match="not a Simple-8b"):
        tokenout.parse(b"x" * 60)


ODD = ["don't x's é's a1b2 ÷. ×, ß!! A÷. É É, ﬁ İI. ΑΣ x.,y 'S 'll<|endoftext|>b <|EndOfText|> '", "a\x01b \x01", "\x1cfoo\x85bar\xa0baz", "日本語 １２３ ①", "", " \n"]


def test_encoder_equals_the_library(spec):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    texts = ODD + [t or "" for _, t in awkward()]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    assert tokenout.separable(spec)
    for cached in (True, False):
        encoder = tokenout.WordEncoder(spec, cached)
        got = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        for g, t in zip(got, texts, strict=True):
            assert np.frombuffer(g, encoder.kind).tolist() == library.encode(t, add_special_tokens=False).ids


class Counting:
    """A tokenizer that keeps the words that it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, []

    def encode(self, text, **named):
        self.words += text.split()
        return self.tokenizer.encode(text, **named)

    def encode_batch_fast(self, texts, **named):
        self.words += " ".join(texts).split()
        return self.tokenizer.encode_batch_fast(texts, **named)


def test_words_of_letters_do_not_go_through_all_steps_of_the_library(spec):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    encoder = tokenout.WordEncoder(spec, True)
    counting = encoder.tokenizer = Counting(encoder.tokenizer)
    letters = "".join(map(chr, [*range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    rng = np.random.default_rng(1)
    text = " ".join(["".join(rng.choice(list(letters), int(rng.integers(1, 12)))) for _ in range(3000)] + list(letters) + ["x" * 5000, "Upper", "12", "ªb", "日x"])
    raw = np.frombuffer(text.encode(), np.uint8)
    got = encoder.encode(raw, np.array([0, len(raw)]))
    assert np.frombuffer(got[0], encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    assert set(counting.words) <= {"\x01", "12", "ªb", "日x"}


def test_pieces_that_were_forgotten_are_learned_again(spec):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    encoder = tokenout.WordEncoder(spec, True, end_id=1, limit=3)
    for text in ["one two three four", "two 2 one", "", "four, five", "one two"]:
        ids, bounds = encoder.ended(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1] and bounds.tolist() == [0, len(ids)]


def test_words_take_as_many_ids_as_fit():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << 62, 5000, dtype=np.uint64) >> rng.choice([0, 20, 46, 48, 56, 61], 5000).astype(np.uint64)
    ids[1000:2000] = 0
    offsets = np.array([0, 0, 1, 700, 1500, 1503, 5000, 5000])
    want, at = [], 0
    for end in offsets[1:].tolist():
        while at < end:
            fits = (s for s in range(1, 16) if all(int(x) >> tokenout.BITS[s] == 0 for x in ids[at : min(end, at + tokenout.COUNTS[s])]))
            want.append(next(fits, 0))
            at = min(end, at + tokenout.COUNTS[want[-1]])
    assert (tokenout.pack(ids, offsets)[0] >> np.uint64(60)).tolist() == want


def test_other_tokenizers_are_not_cut():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert not tokenout.separable(f.read())


def test_query_against_the_library(spark, spec, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    rows = [r for r in awkward() if r[0] is not None] + [(50 + i, t) for i, t in enumerate(ODD)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r)[:4] for r in queries.op5_tokens(spark, str(tmp_path)).collect())
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_files_hold_the_ids(spark, spec, tmp_path):
    path = tokenout.write_tokens(frame(spark, awkward()), str(tmp_path / "t"), spec, 1, parts=3)
    got = tokenout.read_tokens(spark, path).orderBy("start").collect()
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    assert all(r.start + r.n_tokens == s.start for r, s in zip(got, got[1:], strict=False)) and got[1].ids[-1] == 1
    assert tokenout.read_tokens(spark, tokenout.write_tokens(frame(spark, []), str(tmp_path / "e"), spec, 1)).count() == 0
