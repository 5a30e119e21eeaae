import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from cairn.llm import bpe, queries, token_counts, token_files

BYTES = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
PIECES = P.path("piece_bpe_32k.model")


def odd_texts(n=1500):
    r = random.Random(3)
    alphabet = " \n\tabceé'$1日\xa0\x1c▁sSTΣσİ́ﬁ̈IK<|>"
    fixed = ["", " ", "a  b\n\n c", "x▁ y", "it's 's ' s'll\t\t12\x1c3", "aaaa" * 50, "z" * 5000, " " * 300 + "\n" + " " * 17 + "k", "<|endoftext|>x", "<|ENDOFTEXT|>", "ΑΣ ΑΣΑ", "T̈ẗ"]
    return fixed + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 50))) for _ in range(n)]


def test_bpe_equals_library_and_decodes():
    mine = bpe.tokenizer(BYTES, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    for t in odd_texts():
        ids = mine.encode(t)
        assert library.encode_ordinary(t) == ids.tolist(), t
        assert mine.decode(ids) == t.encode()


def test_bpe_long_pretoken():
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(20_000))
    mine = bpe.tokenizer(BYTES, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    assert library.encode_ordinary(text) == mine.encode(text).tolist()


def test_bpe_rank_that_falls_after_a_merge():
    # "ab" (5) makes the pair "ab"+"c" of lower rank 3, which goes before the second "ab"
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 5}
    assert bpe.merge_piece(b"abcab", ranks) == [3, 5]


def test_bpe_time_is_near_linear():
    """Ranks that fall after each merge don't make the queue copy what is left of a bucket."""
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 5}

    def seconds(n):
        start = time.process_time()
        assert bpe.merge_piece(b"abc" * n, ranks) == [3] * n
        return time.process_time() - start

    seconds(1000)
    assert seconds(80_000) < 12 * max(seconds(20_000), 0.01)


def test_bpe_frame(awkward, empty):
    mine = bpe.tokenizer(BYTES, P.PATTERN)
    rows = bpe.round_trip(awkward, BYTES, P.PATTERN).collect()
    texts = sorted((r.text or "") for r in awkward.collect())
    assert sorted(bytes(r.decoded).decode() for r in rows) == texts
    assert all(mine.decode(np.array(r.ids, np.uint32)) == bytes(r.decoded) for r in rows)
    again = bpe.decode(bpe.encode(awkward, BYTES, P.PATTERN), BYTES, P.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in again) == texts
    assert bpe.digest(bpe.round_trip(empty, BYTES, P.PATTERN)).count() == 0


def test_counts_equal_library(awkward, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    mine = token_counts.pieces(PIECES)
    for t in odd_texts():
        assert len(library.encode(t)) == mine.count(t), t
    rows = token_counts.count_tokens(awkward, PIECES).collect()
    want = sorted((len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in awkward.collect())
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_pieces_cut_or_not():
    mine = token_counts.pieces(PIECES)
    assert mine.cuts
    whole = token_counts.SPACE + "a b\nc  d".replace(" ", token_counts.SPACE)
    assert mine.merge(whole) == mine.count("a b\nc  d")


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 20])
def test_packing(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 70_001)
    raw = token_files.pack(ids, bits)
    assert (token_files.unpack(raw, bits, 0, len(ids)) == ids).all()
    assert (token_files.unpack(raw, bits, 65_530, 20) == ids[65_530:65_550]).all()
    assert len(raw) <= len(ids) * bits / 8 + 16


def test_words_equal_library():
    library = Tokenizer.from_file(WORDS)
    mine = token_files.word_tokenizer(WORDS)
    texts = odd_texts() + ["Word, word. été! naïve's", "straße. ñandú, ÿ ÿ."]
    for t, ids in zip(texts, mine.encode(texts), strict=True):
        assert library.encode(t, add_special_tokens=False).ids == ids.tolist(), t


def test_words_in_many_batches():
    library = Tokenizer.from_file(WORDS)
    mine = token_files.word_tokenizer(WORDS)
    r = random.Random(11)
    texts = [" ".join("".join(r.choice("aeÉßtØ.,!<|%1") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 60))) for _ in range(400)]
    parts = [ids for some in token_files.some_texts(pa.array([*texts, None]), 900) for ids in mine.encode(some.to_pylist())]
    assert [p.tolist() for p in parts] == [e.ids for e in library.encode_batch([*texts, ""], add_special_tokens=False)]


def test_range_of_files(spark, awkward, work, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 300)
    token_files.write(awkward, work.path("ids"), WORDS)
    rows = token_files.read(spark, work.path("ids")).collect()
    stream = [i for r in sorted(rows, key=lambda r: r.start) for i in r.ids]
    for start, count in ((0, 5), (290, 700), (len(stream) - 3, 50), (len(stream) + 5, 4)):
        got = token_files.read_range(spark, work.path("ids"), start, count).collect()
        assert [i for r in sorted(got) for i in r.ids] == stream[start : start + count]


def test_files(spark, awkward, empty, work, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    token_files.write(awkward, work.path("ids"), WORDS)
    library = Tokenizer.from_file(WORDS)
    source = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r in source:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_files.checksums(spark, work.path("ids")).collect()), key=lambda r: r[1])
    assert got == want
    whole = {(r.doc_id, r.start): r.ids for r in token_files.read(spark, work.path("ids")).collect()}
    assert sum(map(len, whole.values())) == start
    blocks = token_files.read_blocks(spark, work.path("ids")).collect()
    assert all(r.bits == 16 for r in blocks)
    token_files.write(empty, work.path("none"), WORDS)
    assert token_files.checksums(spark, work.path("none")).count() == 0


def test_queries(spark, data):
    made = queries.op1_byte_bpe(spark, data)
    assert made.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert made.count() == queries.documents(spark, data).count()
    assert queries.op10_token_counts(spark, data).filter("over_limit").count() >= 0
