import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from hilandera.llm import bpe, token_files
from hilandera.llm.word_cache import WordCache

from .conftest import ROWS, by_id

BITS = list("ab AB.,'\"\n\t\r  é́ñÑςΣİ٣1\x1c\x85\xa0 　​﻿中😀ÉÅKẞßªº×÷ÿŸ") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", "  ", "\n\n", "<|startoftext|>", "Straße.", "über,", "Ñandú!?"]


def random_texts(n):
    random.seed(3)
    return ["".join(random.choices(BITS, k=random.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(token_files.default_tokenizer())


def test_words_encode_as_the_library(byte_level, word_level):
    by_byte, by_word = bpe.WordTable(bpe.default_tokenizer(), {}), token_files.WordIds(token_files.default_tokenizer(), limit=50)
    for t in random_texts(8000):
        assert np.frombuffer(by_byte.encode(t), "<u4").tolist() == byte_level.encode(t, add_special_tokens=False).ids, t
        assert np.frombuffer(by_word.encode(t.encode()), "<u4").tolist() == word_level.encode(t, add_special_tokens=False).ids, t


def test_pieces_decode_as_the_library(byte_level):
    piece = bpe.pieces(bpe.default_tokenizer())
    random.seed(4)
    for _ in range(2000):
        ids = [random.randrange(len(piece)) for _ in range(5)]
        assert b"".join(piece[i] for i in ids).decode("utf-8", "replace") == byte_level.decode(ids, skip_special_tokens=False)


def test_cache_forgets_but_keeps_the_known():
    class Length(WordCache):
        def ids(self, word):
            return str(len(word)).encode()

    c = Length(bpe.default_tokenizer(), {"known": b"k"}, limit=10)
    assert [c["x" * i] for i in range(1, 60)] == [str(i).encode() for i in range(1, 60)]
    assert c["known"] == b"k" and len(c) <= 11 and len(c.old) <= 11


def expected(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_digest(spark, odd, none, byte_level):
    found = by_id(bpe.digest(odd))
    for key, text, _ in ROWS:
        assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(text, byte_level) for r in found[key])
    encoded = bpe.encode_documents(odd)
    assert encoded.columns == [*odd.columns, "ids_"]
    assert bpe.decode_documents(encoded, "ids_").columns == [*odd.columns, "ids_", "decoded_"]
    assert bpe.digest(none).count() == 0
    rows = list(enumerate(random_texts(200)))
    found = by_id(bpe.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all((*found[i][0][1:],) == expected(t, byte_level) for i, t in rows)


def test_each_distinct_word_is_encoded_once(byte_level):
    class Counted(bpe.WordTable):
        asked: list = []

        def ids(self, word):
            self.asked.append(word)
            return super().ids(word)

    table = Counted(bpe.default_tokenizer())
    questions = [[" the", " fox", "!"], [" the", " fox", " sat"], [" sat", " the"]]
    found = [np.split(bpe._numbers(ids), np.cumsum(bpe._numbers(sizes))[:-1]) for sizes, ids in bpe.answers(questions, table)]
    assert [[x.tolist() for x in f] for f in found] == [[byte_level.encode(w, add_special_tokens=False).ids for w in q] for q in questions]
    assert sorted(table.asked) == sorted({w for q in questions for w in q})


def test_squeezed_numbers():
    rng = np.random.default_rng(0)
    for top in (1, 200, 256, 70_000, 2**32 - 1):
        x = rng.integers(0, top, 1000)
        assert (bpe._numbers(bpe._squeezed(x)) == x).all()
    x = np.r_[rng.integers(0, 300, 500), rng.integers(0, 1 << 25, 500), 223, 224, 223 + (31 << 16), 224 + (31 << 16), 224 + (32 << 16)]
    assert (bpe._ranks(bpe._squeezed_ranks(x)) == x).all() and not len(bpe._ranks(bpe._squeezed_ranks(x[:0])))


def test_bpe_over_many_chunks_and_buckets(spark, odd, byte_level, monkeypatch):
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 4096)
    rows = list(enumerate(random_texts(300) + [None, "", "word and other " * 3000]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = by_id(bpe.digest(docs))
    assert len(found) == len(rows) and all((*found[i][0][1:],) == expected(t, byte_level) for i, t in rows)
    assert bpe.round_trip(odd, keep=["source", "doc_id"]).columns == ["source", "doc_id", "ids_", "decoded_"]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == (1003 * bits + 7) // 8 and (token_files.unpack(data, bits, 1003) == ids).all()


def test_random_access(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "BLOCK", 16)
    rng, sink = np.random.default_rng(0), io.BytesIO()
    w, docs = token_files.Writer(sink, 13), [rng.integers(0, 8000, rng.integers(0, 70)).astype("<u4") for _ in range(50)]
    for k, ids in enumerate(docs):
        w.add(k if k != 3 else None, ids)
    w.close()
    r = token_files.Reader(pa.BufferReader(sink.getvalue()))
    every = np.concatenate(docs)
    assert all((r.ids(a, b) == every[a:b]).all() for a, b in ((0, 0), (0, len(every)), (5, 6), (15, 33), (40, 41)))
    got = list(r.documents(most=40))
    assert [k for k, _, _ in got] == [None if k == 3 else k for k in range(50)]
    assert all((ids == d).all() for (_, _, ids), d in zip(got, docs, strict=True))


def test_token_files(spark, odd, none, word_level, tmp_path, monkeypatch):
    rows = sorted((k, t or "") for k, t, _ in ROWS)
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    found = sorted(token_files.digest(odd).collect(), key=lambda r: r.start)
    start = 0
    for (key, text), r in zip(rows, found, strict=True):
        ids = [*word_level.encode(text, add_special_tokens=False).ids, 1]
        assert tuple(r) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.digest(none).count() == 0
    index = token_files.write_token_files(odd, f"file://{tmp_path}/t")
    assert index.count() > 1 and token_files.read_token_files(spark, f"file://{tmp_path}/t").count() == len(ROWS)
