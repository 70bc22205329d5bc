import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from hilandera.llm import token_counts
from hilandera.llm.queries import QUERIES

from .conftest import by_id

SF = "/root/testdata/sf0.001"
BITS = ["the ", "lazy", " fox", "ñandú ", "日本語", "\n\n", "  ", "▁", "😀", "𝔸", "xyz", "0123", "<s>", "aaaa", ", and", "\t", "Straße", "é́", "\x00", " "]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_tokenizer())


def texts(n, length, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(rng.sample(BITS, rng.randint(1, 6)), k=rng.randint(1, length))) for _ in range(n)]


def by_splices(text, model, size, overlap):
    """The count by the same splices outside Spark, or None where two chunks share no token."""
    data = text.encode()
    parts = list(token_counts.chunks(data, size, overlap))
    rows = [token_counts.encoded({"uid": 0, "i": i, "first": i == 0, "last": stop == len(data), "base": base, "start": start, "stop": stop, "text": part.decode()}, model, overlap) for i, base, start, stop, part in parts]
    total, behind = 0, 0
    for a, b in zip(rows, rows[1:], strict=False):
        shared = [t for t in a["tail"] if t in b["head"]]
        if not shared:
            return None
        total += a["tail_at"] + a["tail"].index(shared[0]) + 1 - behind
        behind = b["head"].index(shared[0]) + 1
    return total + rows[-1]["n"] - behind if rows else 0


def test_splices_are_exact(model):
    aligned = 0
    for t in texts(3000, 60):
        for size, overlap in ((40, 12), (64, 31), (200, 50)):
            n = by_splices(t, model, size, overlap)
            assert n is None or n == len(model.encode(t)), (t, size, overlap)
            aligned += n is not None
    assert aligned > 6000


def test_a_chunks_own_first_space_is_no_place(model):
    # the second chunk begins within a run of blanks: with the space put in front, its blanks make a token of as many as the text has there
    text = "😀        😀  😀  😀              😀😀    😀😀😀😀😀😀  😀  😀  😀😀😀  😀          😀"
    assert by_splices(text, model, 40, 12) in (None, len(model.encode(text)))
    for n in range(1, 60):
        for at in range(0, 40, 3):
            t = "x" * at + " " * n + "end of the run " * 4
            assert by_splices(t, model, 40, 12) in (None, len(model.encode(t))), (t, n)


def test_every_pair_of_neighbours_encodes_to_itself(model):
    # what the proof in the module rests on, for tokens that no dummy space stands before
    for t in texts(300, 30, seed=2):
        tokens = [p.surface for p in model.encode("\n" + t, return_type="proto").pieces if p.surface][1:]
        for a, b in zip(tokens, tokens[1:], strict=False):
            assert [p.surface for p in model.encode("\n" + a + b, return_type="proto").pieces if p.surface][1:] == [a, b], (t, a, b)


def test_operator_on_odd_rows(spark, odd, none, model):
    docs = odd.withColumn("n_tokens", odd.text).withColumn("N_Bytes", odd.source)
    for size, overlap in ((token_counts.CHUNK, token_counts.OVERLAP), (64, 16)):
        out = token_counts.count_tokens(docs, chunk=size, overlap=overlap).collect()
        assert sorted((str(r.doc_id), r.n_tokens_) for r in out) == sorted((str(r.doc_id), len(model.encode(r.text or ""))) for r in docs.collect())
        assert all(r.n_bytes_ == len((r.text or "").encode()) for r in out)
    assert token_counts.count_tokens(none).count() == 0


def test_long_texts_in_many_chunks(spark, model):
    rows = [(k % 7 or None, t) for k, t in enumerate([*texts(40, 900, seed=3), "a" * 5000, "日本" * 3000, " " * 4000, "𝔸" * 2000, "word " * 2000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_counts.count_tokens(docs, chunk=256, overlap=32).select(F.md5("text").alias("m"), "n_tokens").collect()
    want = docs.select("text", F.md5("text").alias("m")).collect()
    assert sorted(map(tuple, got)) == sorted((r.m, len(model.encode(r.text))) for r in want)


def test_overlaps_widen(spark, model, monkeypatch):
    # a run of one letter has tokens of one length: chunks that begin at other places share none
    rounds, cut = [], token_counts._cut
    monkeypatch.setattr(token_counts, "_cut", lambda b, s, w: cut(b, s, w))
    stored = token_counts.stored
    monkeypatch.setattr(token_counts, "stored", lambda df, label: rounds.append(label) or stored(df, label))
    text = "q" * 3001
    (row,) = token_counts.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), chunk=65, overlap=9).collect()
    assert row.n_tokens == len(model.encode(text))
    assert len(rounds) >= 3


def test_query_equals_the_library(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = by_id(QUERIES["op12_token_counts"](spark, SF))
    assert sum(map(len, got.values())) == len(docs)
    for d in docs:
        n = len(model.encode(d.text or ""))
        assert tuple(got[d.doc_id][0])[1:] == (len((d.text or "").encode()), n, n > 4096)
