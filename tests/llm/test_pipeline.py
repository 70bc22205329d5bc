"""The pipeline against plain Python over a small table."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from hilandera.llm import bpe, mixing, quality_rules

from .test_near_duplicates import brute_fingerprint, plain_components
from .test_quality_rules import brute

BAD_HEX = re.compile(r"[0-9a-f]{16,}")


def documents():
    random.seed(11)
    words = [f"w{i}q" for i in range(500)]
    rows = []
    for i in range(120):
        text = " ".join(random.choices(words, k=random.randint(30, 90)))
        if i % 10 == 0:
            text += " 0123456789abcdef01"
        rows.append((i, text, "en", f"s{i % 4}" if i % 7 else None, len(text)))
    rows += [(200 + k, rows[5][1], "en", "s1", rows[5][4]) for k in range(5)]
    rows += [(300, None, "en", "s1", None), (301, "", "en", "s1", 0), (302, "### %%% " * 60, "en", "s1", 480)]
    return rows


def test_stages(spark, tmp_path):
    path = f"file://{tmp_path}/sf"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents(), schema).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        steps.append(docs.collect())
        assert docs.columns == columns or stage is corpus_pipeline.encode
    kept, single, clean, mixed, encoded = steps

    def good(text):
        n, chars, symbols, dup, repeated = brute(text)
        lines = sum(bool(x.split()) for x in (text or "").split("\n"))
        return n >= 50 and 2 * repeated <= n and 10 * symbols <= n and chars <= 30 * n and 100 * dup <= 90 * lines

    want = {r[0]: r[1] for r in documents() if good(r[1])}
    assert {r.doc_id: r.text for r in kept} == want and quality_rules.CURRENT == 2
    ids = np.array(sorted(want))
    fps = np.array([brute_fingerprint(want[i]) for i in ids.tolist()], np.uint64)
    label = plain_components(len(ids), np.bitwise_count(fps[:, None] ^ fps) <= 2)
    firsts = ids[label == np.arange(len(ids))].tolist()
    assert sorted(r.doc_id for r in single) == firsts and not {200, 201, 204} & set(firsts)
    redacted = {i: BAD_HEX.sub("[SECRET]", want[i]) for i in firsts}
    assert {r.doc_id: r.text for r in clean} == redacted and all(r.n_chars == len(r.text) for r in clean)
    assert any("[SECRET]" in t for t in redacted.values())
    copies = {r.doc_id: r.copies for r in mixing.digest(spark.createDataFrame(clean, schema)).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: n for i, n in copies.items() if n})
    assert all(r.text == redacted[r.doc_id] for r in mixed)
    library = Tokenizer.from_file(bpe.default_tokenizer())
    assert Counter(r.doc_id for r in encoded) == Counter(r.doc_id for r in mixed)
    for r in encoded:
        data = np.array(library.encode(redacted[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        assert (bytes(r.ids), r.n_tokens, r.ids_sha256) == (data, len(data) // 4, hashlib.sha256(data).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(redacted[r.doc_id].encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, encoded))


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/sf"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
