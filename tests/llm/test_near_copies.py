import random

import numpy as np
import pytest

import corpus_pipeline
from hilandera.llm import near_copies

from .test_near_duplicates import plain_components


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("block", [1000, 2])
def test_the_stage_drops_near_copies_of_similarity_0_8(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK_SETS", block)
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = random.choices(words, k=random.randint(60, 200))
        rows.append(text)
        for changes in range(i % 6):
            copy = list(text)
            for _ in range(changes + 1):
                copy[random.randrange(len(copy))] = "other"
            rows.append(copy)
    texts = [" ".join(w) for w in rows] + [" ".join(rows[0]).upper(), None, "", "a b", "a b"]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(3)
    sets = [plain_shingles(t) for t in texts]
    near = np.array([[alike(a, b) for b in sets] for a in sets])
    label = plain_components(len(sets), near)
    firsts = np.flatnonzero(label == np.arange(len(sets))).tolist()
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x)) == [*firsts, None] and out.columns == docs.columns
    assert 80 < len(firsts) < len(sets) - 40


def test_near_sets_are_exact():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1000, 40)
    sets = [np.unique(np.r_[rng.choice(base, 38), rng.integers(0, 1000, k)]).astype(np.uint64) for k in rng.integers(0, 9, 80)] + [np.empty(0, np.uint64)] * 2
    found = {(int(a), int(b)) for i, j in near_copies.near_sets(sets) for a, b in zip(i, j, strict=True)}
    plain = [set(x.tolist()) for x in sets]
    assert found == {(i, j) for i, a in enumerate(plain) for j, b in enumerate(plain) if alike(a, b)}
    for cut in (1, 30, 79):
        found = {(int(a), int(b)) for i, j in near_copies.near_sets(sets[:cut], sets[cut:]) for a, b in zip(i, j, strict=True)}
        assert found == {(i, j) for i, a in enumerate(plain[:cut]) for j, b in enumerate(plain) if j >= cut and alike(a, b)}


def test_the_stage_bears_odd_rows(spark, odd, none):
    kept = corpus_pipeline.near_duplicates(spark, odd, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8, 9] and kept.columns == odd.columns
    assert corpus_pipeline.near_duplicates(spark, none, "").count() == 0
