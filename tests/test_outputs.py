"""Custom segments, pairs of vectors and kept analyses against plain Python."""

import random
from dataclasses import fields

import numpy as np
from pyspark.sql import functions as F

from hilandera.operators import segments, vectors
from hilandera.plans import analysis


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_custom_segments_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET", 5)
    rng = random.Random(2)
    content = [(d, i, f"w{i % 11}") for d in range(3) for i in range(90)]
    bounds = [(d, s, f"L{s}", a, a + rng.choice([0, 1, 4, 23])) for d in range(3) for s, a in enumerate(sorted(rng.sample(range(88), 9)))]
    got = segments.custom_segments(spark.createDataFrame(content, "doc_id long, cpos long, lemma string"), spark.createDataFrame(bounds, "doc_id long, seg long, label string, start_token long, end_token long"))
    assert rows(got, "doc_id", "seg", "cpos", "lemma", "label") == sorted((d, s, i, w, name) for d, i, w in content for e, s, name, a, b in bounds if d == e and a <= i < b)


def test_bounds_in_blocks_of_parts(spark, monkeypatch):
    monkeypatch.setattr(segments, "PARTS", 4)
    sizes = {(d, p): (p * 7 + d) % 4 for d in range(2) for p in range(30) if p % 5}
    parts = spark.createDataFrame([(d, p, f"P{p}") for d, p in sizes], "doc_id long, part long, label string")
    content = spark.createDataFrame([(d, p, "w") for (d, p), n in sizes.items() for _ in range(n)], "doc_id long, part long, lemma string")
    got = rows(segments.bounds_of(parts, content), "doc_id", "seg", "start_token", "end_token")
    for d in range(2):
        at = 0
        for p in sorted(p for e, p in sizes if e == d):
            assert (d, p, at, at + sizes[d, p]) in got
            at += sizes[d, p]


def test_alike_pairs_are_met_once_and_pruned(spark):
    rng = np.random.default_rng(4)
    vecs = {f"v{i}": rng.normal(size=10) * rng.choice([0.01, 1, 5], size=10) for i in range(40)} | {"zero": np.zeros(10), "twin": np.ones(10), "twin2": np.ones(10) * 3}
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vecs.items()], "word string, vec array<double>")
    pairs = [(a, b) for a in vecs for b in [*vecs, "none"] if a != b]
    df = spark.createDataFrame(pairs * 3, "a string, b string")
    cosine = lambda x, y: float(x @ y / np.sqrt((x @ x) * (y @ y))) if (x @ x) * (y @ y) else 0.0
    got = {(r.a, r.b): r.sim for r in vectors.alike(df, table, 0.4).collect()}
    want = {(a, b): s for a, b in pairs if b in vecs and (s := cosine(vecs[a], vecs[b])) > 0.4}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got) and ("twin", "twin2") in got
    # the bound holds for every pair, and tells some of them from those that are alike
    forms = {r.word: r.form for r in table.select("word", vectors.profile(F.col("vec")).alias("form")).collect() if r.form}
    bounds = {(a, b): sum(x * y for x, y in zip(forms[a], forms[b], strict=True)) for a, b in pairs if a in forms and b in forms}
    assert all(bounds[p] >= cosine(vecs[p[0]], vecs[p[1]]) - 1e-9 for p in bounds) and any(x < 0.4 for x in bounds.values())


def test_kept_analyses(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["no sé la luz del mar", "el sol y el mar azul", "no sé la luz del mar", None, "casa"])], "doc_id long, text string")
    store = analysis.Stage1Store(spark, f"file://{tmp_path}/store")
    first, new = store.refresh(docs)
    assert new.count() == 4 and rows(first.totals, "doc_id", "words") == [(0, 6), (1, 6), (2, 6), (4, 1)]
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("sol nuevo y sol")).otherwise(F.col("text")))
    again, new = store.refresh(changed)
    assert new.count() == 1 and store.refresh(changed)[1].count() == 0
    whole = analysis.stage1(changed)
    for f in fields(analysis.Stage1):
        want = getattr(whole, f.name)
        assert sorted(map(str, getattr(again, f.name).select(want.columns).collect())) == sorted(map(str, want.collect())), f.name
    # results of a run that was not listed are not read
    (tmp_path / "store" / ("0" * 32)).mkdir()
    whole.totals.withColumn("doc_id", F.lit("x")).write.parquet(f"file://{tmp_path}/store/{'0' * 32}/totals")
    assert rows(store.refresh(changed)[0].totals, "doc_id") == [(0,), (1,), (2,), (4,)]


def brute_nearest(vecs, words, k, among=None):
    out = []
    for w in words:
        q = vecs[w]
        sims = []
        for o, v in vecs.items():
            if o != w and (among is None or o in among):
                n = np.linalg.norm(q) * np.linalg.norm(v)
                sims.append((-float(q @ v / n) if n else 0.0, o))
        out += [(w, o, round(-s, 9) + 0.0, i + 1) for i, (s, o) in enumerate(sorted(sims)[:k])]
    return sorted(out)


def test_nearest_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_ROWS", 30)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 4)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8)) * 5
    vecs = {i: centres[i % 12] + rng.normal(size=8) * 0.05 for i in range(600)} | {700 + i: vecs for i, vecs in enumerate([np.zeros(8)] * 3)} | {800 + i: centres[0] for i in range(25)}
    vecs = {w: np.asarray(v, float) for w, v in vecs.items()}
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vecs.items()], "word long, vec array<double>").repartition(3)
    words = [*range(0, 600, 60), 700, 803]
    asked = spark.createDataFrame([(w,) for w in [*words, 99999]], "word long")
    near = lambda df: sorted((r.word, r.other, round(r.sim, 9) + 0.0, r["rank"]) for r in df.collect())
    assert near(vectors.most_similar(asked, table, 10)) == brute_nearest(vecs, words, 10)
    some = {w for w in vecs if w % 3 == 0}
    few = spark.createDataFrame([(w,) for w in some], "word long")
    assert near(vectors.most_similar(asked, table, 4, few)) == brute_nearest(vecs, words, 4, some)
    # most blocks are skipped, with the queries in tables throughout
    of = vectors.in_blocks(table)
    first = vectors.nearest_blocks(table.filter(F.col("word").isin(words[:10])), of, 5)
    found = vectors._ranked(vectors._searched(first.select("word", "vec", F.explode("first").alias("block")), of, 5, 1), 5)
    visits = first.select(F.explode("first")).count() + vectors.other_blocks(first, found, 5).count()
    assert visits < 0.5 * 10 * (of.size > 0).sum()


def test_nearest_of_nothing(spark):
    zeros = spark.createDataFrame([(w, [0.0, 0.0]) for w in "abc"], "word string, vec array<double>")
    assert rows(vectors.most_similar(zeros.select("word"), zeros, 1), "word", "other", "sim", "rank") == [("a", "b", 0.0, 1), ("b", "a", 0.0, 1), ("c", "a", 0.0, 1)]
    assert vectors.most_similar(zeros.select("word"), zeros.limit(0), 3).count() == 0
