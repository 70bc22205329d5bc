"""Traversals on random graphs and on one with hubs."""

import random

from pyspark.sql import functions as F

from hilandera.operators import graph
from hilandera.operators.tokens import Assets


def random_graph(spark, seed=3, nodes=60, links=150):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(nodes)}", f"n{min(rng.randrange(nodes), rng.randrange(nodes))}") for _ in range(links)}
    return pairs, spark.createDataFrame(sorted(pairs), "src string, dst string")


def hops_from(start, pairs, depth):
    """target -> fewest hops, by breadth-first search."""
    found, front = {start: 0}, {start}
    for h in range(1, depth + 1):
        front = {d for s, d in pairs if s in front} - set(found)
        found |= dict.fromkeys(front, h)
    return {t: h for t, h in found.items() if h}


def table(df):
    return sorted(tuple(r) for r in df.select("seed", "target", "h").collect())


def test_walks_pruned_and_extended(spark):
    pairs, edges = random_graph(spark)
    some, more, targets = ["n1", "n5"], ["n1", "n5", "n7", "n40"], ["n0", "n2", "n9", "n41", "away"]
    starts = lambda words: spark.createDataFrame([(w,) for w in words], "seed string")
    want = lambda words, depth: sorted((w, t, h) for w in words for t, h in hops_from(w, pairs, depth).items())
    assert table(graph.reach(starts(more), edges, 3)) == want(more, 3)
    few = graph.reach(starts(more), edges, 3, spark.createDataFrame([(t,) for t in targets], "word string"))
    assert table(few) == [x for x in want(more, 3) if x[1] in targets]
    assets = Assets(edges=edges.select("src", F.lit("n").alias("pos"), F.lit("hypernyms").alias("rel"), F.lit(0).alias("ord"), "dst"))
    paths, hops = graph.labelled(spark.createDataFrame([(1, "n1"), (2, "n5")], "ord int, word string"), assets, 2)
    assert table(hops.table) == want(some, 2) and {r.rel for r in paths.collect()} == {"hyp↑"}
    assert table(hops.extended(starts(more), 4).table) == want(more, 4)
    assert table(hops.extended(starts([]), 2).table) == want(some, 2)
    assert table(graph.nowhere(assets).extended(starts(more), 2).table) == want(more, 2)


def test_hubs_outside_the_corpus_are_pruned(spark):
    # 30 words lead to a hub with 500 followers outside the corpus; one of them leads back to a word
    links = [(f"w{i}", "hub") for i in range(30)] + [("hub", f"x{j}") for j in range(500)] + [("x7", "w0")]
    edges = spark.createDataFrame(links, "src string, dst string")
    words = spark.createDataFrame([(f"w{i}",) for i in range(30)], "word string")
    starts = words.select(F.col("word").alias("seed"))
    every = graph.reach(starts, edges, 3)
    assert every.count() == 30 * 501 + 29
    steps = graph.toward(edges.select(F.col("src").alias("at"), "dst"), words, 2)
    assert sorted((r.at, r.dst, r.need) for r in steps.filter("at not like 'w%'").collect()) == [("hub", "x7", 1), ("x7", "w0", 0)]
    assert table(graph.reach(starts, edges, 3, words)) == sorted((f"w{i}", "w0", 3) for i in range(1, 30))


def activated(documents, pairs, depth, decay):
    """(doc, lemma) -> energy, from breadth-first searches inside nothing but the definition."""
    return {(d, t): 1 + sum(decay ** hops_from(s, pairs, depth)[t] for s in words if t in hops_from(s, pairs, depth)) for d, words in documents.items() for t in words}


def test_activation_equals_its_definition_at_each_depth(spark):
    pairs, edges = random_graph(spark, 5)
    rng = random.Random(1)
    documents = {d: sorted({f"n{rng.randrange(60)}" for _ in range(25)} | {"n0", "alone"}) for d in range(6)}
    freqs = spark.createDataFrame([(d, w, 1) for d, words in documents.items() for w in words], "doc_id long, lemma string, freq long")
    assets = Assets(edges=edges.select("src", F.lit("n").alias("pos"), F.lit("hypernyms").alias("rel"), F.lit(0).alias("ord"), "dst"))
    for depth in (1, 2, 3):
        got = {(r.doc_id, r.lemma): r.rel for r in graph.spread_activation(freqs, assets, depth, 0.3).collect()}
        want = activated(documents, pairs, depth, 0.3)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_path_is_asked_for_by_its_rarer_end(spark):
    # a hub that 1000 documents have, with 50 followers of one document each: 50 codes a direction, not 50 a document
    words = spark.createDataFrame([("hub", 1000, 0)] + [(f"w{i}", 1, i + 1) for i in range(50)], "lemma string, df long, id long")
    paths = spark.createDataFrame([x for i in range(50) for x in (("hub", f"w{i}", 1), (f"w{i}", "hub", 1))], "seed string, target string, h int")
    asked = {r.lemma: sorted(r.codes) for r in graph.asked_by_rarer(paths, words, 2).collect()}
    assert asked == {f"w{i}": [1, 3] for i in range(50)}
