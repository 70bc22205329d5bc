"""Weaves: matrices of co-occurrence, activation and proximity between seeds and their expansions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions.lineage import cut
from hilandera.operators.graph import Hops, edges_of, in_corpus, labelled, nowhere, reach
from hilandera.operators.stats import cooccurrence
from hilandera.operators.tokens import Assets


def terms_of(seeds: DataFrame, expansions: DataFrame, freqs: DataFrame) -> DataFrame:
    """doc_id, seed, word, rel, dist, rank: each seed of the document, followed by its expansions by distance and word."""
    own = freqs.select("doc_id", F.col("lemma").alias("word")).join(seeds, "word").select("doc_id", F.col("word").alias("seed"), "word", F.lit("seed").alias("rel"), F.lit(0).alias("dist"))
    every = own.unionByName(expansions).join(seeds.select(F.col("word").alias("seed"), "ord"), "seed")
    order = Window.partitionBy("doc_id").orderBy("ord", "dist", F.collate("word", "es"), "word")
    return every.withColumn("rank", F.row_number().over(order).cast("bigint")).drop("ord")


def cells(content: DataFrame, terms: DataFrame, freqs: DataFrame, assets: Assets, depth: int = C.DEPTH, decay: float = C.DECAY, flow: str = C.FLOW, window: int = C.WINDOW, hops: Hops | None = None) -> DataFrame:
    """doc_id, a, b, cooc, activ, prox for every ordered pair of a document's terms (a few dozen).

    One walk of 2 * depth hops from the terms serves proximity and, where it follows all relations,
    activation; hops: what has been walked already.
    """
    words = terms.select("doc_id", "word").distinct()
    own = words.join(freqs.select("doc_id", F.col("lemma").alias("word"), "freq"), ["doc_id", "word"], "left")
    grid = own.select("doc_id", F.col("word").alias("a"), F.col("freq").alias("_fa")).join(own.select("doc_id", F.col("word").alias("b"), F.col("freq").alias("_fb")), "doc_id")
    together = cooccurrence(content, words.withColumnRenamed("word", "lemma"), window)
    grid = grid.join(together, ["doc_id", "a", "b"], "left").withColumn("cooc", F.coalesce("n", F.lit(0))).drop("n")
    if assets.edges is None:
        return grid.select("doc_id", "a", "b", "cooc", F.lit(0.0).alias("activ"), F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0).alias("prox"))
    starts = words.select(F.col("word").alias("seed"))
    walked = (hops or nowhere(assets)).extended(starts, 2 * depth).table
    led = walked.filter(F.col("h") <= depth) if flow == "bi" else reach(starts, edges_of(assets, flow), depth, words)
    for k, (a, b) in (("_x", "ab"), ("_y", "ba")):
        energy = F.pow(F.lit(decay), "h") * F.col(f"_f{a}")
        grid = grid.join(led.select(F.col("seed").alias(a), F.col("target").alias(b), "h"), ["a", "b"], "left").withColumn(k, F.coalesce(energy, F.lit(0.0))).drop("h")
    near = walked.select(F.col("seed").alias("a"), F.col("target").alias("b"), F.col("h").alias("d"))
    prox = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(1 / (1 + F.col("d")), F.lit(0.0)))
    return grid.join(near, ["a", "b"], "left").select("doc_id", "a", "b", "cooc", F.greatest("_x", "_y").alias("activ"), prox.alias("prox"))


def weave(content: DataFrame, seeds: DataFrame, freqs: DataFrame, assets: Assets, **params) -> tuple[DataFrame, DataFrame]:
    """(terms, cells) for the seeds (ord, word). The seeds' walk for the terms is extended for the cells."""
    paths, hops = labelled(seeds, assets, params.get("depth", C.DEPTH))
    terms = cut(terms_of(seeds, in_corpus(paths, freqs), freqs))
    return terms, cells(content, terms, freqs, assets, **params, hops=hops)


def cell_maxima(of: DataFrame) -> DataFrame:
    """doc_id, max_cooc, max_activ over different words; 1 in place of 0."""
    one = lambda c: F.coalesce(F.nullif(F.max(F.when(F.col("a") != F.col("b"), F.col(c))).cast("double"), F.lit(0.0)), F.lit(1.0)).alias(f"max_{c}")
    return of.groupBy("doc_id").agg(one("cooc"), one("activ"))


def union_terms(terms: DataFrame) -> DataFrame:
    """seed, word, rel, dist: the terms of all documents, each with its smallest distance; the document
    of the smallest id decides among equals."""
    best = terms.groupBy("seed", "word").agg(F.min(F.struct((F.col("rel") != "seed").alias("no_seed"), "dist", "doc_id", "rel")).alias("x"))
    return best.select("seed", "word", "x.rel", "x.dist")


def stack(of: DataFrame) -> DataFrame:
    """a, b, docs (with co-occurrence), and the sums of cooc, activ and prox over documents."""
    return of.groupBy("a", "b").agg(
        F.sum((F.col("cooc") > 0).cast("bigint")).alias("docs"), F.sum("cooc").alias("sum_cooc"), F.sum("activ").alias("sum_activ"), F.sum("prox").alias("sum_prox")
    )


def passages(words: DataFrame, a: str, b: str, window: int = C.WINDOW, most: int = 5, context: int = 8) -> DataFrame:
    """doc_id, rank, start, end, passage: the first passages in which a and b stand near each other.

    words: doc_id, i (place among all words from 0), surface, lemma, stop. Near: within 3 * window
    words; a passage reaches `context` words to either side. Scan order is by the first, then the
    second place; equal spans count once.
    """
    reach = 3 * window
    hits = words.filter((~F.col("stop")) & F.col("lemma").isin(a, b)).select("doc_id", "i", "lemma")
    n = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    # a hit meets those of its own bucket of `reach` places and of the two beside it
    bucket = F.floor(F.col("i") / reach).cast("bigint")
    left = hits.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    right = hits.select("doc_id", bucket.alias("bucket"), F.col("i").alias("j"), F.col("lemma").alias("lemma_j"))
    # the same lemma on both sides counts if a and b are one word
    fits = (F.col("lemma") != F.col("lemma_j")) if a != b else (F.col("i") != F.col("j"))
    pairs = left.join(right, ["doc_id", "bucket"]).filter(fits & F.abs(F.col("i") - F.col("j")).between(1, reach)).join(n, "doc_id")
    start = F.greatest(F.least("i", "j") - context, F.lit(0))
    end = F.least(F.greatest("i", "j") + context + 1, F.col("n"))
    spans = pairs.groupBy("doc_id", start.cast("bigint").alias("start"), end.cast("bigint").alias("end")).agg(F.min(F.struct("i", "j")).alias("at"))
    order = Window.partitionBy("doc_id").orderBy("at")
    first = spans.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= most).drop("at")
    # the few places of the few spans, then the words there
    places = first.withColumn("i", F.explode(F.sequence("start", F.col("end") - 1)))
    inside = words.select("doc_id", "i", "surface").join(places, ["doc_id", "i"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "surface"))), lambda x: x["surface"]), " ")
    return inside.groupBy("doc_id", "rank", "start", "end").agg(text.alias("passage"))
