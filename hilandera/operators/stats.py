"""Counts over content sequences (doc_id, cpos, lemma): frequencies, n-grams, co-occurrence, selections."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions.text import integer_key
from hilandera.operators.tokens import BLOCK, in_order


def ranked(counts: DataFrame, item: str = "lemma", n: str = "freq") -> DataFrame:
    """counts (doc_id, item, n, first) with rank from 1: by count, then integer-like items by number, then first occurrence."""
    key = integer_key(item)
    order = Window.partitionBy("doc_id").orderBy(F.desc(n), key.isNull(), key, "first")
    return counts.withColumn("rank", F.row_number().over(order).cast("bigint"))


def frequencies(content: DataFrame) -> DataFrame:
    """doc_id, lemma, freq, rel_freq, rank."""
    # positions order as the numbers of content words do, and need no numbering
    place = "pos" if "pos" in content.columns else "cpos"
    counts = content.groupBy("doc_id", "lemma").agg(F.count(F.lit(1)).alias("freq"), F.min(place).alias("first"))
    share = F.col("freq") / F.sum("freq").over(Window.partitionBy("doc_id"))
    return ranked(counts).withColumn("rel_freq", share).drop("first")


def top(freqs: DataFrame, n: int = C.TOP_N) -> DataFrame:
    return freqs.filter(F.col("rank") <= n)


def maxima(freqs: DataFrame, relevance: DataFrame) -> DataFrame:
    """doc_id, max_freq, max_rel: what views divide by; a relevance of 0 counts as 1."""
    both = freqs.select("doc_id", "lemma", "freq").join(relevance.select("doc_id", "lemma", "rel"), ["doc_id", "lemma"], "left")
    return both.groupBy("doc_id").agg(F.max("freq").alias("max_freq"), F.coalesce(F.nullif(F.max("rel"), F.lit(0.0)), F.lit(1.0)).alias("max_rel"))


def in_blocks(sequence: DataFrame, reach: int, by: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, Window]:
    """sequence in blocks of BLOCK places (_block), each with the `reach` places behind it (_own false),
    and the order within blocks: windows that look so far ahead find what a whole sequence has."""
    block = F.floor(F.col("cpos") / BLOCK).cast("bigint")
    both = F.when((F.col("cpos") % BLOCK < reach) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    return sequence.withColumn("_block", F.explode(both)).withColumn("_own", F.col("_block") == block), Window.partitionBy(*by, "_block").orderBy("cpos")


def ngrams(sequence: DataFrame, n: int, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The n-grams of each sequence, at the position of their first item."""
    rows, order = in_blocks(sequence.select(*by, "cpos", "lemma"), n - 1, by)
    parts = [F.col("lemma"), *(F.lead("lemma", k).over(order) for k in range(1, n))]
    return rows.select(*by, "cpos", "_own", F.when(parts[-1].isNotNull(), F.concat_ws(" ", *parts)).alias("gram")).filter("_own and gram is not null").drop("_own")


def top_ngrams(sequence: DataFrame, n: int, limit: int = C.TOP_N) -> DataFrame:
    """doc_id, gram, freq, rank."""
    counts = ngrams(sequence, n).groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("freq"), F.min("cpos").alias("first"))
    return ranked(counts, "gram").filter(F.col("rank") <= limit).drop("first")


def cooccurrence(sequence: DataFrame, vocabulary: DataFrame | None = None, window: int = C.WINDOW) -> DataFrame:
    """doc_id, a, b, n: ordered pairs within `window` places; both ends in the vocabulary (doc_id, lemma).

    One ordered pass: each item looks at the next `window` ones, and a pair counts once, in the order of
    its words, before it is turned around. The sequence is shuffled once for it.
    """
    kept = sequence.select("doc_id", "cpos", "lemma")
    if vocabulary is not None:
        kept = kept.join(vocabulary.select("doc_id", "lemma").distinct(), ["doc_id", "lemma"], "left_semi")
    rows, order = in_blocks(kept, window)
    ahead = F.array(*(F.lead(F.struct("cpos", "lemma"), k).over(order) for k in range(1, window + 1)))
    near = rows.select("doc_id", "cpos", "lemma", "_own", ahead.alias("ahead")).filter("_own")
    pairs = near.select("doc_id", "lemma", F.explode(F.filter("ahead", lambda x: x["cpos"] <= F.col("cpos") + window)["lemma"]).alias("other"))
    counts = pairs.groupBy("doc_id", F.least("lemma", "other").alias("a"), F.greatest("lemma", "other").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    one, two = F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (2 * F.col("n")).alias("n")))).otherwise(F.array(one, two))
    return counts.select("doc_id", F.explode(both).alias("pair")).select("doc_id", "pair.*")


def _modularity_labels(weights: list[dict[int, float]], sweeps: int = 20) -> list[int]:
    """One level of local moves in node order, by modularity gain; labels in order of first appearance.
    weights: of each node, the links to others by their number."""
    n, degree = len(weights), [float(sum(row.values())) for row in weights]
    label, mass, total = list(range(n)), list(degree), float(sum(degree))
    if total == 0:
        return [0] * n
    for _ in range(sweeps):
        moved = False
        for i, row in enumerate(weights):
            own, inside = label[i], {}
            for j, w in row.items():
                inside[label[j]] = inside.get(label[j], 0.0) + w
            mass[own] -= degree[i]
            worth = {c: x / total - mass[c] * degree[i] / (total * total) for c, x in ({own: 0.0} | inside).items()}
            best, to = 0.0, own
            for c in sorted(inside):
                if worth[c] - worth[own] > best:
                    best, to = worth[c] - worth[own], c
            mass[to] += degree[i]
            label[i], moved = to, moved or to != own
        if not moved:
            break
    names: dict[int, int] = {}
    return [names.setdefault(c, len(names)) for c in label]


def communities(top_words: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, lemma, comm of each top word (doc_id, lemma, rank), from the links pairs (doc_id, a, b, n).

    A document's links, among its top words only, go to one call as an Arrow table; a sweep costs as much as
    there are links.
    """
    kind = dict(top_words.dtypes)["doc_id"]
    nodes = top_words.select("doc_id", F.col("lemma").alias("a"), F.lit(None).cast("string").alias("b"), F.col("rank").cast("bigint").alias("n"))
    links = pairs.filter("a <> b").select("doc_id", "a", "b", F.col("n").cast("bigint").alias("n"))

    def each(rows: pa.Table) -> pa.Table:
        every = list(zip(*(rows.column(c).to_pylist() for c in ("a", "b", "n")), strict=True))
        words = [a for _, a in sorted((n, a) for a, b, n in every if b is None)]
        at = {w: i for i, w in enumerate(words)}
        weights: list[dict[int, float]] = [{} for _ in words]
        for a, b, n in every:
            if b is not None and a in at and b in at and n > 0:
                weights[at[a]][at[b]] = n
        same = rows.column("doc_id").take(pa.array([0] * len(words), pa.int64()))
        return pa.table({"doc_id": same, "lemma": pa.array(words, pa.string()), "comm": pa.array(_modularity_labels(weights), pa.int32())})

    return nodes.unionByName(links).groupBy("doc_id").applyInArrow(each, f"doc_id {kind}, lemma string, comm int")


def mean_polarity(enriched: DataFrame) -> DataFrame:
    """doc_id, lemma, polarity: the mean over content words of known polarity."""
    return enriched.filter("not stop and polarity is not null").groupBy("doc_id", "lemma").agg(F.avg("polarity").alias("polarity"))


def select_words(freqs: DataFrame, relevance: DataFrame | None, sort: str = C.SORT, top_n: int = C.TOP_N, ngram: int = 1) -> DataFrame:
    """doc_id, word, freq, rel, rank: the words of a view, by frequency or by relevance.

    freqs: doc_id, word, freq. Relevance counts for single words only (1 where unknown or 0), which
    also need two characters. Ties go by the word in Spanish collation, then by code points.
    """
    w = freqs.select("doc_id", "word", "freq")
    if ngram == 1 and relevance is not None:
        r = relevance.select("doc_id", F.col("lemma").alias("word"), "rel")
        w = w.join(r, ["doc_id", "word"], "left").withColumn("rel", F.when(F.col("rel") != 0, F.col("rel")).otherwise(F.lit(1.0)))
    else:
        w = w.withColumn("rel", F.lit(1.0))
    w = w.filter(F.length("word") >= 2) if ngram == 1 else w
    metrics = ["rel", "freq"] if sort == "relevance" and ngram == 1 else ["freq", "rel"]
    order = Window.partitionBy("doc_id").orderBy(*map(F.desc, metrics), F.collate("word", "es"), "word")
    return w.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top_n)


def select_seeds(freqs: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, word, freq, rank: the seeds (ord, word) that occur in a document, in their order."""
    found = freqs.join(seeds, "word").filter("freq > 0")
    return found.withColumn("rank", F.row_number().over(in_order("ord")).cast("bigint")).select("doc_id", "word", "freq", "rank")
