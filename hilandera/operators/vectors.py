"""Word vectors (word, vec): similarity, nearest words, links, clusters."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hilandera.functions.lineage import cut

#: Parts of a vector whose norms bound its similarities.
PARTS = 8
#: Blocks of a search; vectors and queries that meet in one task, about.
PIVOTS, GROUP_ROWS, QUERY_ROWS = 64, 4096, 2000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where one is missing or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def similarities(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (a, b) with sim."""
    va, vb = (vectors.select(F.col("word").alias(k), F.col("vec").alias(f"_{k}")) for k in "ab")
    return pairs.join(va, "a", "left").join(vb, "b", "left").withColumn("sim", cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def profile(vec: Column, parts: int = PARTS) -> Column:
    """The norms of a vector's parts over its own norm; null for a zero vector."""
    squares = F.transform(vec, lambda x: x.cast("double") * x.cast("double"))
    width = F.greatest(F.ceil(F.size(vec) / parts), F.lit(1)).cast("int")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return F.when(total(squares) > 0, F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.sqrt(total(F.slice(squares, k * width + 1, width)) / total(squares))))


def alike(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """a, b, sim of the distinct pairs (a, b) whose similarity is above `least` (0 or more).

    A pair is compared once, whoever asks for it. By Cauchy and Schwarz a cosine is no larger than the sum
    of products of the two vectors' profiles; pairs that this leaves below `least` never meet their vectors.
    """
    forms = vectors.select("word", profile(F.col("vec")).alias("form")).filter("form is not null")
    one, two = (forms.select(F.col("word").alias(k), F.col("form").alias(f"_{k}")) for k in "ab")
    bound = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").filter(bound > least - 1e-9).select("a", "b")
    return similarities(near, vectors).filter(F.col("sim") > least)


def forms(vectors: DataFrame, name: str) -> DataFrame:
    """name, name_vec, name_norm: words with vectors that are not zero, their numbers as doubles and their norm."""
    vec = F.transform("vec", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select(F.col("word").alias(name), vec.alias(f"{name}_vec"), norm.alias(f"{name}_norm")).filter(F.col(f"{name}_norm") > 0)


def listed(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each vector, filled up with zeros, and the vectors' lengths (0: none)."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    rows = np.zeros((len(size), int(size.max(initial=0))))
    rows[np.arange(rows.shape[1]) < size[:, None]] = pc.list_flatten(vectors).to_numpy()
    return rows, size


@dataclass(frozen=True)
class Blocks:
    """Vectors (word, vec, block) in blocks around PIVOTS of them, with each block's covering angle.

    centres: unit vectors, a row for each block but the last, which holds the zero vectors; angle, size: by
    block, -1 and 0 for an empty one. All three are bounded by PIVOTS.
    """

    rows: DataFrame
    centres: np.ndarray
    angle: np.ndarray
    size: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The largest cosine that a vector of each block can have with each row of x; -2 for empty blocks."""
        apart = np.maximum(_angles(x, self.centres) - self.angle[:-1], 0)
        out = np.concatenate((np.cos(apart), np.zeros((len(x), 1))), axis=1)
        out[(x == 0).all(1)] = 0
        return np.where(self.size > 0, out, -2.0)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if not len(centres):
        return np.zeros((len(x), 0))
    norms = np.linalg.norm(x, axis=1)[:, None]
    return np.arccos(np.clip(np.divide(x @ centres.T, norms, out=np.zeros((len(x), len(centres))), where=norms > 0), -1, 1))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def in_blocks(vectors: DataFrame, pivots: int = PIVOTS) -> Blocks:
    """vectors in blocks. The pivots, a bounded number, are drawn by a hash of the word; blocks are
    checkpointed, as each search reads them twice."""
    word = dict(vectors.dtypes)["word"]
    known = vectors.filter(F.exists("vec", lambda x: x != 0))
    drawn = known.select(F.xxhash64("word").alias("h"), "vec").orderBy("h").limit(pivots).toPandas()["vec"]
    centres = np.unique(_matrix(drawn), axis=0) if len(drawn) else np.zeros((0, 1))
    centres /= np.linalg.norm(centres, axis=1)[:, None]

    def dealt(frames):
        for f in frames:
            if len(f):
                x = _matrix(f["vec"])
                angles = _angles(x, centres) if len(centres) else np.zeros((len(x), 1))
                zero = (x == 0).all(1)
                yield pd.DataFrame({"word": f["word"], "vec": f["vec"], "block": np.where(zero, len(centres), angles.argmin(1)), "angle": np.where(zero, 0, angles.min(1))})

    rows = cut(vectors.select("word", "vec").mapInPandas(dealt, f"word {word}, vec array<double>, block int, angle double"))
    angle, size = np.full(len(centres) + 1, -1.0), np.zeros(len(centres) + 1, int)
    for r in rows.groupBy("block").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():
        angle[r["block"]], size[r["block"]] = r["angle"] + 1e-9, r["n"]
    return Blocks(rows, centres, angle, size)


def nearest_blocks(queries: DataFrame, of: Blocks, k: int) -> DataFrame:
    """queries (word, vec) with bounds (by block) and first: the blocks of the largest bounds that hold
    more than k vectors together."""
    word, of = dict(queries.dtypes)["word"], replace(of, rows=None)

    def each(frames):
        for f in frames:
            if len(f):
                bounds = of.bounds(_matrix(f["vec"]))
                order = np.argsort(-bounds, axis=1, kind="stable")
                before = np.cumsum(of.size[order], axis=1) - of.size[order]
                first = [o[(b <= k) & (of.size[o] > 0)].tolist() for o, b in zip(order, before, strict=True)]
                yield pd.DataFrame({"word": f["word"], "vec": f["vec"], "bounds": bounds.tolist(), "first": first})

    return queries.select("word", "vec").mapInPandas(each, f"word {word}, vec array<double>, bounds array<double>, first array<int>")


def other_blocks(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """word, vec, block: the other blocks that can hold one of a query's k nearest, as their bound reaches
    the k-th of those found (word, sim, rank); all others are skipped."""
    kth = found.filter(F.col("rank") == k).select("word", F.col("sim").alias("kth"))
    every = asked.join(kth, "word", "left").select("word", "vec", "first", "kth", F.posexplode("bounds").alias("block", "bound"))
    reaches = (F.col("bound") > -2) & (F.col("bound") >= F.coalesce("kth", F.lit(-2.0)) - 1e-9)
    return every.filter(reaches & ~F.array_contains("first", F.col("block"))).select("word", "vec", "block")


def _searched(visits: DataFrame, of: Blocks, k: int, query_parts: int) -> DataFrame:
    """word, other, sim: each visited block's k best for a query, ties by the word. Large blocks are split in
    parts of some GROUP_ROWS vectors, the queries of a block in query_parts."""
    word = dict(of.rows.dtypes)["word"]
    parts = [(b, max(1, -(-int(n) // GROUP_ROWS))) for b, n in enumerate(of.size)]
    split = F.broadcast(visits.sparkSession.createDataFrame(parts, "block int, parts int"))
    upto = lambda n: F.sequence(F.lit(0), F.lit(n) - 1 if isinstance(n, int) else n - 1)
    asked = visits.join(split, "block").withColumn("part", F.explode(upto(F.col("parts")))).withColumn("turn", F.pmod(F.xxhash64("word"), F.lit(query_parts)).cast("int"))
    held = of.rows.join(split, "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("turn", F.explode(upto(query_parts)))
    key = ["block", "part", "turn"]

    def near(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"word": queries["word"][:0], "other": vectors["word"][:0], "sim": pd.Series([], dtype=float)})
        vectors = vectors.sort_values("word")
        x, q, others, words = _matrix(vectors["vec"]), _matrix(queries["vec"]), vectors["word"].to_numpy(), queries["word"].to_numpy()
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
        sim = np.divide(q @ x.T, norms, out=np.zeros(norms.shape), where=norms > 0)
        sim[words[:, None] == others] = -2
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(sim, best, 1)
        out = pd.DataFrame({"word": np.repeat(words, best.shape[1]), "other": others[best.ravel()], "sim": value.ravel()})
        return out[out["sim"] > -2]

    grouped = asked.select(*key, "word", "vec").groupBy(*key).cogroup(held.select(*key, "word", "vec").groupBy(*key))
    return grouped.applyInPandas(near, f"word {word}, other {word}, sim double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("sim"), "other")).cast("bigint")
    return found.select("word", "other", "sim").withColumn("rank", rank).filter(F.col("rank") <= k)


def most_similar(queries: DataFrame, vectors: DataFrame, k: int = 10, among: DataFrame | None = None) -> DataFrame:
    """word, other, sim, rank: the k nearest of all words (or those of `among`) to each query word.

    Vectors lie in blocks with covering angles. A query first searches the blocks that can be nearest and
    hold enough; the k-th it finds there tells which others can hold a nearer one, and only those are
    searched then. Queries stay in tables; the result is exact.
    """
    pool = vectors if among is None else vectors.join(among.select("word"), "word", "left_semi")
    of = in_blocks(pool)
    asked = queries.select("word").distinct().join(vectors, "word").select("word", "vec")
    asked = cut(nearest_blocks(asked, of, k))
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    found = cut(_ranked(_searched(asked.select("word", "vec", F.explode("first").alias("block")), of, k, parts), k))
    more = _searched(other_blocks(asked, found, k), of, k, parts)
    return _ranked(found.select("word", "other", "sim").unionByName(more), k)


def cross_links(presence: DataFrame, vectors: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, col, src, dst, sim: src is there in a column but not in the next, where dst is; both alike.

    presence: doc_id, col, word, is_real over a dense grid.
    """
    nxt = F.lead("is_real").over(Window.partitionBy("doc_id", "word").orderBy("col"))
    ending = presence.withColumn("_next", nxt).filter("is_real and not _next").select("doc_id", "col", F.col("word").alias("a"))
    there = presence.filter("is_real").select("doc_id", (F.col("col") - 1).alias("col"), F.col("word").alias("b"))
    pairs = ending.join(there, ["doc_id", "col"]).filter("a <> b")
    return similarities(pairs, vectors).filter(F.col("sim") >= least).select("doc_id", "col", F.col("a").alias("src"), F.col("b").alias("dst"), "sim")


def _spherical_means(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Cosine k-means from evenly spaced vectors, in single precision; ties to the lowest cluster."""
    n = len(x)
    centre = x[np.arange(k) * n // k].copy()
    size = np.sqrt((x.astype(float) ** 2).sum(1))
    label = np.full(n, -1)
    for _ in range(rounds):
        c = centre.astype(float)
        norm = size[:, None] * np.sqrt((c**2).sum(1))
        new = np.divide(x.astype(float) @ c.T, norm, out=np.zeros((n, k)), where=norm > 0).argmax(1)
        if (new == label).all():
            break
        label = new
        total, count = np.zeros((k, x.shape[1]), np.float32), np.bincount(label, minlength=k).astype(np.float32)[:, None]
        np.add.at(total, label, x)  # row by row
        centre = np.divide(total, count, out=centre, where=count > 0)
    return label


def clusters(words: DataFrame, vectors: DataFrame | None, k: int | None = None) -> DataFrame:
    """words (doc_id, word, rank) with cluster. k: by default a quarter of the words, 3 to 8."""
    if vectors is None:
        return words.withColumn("cluster", F.lit(0))
    kind = dict(words.dtypes)["doc_id"]
    both = words.select("doc_id", "word", "rank").join(vectors.select("word", "vec"), "word", "left")

    def each(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("rank").to_numpy(), kind="stable")))
        n = len(rows)
        wanted = min(k or min(8, max(3, n // 4)), n)
        known = rows.column("vec").is_valid().to_numpy()
        if known.sum() < wanted:
            label = np.arange(n) % max(1, wanted)
        else:
            label = np.zeros(n, int)
            label[known] = _spherical_means(np.array(rows.column("vec").filter(pa.array(known)).to_pylist(), np.float32), wanted)
        return rows.select(["doc_id", "word", "rank"]).append_column("cluster", pa.array(label.astype(np.int32)))

    word = dict(words.dtypes)["word"]
    return both.groupBy("doc_id").applyInArrow(each, f"doc_id {kind}, word {word}, rank bigint, cluster int")
