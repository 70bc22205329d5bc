"""Word-graph traversals: breadth-first to a depth of a few hops, one join for each hop.

A word's edges are those under its own part of speech. Traversals start once from each distinct
word, whatever the number of documents it occurs in; documents join the result. A hop is read by the
next one, by the anti-joins of all later ones and by the result, so each is checkpointed; Hops keeps what was
walked, and is extended by more starts and greater depth instead of walked anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions.lineage import cut
from hilandera.operators.tokens import Assets, by_document, tag

_FLOWS = {"up": ["hypernyms"], "down": ["hyponyms"], "bi": [r for r, _ in C.RELATIONS]}


def edges_of(assets: Assets, flow: str = "bi") -> DataFrame:
    """src, dst, rel_ord, ord, label: the edges that a traversal follows."""
    rel = F.col("rel")
    order = reduce(lambda c, kv: c.when(rel == kv[1][0], kv[0]), enumerate(C.RELATIONS), F.when(F.lit(False), -1))
    label = reduce(lambda c, r: c.when(rel == r[0], r[1]), C.RELATIONS, F.when(F.lit(False), ""))
    # without a lexicon of parts of speech every node counts as a noun
    tagged = assets.edges.withColumn("_tag", F.lit("n")) if assets.pos is None else tag(assets.edges, "src", assets, "_tag")
    own = tagged.filter(F.col("pos") == F.col("_tag"))
    return own.filter(rel.isin(*_FLOWS[flow])).select("src", "dst", order.alias("rel_ord"), "ord", label.alias("label"))


def toward(links: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """links (at, dst) with need: the fewest hops (0 to most) from dst to one of the targets (word); links
    whose end is farther from all of them are left out."""
    near, need = targets.select(F.col("word").alias("dst")).distinct(), []
    for k in range(most + 1):
        need.append(near.withColumn("need", F.lit(k)))
        if k < most:
            near = links.join(near, "dst", "left_semi").select(F.col("at").alias("dst")).distinct()
    least = reduce(DataFrame.unionByName, need).groupBy("dst").agg(F.min("need").alias("need"))
    return links.join(least, "dst").select("at", "dst", "need")


@dataclass(frozen=True)
class Hops:
    """What was walked: seed, target, h (fewest hops, 1 to depth) from each start (seed) along links (at, dst)."""

    links: DataFrame
    starts: DataFrame
    table: DataFrame
    depth: int

    def extended(self, starts: DataFrame, depth: int) -> Hops:
        """These hops and those from other starts, all to a depth that is not smaller. Starts that are known
        go on from where they got to."""
        new = cut(starts.select("seed").distinct().join(self.starts, "seed", "left_anti"))
        every = self.starts.unionByName(new)
        found, front = [self.table], new.withColumn("at", F.col("seed"))
        seen = every.withColumn("at", F.col("seed")).unionByName(self.table.select("seed", F.col("target").alias("at")))
        for h in range(1, depth + 1):
            if h == self.depth + 1:
                ends = self.table.filter(F.col("h") == self.depth).select("seed", F.col("target").alias("at")) if self.depth else self.starts.withColumn("at", F.col("seed"))
                front = front.unionByName(ends)
            step = cut(_step(front, self.links, seen))
            found.append(step.select("seed", F.col("at").alias("target"), F.lit(h).alias("h")))
            front, seen = step, seen.unionByName(step)
        return Hops(self.links, every, reduce(DataFrame.unionByName, found), depth)


def _step(front: DataFrame, links: DataFrame, seen: DataFrame) -> DataFrame:
    return front.join(links, "at").select("seed", F.col("dst").alias("at")).distinct().join(seen, ["seed", "at"], "left_anti")


def nowhere(assets: Assets) -> Hops:
    """Hops along the lexicon's edges before any is taken."""
    links = cut(edges_of(assets).select(F.col("src").alias("at"), "dst").distinct())
    none = links.select(F.col("at").alias("seed")).limit(0)
    return Hops(links, none, none.select("seed", F.col("seed").alias("target"), F.lit(0).alias("h")), 0)


def reach(starts: DataFrame, edges: DataFrame, depth: int, targets: DataFrame | None = None) -> DataFrame:
    """seed, target, h: the fewest hops (1 to depth) from each distinct start (column seed); no seed reaches itself.

    targets (word): if only these are asked for, each hop is pruned from their side: it keeps the nodes from
    which a target is still within depth, and the last hop keeps targets alone.
    """
    links = cut(edges.select(F.col("src").alias("at"), "dst").distinct())
    if targets is not None:
        targets = cut(targets.select("word").distinct())
        links = cut(toward(links, targets, depth - 1))
    front = cut(starts.select("seed", F.col("seed").alias("at")).distinct())
    seen, found = front, []
    for h in range(1, depth + 1):
        step = cut(_step(front, links if targets is None else links.filter(F.col("need") <= depth - h), seen))
        found.append(step.select("seed", F.col("at").alias("target"), F.lit(h).alias("h")))
        front, seen = step, seen.unionByName(step)
    paths = reduce(DataFrame.unionByName, found)
    return paths if targets is None else paths.join(targets.withColumnRenamed("word", "target"), "target", "left_semi").select("seed", "target", "h")


def _in_documents(paths: DataFrame, freqs: DataFrame) -> DataFrame:
    """paths with both ends in a document: doc_id, seed, freq (of the seed), target, h."""
    f = freqs.select("doc_id", F.col("lemma").alias("seed"), "freq")
    ends = freqs.select("doc_id", F.col("lemma").alias("target"))
    return f.join(paths, "seed").join(ends, ["doc_id", "target"], "left_semi")


def asked_by_rarer(paths: DataFrame, words: DataFrame, depth: int) -> DataFrame:
    """lemma, codes: what each word (lemma, id, df) asks its documents for, one code for each path that it is
    the rarer end of: id of the other end * (2 depth + 1) + depth + h, h negative if the asking word is the
    target. A path costs as many codes as its rarer end has documents, however many the other one has."""
    ends = (words.select(F.col("lemma").alias(k), F.col("id").alias(f"{k}_id"), F.col("df").alias(f"{k}_df")) for k in ("seed", "target"))
    seed, target = ends
    first = F.col("seed_df") <= F.col("target_df")
    code = F.when(first, F.col("target_id") * (2 * depth + 1) + depth + F.col("h")).otherwise(F.col("seed_id") * (2 * depth + 1) + depth - F.col("h"))
    asks = paths.join(seed, "seed").join(target, "target").select(F.when(first, F.col("seed")).otherwise(F.col("target")).alias("lemma"), code.alias("code"))
    return asks.groupBy("lemma").agg(F.collect_list("code").alias("codes"))


def spread_activation(freqs: DataFrame, assets: Assets, depth: int = C.DEPTH, decay: float = C.DECAY, flow: str = C.FLOW) -> DataFrame:
    """doc_id, lemma, rel: each lemma's own energy 1 and decay^h from every lemma of the document h hops away.

    A path counts where a document has both ends. Its rarer end asks for the other in each of its documents;
    a document's questions are sent to it in lists and meet its words there.
    """
    if assets.edges is None:
        return freqs.select("doc_id", "lemma", F.lit(1.0).alias("rel"))
    words = cut(freqs.groupBy("lemma").agg(F.count(F.lit(1)).alias("df")).withColumn("id", F.monotonically_increasing_id()))
    paths = reach(words.select(F.col("lemma").alias("seed")), edges_of(assets, flow), depth, words.select(F.col("lemma").alias("word")))
    held = freqs.select("doc_id", "lemma").join(words.select("lemma", "id"), "lemma").join(asked_by_rarer(paths, words, depth), "lemma", "left")
    own = F.col("id") * (2 * depth + 1) + depth
    asks = by_document(held.select("doc_id", "lemma", "id", F.concat(F.array(own), F.coalesce("codes", F.array().cast("array<bigint>"))).alias("codes")))
    one = asks.select("doc_id", "lemma", "id", F.explode("codes").alias("code"))
    hops = (F.col("code") % (2 * depth + 1) - depth).cast("int")
    told = one.select("doc_id", "id", F.expr(f"code div {2 * depth + 1}").alias("word"), hops.alias("h"), F.when(hops == 0, F.col("lemma")).alias("lemma"))
    there = F.max(F.col("h") == 0).over(Window.partitionBy("doc_id", "word"))
    met = told.withColumn("there", there).filter("there").withColumn("gains", F.when(F.col("h") < 0, F.col("id")).otherwise(F.col("word")))
    more = F.sum(F.when(F.col("h") != 0, F.pow(F.lit(decay), F.abs("h"))))
    rel = met.groupBy("doc_id", "gains").agg(F.max("lemma").alias("lemma"), (1 + F.coalesce(more, F.lit(0.0))).alias("rel"))
    return rel.select("doc_id", "lemma", "rel")


def pair_activation(freqs: DataFrame, terms: DataFrame, assets: Assets, depth: int = C.DEPTH, decay: float = C.DECAY, flow: str = C.FLOW) -> DataFrame:
    """doc_id, seed, target, score = freq(seed) * decay^h for the terms (doc_id, word)."""
    t = terms.select("doc_id", F.col("word").alias("seed")).distinct()
    paths = reach(t, edges_of(assets, flow), depth, freqs.select(F.col("lemma").alias("word")))
    found = _in_documents(paths, freqs).join(t, ["doc_id", "seed"], "left_semi")
    return found.select("doc_id", "seed", "target", (F.col("freq") * F.pow(F.lit(decay), "h")).alias("score"))


def distances(pairs: DataFrame, assets: Assets, most: int) -> DataFrame:
    """pairs (a, b) with d: hops from a to b, 0 for equal words, -1 beyond `most`."""
    if assets.edges is None:
        return pairs.withColumn("d", F.when(F.col("a") == F.col("b"), 0).otherwise(-1))
    paths = reach(pairs.select(F.col("a").alias("seed")), edges_of(assets), most, pairs.select(F.col("b").alias("word"))).select(F.col("seed").alias("a"), F.col("target").alias("b"), "h")
    return pairs.join(paths, ["a", "b"], "left").withColumn("d", F.when(F.col("a") == F.col("b"), 0).otherwise(F.coalesce("h", F.lit(-1)))).drop("h")


def labelled(seeds: DataFrame, assets: Assets, depth: int = C.DEPTH) -> tuple[DataFrame, Hops]:
    """(seed, word, rel, dist of all that the seeds (word) reach, with the label of the first edge that
    gets there; the same as Hops).

    A path's key lists (relation, order) hop by hop; the least key is the first arrival.
    """
    edges = cut(edges_of(assets).select(F.col("src").alias("at"), "dst", "label", F.struct("rel_ord", "ord").alias("step")))
    starts = cut(seeds.select(F.col("word").alias("seed")).distinct())
    front = starts.select("seed", F.col("seed").alias("at"), F.array().cast("array<struct<rel_ord:int,ord:int>>").alias("key"))
    seen, found = front.select("seed", "at"), []
    for h in range(1, depth + 1):
        step = front.join(edges, "at").select("seed", F.col("dst").alias("at"), "label", F.concat("key", F.array(F.col("step").cast("struct<rel_ord:int,ord:int>"))).alias("key"))
        step = cut(step.join(seen, ["seed", "at"], "left_anti").groupBy("seed", "at").agg(F.min(F.struct("key", "label")).alias("x")).select("seed", "at", "x.key", "x.label"))
        found.append(step.select("seed", F.col("at").alias("word"), F.col("label").alias("rel"), F.lit(h).alias("dist")))
        front, seen = step.drop("label"), seen.unionByName(step.select("seed", "at"))
    paths = reduce(DataFrame.unionByName, found)
    links = edges.select("at", "dst").distinct()
    return paths, Hops(links, starts, paths.select("seed", F.col("word").alias("target"), F.col("dist").alias("h")), depth)


def in_corpus(paths: DataFrame, freqs: DataFrame) -> DataFrame:
    """doc_id, seed, word, rel, dist: the paths both of whose ends a document has."""
    here = freqs.select("doc_id", F.col("lemma").alias("seed")).join(paths, "seed")
    return here.join(freqs.select("doc_id", F.col("lemma").alias("word")), ["doc_id", "word"], "left_semi").select("doc_id", "seed", "word", "rel", "dist")


def expand_seeds(seeds: DataFrame, freqs: DataFrame, assets: Assets, depth: int = C.DEPTH) -> DataFrame:
    """doc_id, seed, word, rel, dist: the document's words around each of its seeds, with the label of
    the first edge that reaches them."""
    return in_corpus(labelled(seeds, assets, depth)[0], freqs)
