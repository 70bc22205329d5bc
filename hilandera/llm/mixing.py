"""Mixing sources to target weights, in DataFrame functions only.

1. Targets: the sources share a budget of words by weight, each up to a limit of epochs
   (water filling in closed form).
2. Blocks: a source's documents fall into 256 blocks by a seeded hash. A source is taken in whole
   passes over its blocks plus a last pass over a seeded permutation of them, cut where the target
   is reached: whole blocks, then whole sub-blocks of the one block that is cut, then documents of
   the one sub-block that is cut.
3. Splitting tree: the block quotas of all sources are halved again and again among the output
   shards. Each split draws the left half's blocks without replacement from the node's, so a
   node's quotas are a multivariate hypergeometric draw that adds up exactly.
4. Each shard draws its quota of disjoint blocks from the source's permuted list. Its rows are
   shuffled locally: they are dealt to partitions by ranges of a seeded key and sorted by it there, so
   that the numbered partitions hold the shards one after the other, each in its order.

No step gathers a source: blocks are sums of 256 rows a source, and a hot source is spread over its
blocks. Only the table of sources is ordered as a whole (one row a source). A row is one record of a
shard, whatever its text's length.

Defined cases: a null text has size 0; documents of size 0 follow their block; a null source is a
source, last in order; repeated rows are taken alike; an empty table gives no rows; other columns
are kept, and shard, copy and draw get a trailing underscore where the table has such columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hilandera.llm.common import SPACE, cut, free_name, stored

SEED = 4
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2.0
BLOCKS = 256
SUB_BLOCKS = 4096
#: 2^4 output shards.
LEVELS = 4
#: The table of blocks is broadcast up to this many rows (some 100 bytes each), joined by shuffle beyond.
BROADCAST_ROWS = 65_536
#: Bytes of text in a partition of a shard, about.
PART_BYTES = 32 << 20


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), SPACE + "+"), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size -> also target: words to take of the source.

    With r = limit / weight in ascending order, a source is at its limit if the level that the
    rest would reach without it is r at least; the level of the others then follows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    everything = Window.partitionBy()
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(epochs))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
        .select("source", "source_size", "target")
    )


def _place(seed: int, key: str) -> dict[str, Column]:
    h = F.xxhash64(F.lit(seed), F.col(key))
    return {"block": F.pmod(h, F.lit(BLOCKS)).cast("int"), "sub": F.pmod(F.shiftrightunsigned(h, 16), F.lit(SUB_BLOCKS)).cast("int"), "late": F.xxhash64(F.lit(seed + 1), F.col(key))}


def _null_safe(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on columns of which source may be null; b's copies of them are dropped."""
    b = b.withColumnsRenamed({c: f"{c}__" for c in on})
    cond = None
    for c in on:
        same = a[c].eqNullSafe(b[f"{c}__"])
        cond = same if cond is None else cond & same
    return a.join(b, cond, how).drop(*(f"{c}__" for c in on))


def plan(sized: DataFrame, key: str = "doc_id", seed: int = SEED, levels: int = LEVELS) -> DataFrame:
    """For each source and block: source_size, target, base (whole passes), state of the last pass
    (2 the whole block, 1 the part up to the threshold, 0 none), that threshold, and the shards
    of its passes.

    sized: source, size and the key of every document.
    """
    d = sized.select("source", "size", F.col(key).alias("key")).withColumns(_place(seed, "key"))
    blocks = cut(d.groupBy("source", "block").agg(F.sum("size").alias("words")))
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block")
    before = permuted.rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(
        _null_safe(blocks, goal, ["source"])
        .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
        .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("left", F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("state", F.when(F.col("left") >= F.col("words"), F.when(F.col("left") > 0, 2).otherwise(0)).when(F.col("left") > 0, 1).otherwise(0))
        .drop("rest")
    )
    limits = _thresholds(d, blocks.filter("state = 1").select("source", "block", "left"))
    shards = _deal(blocks.select("source", "block", (F.col("base") + (F.col("state") > 0).cast("int")).alias("units")), seed, levels)
    out = _null_safe(_null_safe(blocks, limits, ["source", "block"], "left"), shards, ["source", "block"], "left")
    return cut(out.drop("left", "words"))


def _thresholds(d: DataFrame, cut_blocks: DataFrame) -> DataFrame:
    """Of the one block a source that is cut: source, block, sub and threshold. Documents of a
    smaller sub-block, or of that one up to the threshold (late, key), are taken."""
    inside = _null_safe(d, cut_blocks, ["source", "block"])
    by_sub = Window.partitionBy("source").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = (
        inside.groupBy("source", "block", "sub", "left").agg(F.sum("size").alias("words"))
        .withColumn("left", F.col("left") - F.coalesce(F.sum("words").over(by_sub), F.lit(0)))
        .filter((F.col("left") > 0) & (F.col("left") < F.col("words")) | (F.col("left") == 0) & (F.col("words") > 0))
    )
    one = subs.groupBy("source").agg(F.min_by(F.struct("block", "sub", "left"), "sub").alias("x")).select("source", "x.*")
    order = Window.partitionBy("source").orderBy("late", "key").rowsBetween(Window.unboundedPreceding, 0)
    docs = _null_safe(inside.drop("left"), one, ["source", "block", "sub"]).withColumn("up_to", F.sum("size").over(order))
    taken = docs.filter(F.col("up_to") - F.col("size") / 2 <= F.col("left"))
    last = taken.groupBy("source").agg(F.max(F.struct("late", "key")).alias("threshold"))
    return _null_safe(one.drop("left"), last, ["source"], "left").withColumnRenamed("sub", "last_sub")


def _deal(units: DataFrame, seed: int, levels: int) -> DataFrame:
    """source, block, units -> source, block, shards: the output shard of each unit (pass over the block).

    The tree works on counts alone: quota blocks of each source in a node. A split ranks the node's
    quota by a seeded hash and gives the first half to the left child. Ranks are those within one of
    4096 ranges of the hash, and the counts of the ranges before it: no task ranks a whole node.
    """
    quota = units.groupBy("source").agg(F.sum("units").cast("int").alias("quota")).withColumn("node", F.lit(0)).filter("quota > 0")
    for level in range(levels):
        drawn = Window.partitionBy("node", "range").orderBy("h", F.col("source").asc_nulls_last(), "i")
        units_of = (
            quota.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("quota"))))
            .withColumn("h", F.xxhash64(F.lit(seed + 10 + level), "node", "source", "i"))
            .withColumn("range", F.shiftrightunsigned("h", 52))
        )
        # 4096 rows at most for each of the level's nodes
        before = Window.partitionBy("node").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = (
            units_of.groupBy("node", "range").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .withColumn("of", F.sum("n").over(Window.partitionBy("node")))
            .drop("n")
        )
        quota = (
            units_of.withColumn("rank", F.row_number().over(drawn)).join(F.broadcast(ranges), ["node", "range"])
            .withColumn("right", (2 * (F.col("before") + F.col("rank")) > F.col("of")).cast("int"))
            .groupBy("source", (2 * F.col("node") + F.col("right")).alias("node"))
            .agg(F.count(F.lit(1)).cast("int").alias("quota"))
        )
    ends = F.sum("quota").over(Window.partitionBy("source").orderBy("node")).cast("int")
    ranks = quota.withColumn("end", ends).withColumn("rank", F.explode(F.sequence(F.col("end") - F.col("quota") + 1, F.col("end")))).select("source", "rank", F.col("node").alias("shard"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 3), "source", "block", "unit"), "block", "unit")
    drawn = units.filter("units > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("units"))).alias("unit")).withColumn("rank", F.row_number().over(permuted))
    dealt = _null_safe(drawn, ranks, ["source", "rank"])
    return dealt.groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("unit", "shard"))), lambda x: x["shard"]).alias("shards"))


def planned(docs: DataFrame, the_plan: DataFrame, key: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """docs with a struct column mix: source_size, target, copies and the shards of these copies."""
    names = {k: free_name(docs, f"_{k}") for k in ("source", "block", "sub", "late", "mix")}
    d = docs.withColumn(names["source"], F.col(source)).withColumns({names[k]: c for k, c in _place(seed, key).items()})
    p = the_plan if the_plan.count() > BROADCAST_ROWS else F.broadcast(the_plan)
    p = p.select(F.struct("*").alias("p__"))
    both = d.join(p, d[names["source"]].eqNullSafe(F.col("p__.source")) & (d[names["block"]] == F.col("p__.block")))
    late, bound = F.struct(F.col(names["late"]).alias("late"), F.col(key).alias("key")), F.col("p__.threshold")
    part = (F.col(names["sub"]) < F.col("p__.last_sub")) | (F.col(names["sub"]) == F.col("p__.last_sub")) & F.coalesce(late <= bound, F.lit(False))
    last = F.when(F.col("p__.state") == 2, 1).when((F.col("p__.state") == 1) & F.coalesce(part, F.lit(True)), 1).otherwise(0)
    copies = F.col("p__.base") + last
    mix = F.struct(F.col("p__.source_size").alias("source_size"), F.col("p__.target").alias("target"), copies.alias("copies"), F.slice(F.coalesce(F.col("p__.shards"), F.array().cast("array<int>")), 1, copies).alias("shards"))
    return both.withColumn("mix__", mix).drop(*names.values(), "p__").withColumnRenamed("mix__", free_name(docs, "mix"))


def _sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    return cut(docs.select(F.col(source).alias("source"), F.col(key).alias("key"), word_count(text).alias("size"), F.octet_length(text).alias("bytes")))


def _drawn(docs: DataFrame, the_plan: DataFrame, n_bytes: int, source: str, key: str, seed: int, levels: int) -> DataFrame:
    out = planned(docs, the_plan, key, source, seed)
    mix = free_name(docs, "mix")
    shard, copy, draw = (free_name(docs, x) for x in ("shard", "copy", "draw"))
    taken = out.select(*docs.columns, F.posexplode(f"{mix}.shards").alias(copy, shard))
    taken = taken.withColumn(draw, F.xxhash64(F.lit(seed + 5), F.col(key), F.col(copy)))
    # ranges of draw of each shard
    pieces = max(1, math.ceil(SHARE * n_bytes / (1 << levels) / PART_BYTES))
    piece = F.least(F.floor((F.col(draw) / F.lit(2.0**64) + F.lit(0.5)) * F.lit(pieces)), F.lit(pieces - 1))
    return taken.repartitionById(pieces << levels, (F.col(shard) * F.lit(pieces) + piece).cast("int")).sortWithinPartitions(shard, draw)


def mixture(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, levels: int = LEVELS) -> DataFrame:
    """The mix: a row for each copy taken, with the columns of docs and copy (int, from 0),
    shard (int) and draw (long): rows are in the order of shard and draw, the shard's local shuffle."""
    sized = _sized(docs, text, source, key)
    n_bytes = sized.agg(F.sum("bytes")).first()[0] or 0
    return _drawn(docs, plan(sized, "key", seed, levels), n_bytes, source, key, seed, levels)


def digest(docs: DataFrame) -> DataFrame:
    """The mix written to the shared folder; one row for each document: what the written mix holds of it."""
    docs = docs.select("doc_id", "source", "text")
    sized = _sized(docs)
    the_plan = plan(sized, "key")
    n_bytes = sized.agg(F.sum("bytes")).first()[0] or 0
    mix = stored(_drawn(docs, the_plan, n_bytes, "source", "doc_id", SEED, LEVELS), "mix", "zstd")
    # rows that share key, source and size are taken alike
    of = ["doc_id", "source", "size"]
    copies = mix.groupBy("doc_id", "source", word_count().alias("size"), "copy").agg(F.max("shard").alias("shard"))
    copies = copies.groupBy(*of).agg(F.sum("size").alias("taken"), F.count(F.lit(1)).cast("int").alias("copies"), F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("shards"))
    goals = the_plan.select("source", "source_size", "target").distinct()
    out = _null_safe(sized.select(F.col("key").alias("doc_id"), "source", "size"), copies, of, "left")
    out = _null_safe(out, goals, ["source"])
    listed = F.array_join(F.transform("shards", lambda x: x["shard"].cast("string")), ",")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce(listed, F.lit("")).alias("shards"))
