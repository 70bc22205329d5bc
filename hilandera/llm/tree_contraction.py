"""Parallel contraction of trees whose nodes turn their parent's time into their own.

A node's function is piecewise: sorted pieces (lo, slope 0 or 1, c), each valid from lo up to the next one's lo,
which give c or x + c; a null c says that the node gets no time. Times are not negative. `latest`
bounds the times that a node's function is asked for, and pieces beyond it are cut off, so that a
long chain's function stays short; null leaves it unbounded.

Contraction goes in rounds over what is left of the trees. Leaves are raked: nobody asks them any more.
Chains are compressed: a node with one child, whose hash is below its parent's and its child's, goes,
and the child takes over the composition of both functions and the parent. No two neighbours go that way in one
round, so about a third of a chain does. Each round is written down with its functions. Expansion takes
the rounds in reverse: a node that went has its parent of that round among those that stayed, so
one join gives its time. The tables shrink by a constant factor a round, so all the work is linear in the nodes,
and rounds grow with their logarithm, however deep or bushy a tree is. Nothing goes to the driver but
whether a round has rows; joins are by node and never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilandera.llm.common import HOT_ROWS, join_hot, stored

#: Beyond all times.
NEVER = 1 << 62
PIECES = "array<struct<lo: long, slope: int, c: long>>"


def piece(lo, slope: int, c) -> Column:
    return F.struct(_long(lo).alias("lo"), F.lit(slope).alias("slope"), _long(c).alias("c"))


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def applied(fn: Column, x: Column) -> Column:
    """fn at x; null where fn gives none or x is null."""
    at = F.try_element_at(F.filter(fn, lambda p: p["lo"] <= x), F.lit(-1))
    return let(at, lambda p: F.when(p["slope"] == 1, x + p["c"]).otherwise(p["c"]))


def _with_ends(fn: Column) -> Column:
    def ended(p, i):
        return F.struct(p["lo"].alias("lo"), p["slope"].alias("slope"), p["c"].alias("c"), F.coalesce(F.try_element_at(fn, i + 2)["lo"], F.lit(NEVER)).alias("hi"))

    return F.transform(fn, ended)


def composed(outer: Column, inner: Column, latest: Column) -> Column:
    """outer after inner, for times up to latest; neighbouring pieces that agree are one."""

    def through(p, ends):
        crossed = F.filter(ends, lambda q: (q["lo"] - p["c"] < p["hi"]) & (q["hi"] - p["c"] > p["lo"]))
        moved = lambda q: F.struct(
            F.greatest(p["lo"], q["lo"] - p["c"]).alias("lo"), q["slope"].alias("slope"), (q["c"] + q["slope"] * p["c"]).alias("c")
        )
        fixed = F.array(F.struct(p["lo"].alias("lo"), F.lit(0).alias("slope"), applied(outer, p["c"]).alias("c")))
        return F.when(p["slope"] == 1, F.transform(crossed, moved)).otherwise(fixed)

    def asked(pieces):
        return F.filter(pieces, lambda p: p["lo"] <= F.coalesce(latest, F.lit(NEVER)))

    def merged(pieces):
        return F.filter(pieces, lambda p, i: (i == 0) | ~let(F.try_element_at(pieces, F.when(i == 0, 1).otherwise(i)), lambda b: (b["slope"] == p["slope"]) & b["c"].eqNullSafe(p["c"])))

    every = let(_with_ends(outer), lambda ends: F.flatten(F.transform(_with_ends(inner), lambda p: through(p, ends))))
    return let(asked(every), merged)


def _round(left: DataFrame, k: int) -> DataFrame:
    """One round over the trees of `left` (id, parent, fn, latest): all its nodes, with `gone`."""
    kids = left.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("kid"))
    counted = left.join(kids.hint("merge"), "id", "left")
    rank = lambda c: F.xxhash64(F.lit(k), F.col(c))
    chosen = F.coalesce(F.col("parent").isNotNull() & (F.col("n") == 1) & (rank("id") < rank("parent")) & (rank("id") < rank("kid")), F.lit(False))
    passed = counted.filter(chosen).select(F.col("kid").alias("id"), F.col("parent").alias("up"), F.col("fn").alias("inner"), F.col("latest").alias("bound"))
    joined = counted.withColumn("gone", chosen | F.col("n").isNull()).join(passed.hint("merge"), "id", "left")
    through = F.col("up").isNotNull()
    return joined.select(
        "id",
        F.coalesce("up", "parent").alias("parent"),
        F.when(through, composed(F.col("fn"), F.col("inner"), F.col("bound"))).otherwise(F.col("fn")).alias("fn"),
        F.when(through, F.col("bound")).otherwise(F.col("latest")).alias("latest"),
        "gone",
    )


def times(nodes: DataFrame) -> DataFrame:
    """id, at (null: none) of each node. nodes: id (long, unique), parent (null for a root; each parent is a
    node, and there are no circles), fn and latest. A root's function is asked for time 0."""
    left, rounds = nodes.select("id", "parent", F.col("fn").cast(PIECES).alias("fn"), F.col("latest").cast("long").alias("latest")), []
    widest = left.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while not rounds or not left.isEmpty():
        done = stored(_round(left, len(rounds)), "contraction")
        rounds.append(done.filter("gone"))
        left = done.filter("not gone").drop("gone")
    known = None
    for gone in reversed(rounds):
        roots = gone.filter("parent is null").select("id", applied(F.col("fn"), F.lit(0).cast("long")).alias("at"))
        if known is None:
            known = stored(roots, "expansion")
            continue
        parents = known.select(F.col("id").alias("parent"), F.col("at").alias("x"))
        asking = gone.filter("parent is not null")
        # a parent of very many children would be one task's
        told = join_hot(asking, parents, "parent") if widest > HOT_ROWS else asking.join(parents.hint("merge"), "parent")
        known = stored(known.unionByName(roots).unionByName(told.select("id", applied(F.col("fn"), F.col("x")).alias("at"))), "expansion")
    return known
