"""Quarantine and cascading release: turns that fail are retried, and what depends on them waits.

Each turn has an arrival, possibly a parent among the earlier turns of its conversation, and possibly a
fault that is repaired at some time. It starts at its arrival or its parent's delivery, if that is later; a
faulty turn is tried again after 10, 20, 40, ... seconds until an attempt holds, six times at most. So each
turn is a piecewise function from the parent's delivery to its own; tree_contraction composes these, and
its expansion gives every turn's delivery. Then delivered turns are ranked by time.

No step needs a conversation in one task. Turns are numbered by a sort over ranges; sums and maxima over
a conversation run in blocks (functions/scans.py). Deliveries are bounded beforehand, so that functions
stay short: a path from one turn to a later one delays it by no more than what all the turns between
would, so with S the running sum of each turn's delay once it is repaired, and A the latest a turn can be
delivered on its own account, no delivery is later than S + (the running maximum of A - S). Releases are
ranked in blocks of time, as a conversation's turns arrive evenly.

Defined cases of the query: a null text is empty; a null conv_id is a conversation of its own and a null turn
comes first, both the empty string in the hash; equal turns of a conversation are numbered by
their texts' crc32; an empty table gives no rows; columns beyond conv_id, turn and text are not read. A
`state` beyond 64 bits wraps around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hilandera.functions.scans import carried, taken_over
from hilandera.llm.common import stored
from hilandera.llm.tree_contraction import piece, times

#: Seconds from a turn's start to its attempts.
ATTEMPTS = [10 * (2**a - 1) for a in range(6)]
SPACING = 7
#: Turns of a block, and the seconds in which so many arrive.
BLOCK = 4096
#: A table's rows within a partition, below the partition's number.
_WITHIN = (1 << 33) - 1


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with id (gapless from 0 by group, then order), first (the id of its group's first row) and p
    (id - first). Null groups are one group."""
    made = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id())
    # the write fixes the ranges, however often they are read again
    made = stored(made.withColumn("part", F.shiftright("at", 33)), "turns")
    parts = stored(made.groupBy(group, "part").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n")), "turns")
    base = carried(parts.groupBy("part").agg(F.sum("n").alias("base")).withColumn("all", F.lit(0)), ["all"], "part", {"base": "sum"}).drop("all")
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = taken_over(parts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))), base, ["part"]).drop("n")
    whole = taken_over(made, parts, [group, "part"], nulls=True)
    p, at = F.col("at") - F.col("begin") + F.col("earlier"), F.col("base") + F.col("at").bitwiseAND(F.lit(_WITHIN))
    return whole.select(*rows.columns, at.alias("id"), (at - p).alias("first"), p.alias("p"))


def attempt(start: Column, repair: Column, holds: Column) -> Column:
    """The number of the first attempt from 1 on that delivers; null if all fail. repair: null without a fault."""
    tried = F.transform(F.array(*(F.lit(a).cast("long") for a in ATTEMPTS)), lambda after, i: (start + after >= repair) & F.get(holds, i))
    n = F.array_position(tried, True).cast("int")
    return F.when(repair.isNull(), F.lit(1)).when(n > 0, n)


def after(n: Column) -> Column:
    """Seconds from the start to attempt n."""
    return F.when(n.isNotNull(), F.element_at(F.array(*(F.lit(a).cast("long") for a in ATTEMPTS)), n))


def delivery(arrival: Column, repair: Column, holds: Column) -> Column:
    """The pieces of a turn's function: the parent's delivery -> its own (null: never)."""
    at_arrival = piece(0, 0, arrival + after(attempt(arrival, repair, holds)))
    # from repair - after(a) on, attempt a can hold; the earliest attempt that can is taken
    steps = F.filter(
        F.transform(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("after")) for i, a in reversed(list(enumerate(ATTEMPTS))))), lambda s: F.struct(F.get(holds, s["i"]).alias("holds"), (repair - s["after"]).alias("lo"), s["after"].alias("c"))),
        lambda s: s["holds"],
    )
    later = arrival + 1
    begin = F.greatest(later, F.coalesce(F.try_element_at(F.filter(steps, lambda s: s["lo"] <= later), F.lit(-1))["lo"], later))
    now = F.try_element_at(F.filter(steps, lambda s: s["lo"] <= later), F.lit(-1))["c"]
    at_later = F.struct(begin.alias("lo"), F.when(now.isNull(), 0).otherwise(1).alias("slope"), now.alias("c"))
    rest = F.transform(F.filter(steps, lambda s: s["lo"] > later), lambda s: F.struct(s["lo"].alias("lo"), F.lit(1).alias("slope"), s["c"].alias("c")))
    faulty = F.concat(F.array(at_arrival, at_later), rest)
    return F.when(repair.isNull(), F.array(piece(0, 0, arrival), piece(later, 1, 0))).otherwise(faulty)


def bounded(turns: DataFrame) -> DataFrame:
    """turns with latest, which no delivery in the conversation up to the turn exceeds."""
    held = F.transform(F.filter(F.sequence(F.lit(0), F.lit(len(ATTEMPTS) - 1)), lambda i: F.get(F.col("holds"), i)), lambda i: F.get(F.array(*map(F.lit, ATTEMPTS)), i).cast("long"))
    faulty = F.col("repair").isNotNull() & (F.size(held) > 0)
    # once repaired, a turn is delivered by its first attempt that holds; before, at the longest wait after the repair
    delay = F.when(faulty, F.get(held, F.lit(0))).otherwise(0)
    own = F.when(faulty, F.greatest(F.col("repair"), F.col("arrival")) + F.array_max(held)).otherwise(F.col("arrival"))
    rows = turns.withColumn("block", F.floor(F.col("p") / BLOCK).cast("long")).withColumn("delay", delay.cast("long")).withColumn("own", own)
    to_here = Window.partitionBy("first", "block").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    # several tables follow from the rows, and more from the totals
    rows = stored(rows.withColumn("s", F.sum("delay").over(to_here)).withColumn("m", F.max(F.col("own") - F.col("s")).over(to_here)).drop("delay", "own"), "bounds")
    totals = stored(rows.groupBy("first", "block").agg(F.max("s").alias("s0"), F.max("m").alias("top")), "bounds")
    sums = carried(totals.drop("top"), ["first"], "block", {"s0": "sum"})
    tops = taken_over(totals.drop("s0"), sums, ["first", "block"]).withColumn("m0", F.col("top") - F.col("s0")).drop("top")
    carry = carried(tops, ["first"], "block", {"m0": "max"})
    latest = F.col("s") + F.col("s0") + F.greatest(F.col("m0"), F.col("m") - F.col("s0"))
    return taken_over(rows, carry, ["first", "block"]).select(*turns.columns, latest.alias("latest"))


def deliver(turns: DataFrame) -> DataFrame:
    """turns (id, first, p, parent, arrival, repair, holds) with status, attempts, first_at and last_at.

    parent: the id of an earlier turn of the same conversation, or null; repair: null without a fault;
    holds: whether each attempt holds once the fault is repaired.
    """
    nodes = bounded(turns.select("id", "first", "p", "parent", "arrival", "repair", "holds"))
    ends = times(stored(nodes.select("id", "parent", delivery(F.col("arrival"), F.col("repair"), F.col("holds")).alias("fn"), "latest"), "nodes"))
    told = turns.join(ends.select(F.col("id").alias("parent"), F.lit(True).alias("known"), F.col("at").alias("since")).hint("merge"), "parent", "left")
    blocked = F.col("known").isNotNull() & F.col("since").isNull()
    start = F.when(~blocked, F.greatest(F.col("arrival"), F.col("since")))
    told = told.withColumn("first_at", start).withColumn("good", F.when(~blocked, attempt(F.col("first_at"), F.col("repair"), F.col("holds"))))
    n = F.when(blocked, 0).otherwise(F.coalesce("good", F.lit(len(ATTEMPTS))))
    status = F.when(blocked, "blocked").when(F.col("good").isNull(), "dead").otherwise("delivered")
    return told.select(*turns.columns, status.alias("status"), n.cast("int").alias("attempts"), "first_at", (F.col("first_at") + after(F.nullif(n, F.lit(0)))).alias("last_at"))


def released(turns: DataFrame, order: list[str], weight: str) -> DataFrame:
    """Delivered turns with release_no (from 1 in each conversation, by last_at, then order) and state (the
    sum of release_no * weight up to here)."""
    rows = turns.withColumn("span", F.floor(F.col("last_at") / (BLOCK * SPACING)).cast("long"))
    by_time = Window.partitionBy("first", "span").orderBy("last_at", *order)
    here = by_time.rowsBetween(Window.unboundedPreceding, 0)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    rows = rows.withColumn("k", F.row_number().over(by_time).cast("long"))
    rows = rows.withColumn("w", F.sum(big(weight)).over(here).cast("decimal(19,0)")).withColumn("kw", F.sum(F.col("k") * F.col(weight)).over(here).cast("decimal(38,0)"))
    rows = stored(rows, "releases")
    totals = stored(rows.groupBy("first", "span").agg(F.max("k").alias("k0"), F.max("w").alias("w_all"), F.max("kw").alias("kw_all")), "releases")
    counts = carried(totals.select("first", "span", "k0"), ["first"], "span", {"k0": "sum"})
    sums = taken_over(totals.drop("k0"), counts, ["first", "span"]).withColumn("s0", (big("k0") * F.col("w_all") + F.col("kw_all")).cast("decimal(38,0)")).drop("w_all", "kw_all")
    carry = carried(sums, ["first"], "span", {"s0": "sum"})
    state = F.col("s0") + big("k0") * F.col("w") + F.col("kw")
    whole, half = F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")
    wrapped = F.pmod(state.cast("decimal(38,0)"), whole)
    wrapped = F.when(wrapped >= half, wrapped - whole).otherwise(wrapped).cast("long")
    return taken_over(rows, carry, ["first", "span"]).select(*turns.columns, (F.col("k") + F.col("k0")).cast("long").alias("release_no"), wrapped.alias("state"))


def digest(conversations: DataFrame) -> DataFrame:
    """The replay of all conversations under the query's rule: arrivals, parents and faults follow from hashes."""
    weight = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("weight")
    rows = numbered(conversations.select("conv_id", "turn", weight), "conv_id", ["turn", "weight"])
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    h = lambda k: F.crc32(F.concat(F.lit(f"{k}:"), name).cast("binary"))
    back, arrival = h(0) % 5, SPACING * F.col("p")
    turns = rows.select(
        "*",
        F.when((back > 0) & (back <= F.col("p")), F.col("id") - back).alias("parent"),
        arrival.alias("arrival"),
        F.when(h(1) % 101 < 50, arrival + h(2) % 101).alias("repair"),
        F.array(*(h(a + 2) % 3 != 0 for a in range(1, len(ATTEMPTS) + 1))).alias("holds"),
    )
    done = stored(deliver(stored(turns, "turns")), "deliveries")
    out = ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]
    free = done.filter("status = 'delivered'").select("conv_id", "turn", "status", "attempts", "first_at", "last_at", "first", "p", "weight")
    rest = done.filter("status <> 'delivered'").withColumns({"release_no": F.lit(None).cast("long"), "state": F.lit(None).cast("long")})
    return released(free, ["turn", "weight", "p"], "weight").select(*out).unionByName(rest.select(*out))
