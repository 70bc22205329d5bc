"""Connected components of a table of links, and of links held in a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hilandera.llm.common import delete, join_hot, stored_at


def local_components(n: int, pairs) -> np.ndarray:
    """The smallest reachable index of each of n nodes; pairs: arrays of linked indices, chunk by chunk."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node with a link.

    links: columns a and b of one orderable type. Large-star and small-star steps in turn: every
    link then leads to the root. Each step is a minimum, combined before the shuffle, joined back to
    the links; the links of a node are never gathered (a hub's are split for the join), and each round's
    links are written to the shared folder, in place of those of the round before.
    """
    links, path = stored_at(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both, least.drop("n"), "u", least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # each node's links lead to smaller nodes here: one a round and star that it was in
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        old = path
        links, path = stored_at(small, "links")
        delete(links.sparkSession, old)
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
