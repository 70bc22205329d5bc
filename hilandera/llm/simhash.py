"""SimHash near-duplicates over a Gray-order hierarchical index.

1. Fingerprints: 64 bits of the hashes of a document's word shingles, by majority. Exact copies are
   one entry from here on.
2. Two fingerprints within LIMIT = 2 bits agree in one of three segments of 21 or 22 bits. So they
   are indexed in three rotations, each with another segment in front. Sorted by Gray rank, those
   that share the front segment stand together, and a block is a range of ranks that does not part
   them: every link lies within a block of some rotation, and nothing visits another block.
3. A block is a tree over its Gray order: a node holds the bits in which all below it agree (mask
   and value). Pairs of nodes are pruned from the top by the differences in their common masks, and
   only the leaves that are left are compared bit by bit.
4. Only a star of each local component leaves a task; components of the stars are found by
   large-star and small-star rounds.

A block that more than HOT_ROWS fingerprints share is cut again: first into its front segments, which
no link crosses; then, by the same argument as before, into the segments of the other bits; then into
segments of the bits that are left, after which 2^19 distinct fingerprints at most can share one. In a
task, a part of the tree where too little is pruned is cut in the same way, by thirds of the bits in
which its fingerprints differ, and each third's groups are trees again.

Defined cases: a text without words, or a null one, has fingerprint zero and links like any other;
a document without a key never names a component; rows that share a key keep one row each; an empty
table gives no rows; other columns are not returned (by one_of_each: kept); a text of any length is one
row's work, its shingles' hashes being all that is held of it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilandera.llm.common import BROADCAST_ROWS, cut, join_hot, stored
from hilandera.llm.components import components, local_components

SHINGLE = 3
SEED = 42
LIMIT = 2
BLOCK_ROWS = 4096
#: Fingerprints of a block beyond which it is cut again.
HOT_ROWS = 50_000
#: Width of each rotation's front segment, and (offset, width) of the segments behind it.
FRONTS = (21, 21, 22)
BEHIND = (((28, 15), (14, 14), (0, 14)), ((28, 15), (14, 14), (0, 14)), ((28, 14), (14, 14), (0, 14)))
LEAF, FAN = 16, 4
#: Comparisons for each fingerprint beyond which a part of the tree is cut again, and fingerprints up
#: to which it is not.
DENSE, SMALL = 4096, 2048
_U = np.uint64
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.r_[0, ends[:-1]].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=False)]
    h = np.array(hashes, "<u8")
    counts = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BITS[2 * counts > len(h)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp (the 64 bits as a signed long) of each document."""

    def each(batches):
        for b in batches:
            fp = np.array([fingerprint(t or "", shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(each, f"key {dict(docs.dtypes)[key]}, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of fp in Gray order, as a signed long that sorts like the unsigned one."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _rank(fp: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(k))
    return fp


class Tree:
    """Nodes over fingerprints in Gray order: levels[0] are leaves of LEAF fingerprints, each level above joins FAN nodes."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        ones, zeros = self._fold(fps, ~fps, LEAF)
        self.levels = [(ones, zeros)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._fold(*self.levels[-1], FAN))

    @staticmethod
    def _fold(ones: np.ndarray, zeros: np.ndarray, n: int):
        at = np.arange(0, len(ones), n)
        return np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)


def _children(i: np.ndarray, fan: int, n: int):
    """Index pairs (parent's place, child) of nodes i whose children are numbered fan by fan up to n."""
    child = i[:, None] * fan + np.arange(fan)
    place = np.broadcast_to(np.arange(len(i))[:, None], child.shape)
    return place[child < n], child[child < n]


def near_pairs(a: np.ndarray, b: np.ndarray, limit: int = LIMIT, most: float = math.inf):
    """Chunks of index pairs (i, j) with a[i] and b[j] within limit bits; None once more than
    `most` leaf comparisons would be needed. a and b must be in Gray order."""
    if not len(a) or not len(b):
        return
    left, right = Tree(a), Tree(b)
    x, y = len(left.levels) - 1, len(right.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        (a1, a0), (b1, b0) = left.levels[x], right.levels[y]
        # bits that are 1 in all of one node and 0 in all of the other
        apart = np.bitwise_count((a1[i] & b0[j]) | (a0[i] & b1[j]))
        i, j = i[apart <= limit], j[apart <= limit]
        if len(i) * LEAF * LEAF > most:
            yield None
            return
        if x == y == 0:
            break
        if x >= y:
            p, i = _children(i, FAN, len(left.levels[x - 1][0]))
            j, x = j[p], x - 1
        else:
            p, j = _children(j, FAN, len(right.levels[y - 1][0]))
            i, y = i[p], y - 1
    for s in range(0, len(i), 8192):
        p, m = _children(i[s : s + 8192], LEAF, len(a))
        q, n = _children(j[s : s + 8192][p], LEAF, len(b))
        m = m[q]
        near = np.bitwise_count(a[m] ^ b[n]) <= limit
        yield m[near], n[near]


def linked(fps: np.ndarray, at: np.ndarray):
    """Chunks of pairs of `at` that connect all fps within LIMIT bits; fps are distinct, in Gray order."""
    if len(fps) > SMALL:
        for pair in near_pairs(fps, fps, most=DENSE * len(fps)):
            if pair is None:
                break
            yield at[pair[0]], at[pair[1]]
        else:
            return
        differ = np.bitwise_or.reduce(fps ^ fps[0])
        bits = _BITS[differ & _BITS != 0]
        if len(bits) <= LIMIT:
            yield np.repeat(at[:1], len(at)), at
            return
        for third in np.array_split(bits, LIMIT + 1):
            value = fps & third.sum(dtype=np.uint64)
            order = np.argsort(value, kind="stable")
            ends = np.r_[np.flatnonzero(np.diff(value[order])) + 1, len(fps)]
            for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    yield from linked(fps[order[a:b]], at[order[a:b]])
    else:
        for i, j in near_pairs(fps, fps):
            yield at[i], at[j]


def local_stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, the first of its component) of all with links."""
    fps = fps[np.argsort(_rank(fps), kind="stable")]
    label = local_components(len(fps), linked(fps, np.arange(len(fps))))
    away = label != np.arange(len(fps))
    return fps[away], fps[label[away]]


def _turned(fps: np.ndarray, by: int) -> np.ndarray:
    """fps rotated left by some bits."""
    by %= 64
    return (fps << _U(by)) | (fps >> _U(64 - by)) if by else fps


def _rotated(turn: Column) -> Column:
    """fp rotated left so that the turn's segment stands in front."""
    out, start = F.col("fp"), 0
    for k, width in enumerate(FRONTS[:-1], 1):
        start += width
        out = F.when(turn == k, F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", 64 - start))).otherwise(out)
    return out


def _bits(x: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1))


def _by_turn(each) -> Column:
    """each(k) where column turn is k."""
    return F.when(F.col("turn") == 0, each(0)).when(F.col("turn") == 1, each(1)).otherwise(each(2))


def _by_front(rows: DataFrame) -> DataFrame:
    """A block's rows by front segment: cells turn, front, -1."""
    front = _by_turn(lambda k: F.shiftrightunsigned(_rotated(F.col("turn")), 64 - FRONTS[k]))
    return rows.withColumn("cell", F.array(F.col("turn").cast("long"), front, F.lit(-1).cast("long")))


def _by_behind(rows: DataFrame) -> DataFrame:
    """A front segment's rows by each segment of the other bits: cells turn, front, part, segment."""
    rot = _rotated(F.col("turn"))
    behind = _by_turn(lambda k: F.array(*(_bits(rot, *x) for x in BEHIND[k])))
    return rows.select("fp", "turn", "cell", F.posexplode(behind).alias("part", "segment")).withColumn("cell", F.concat(F.slice("cell", 1, 2), F.array(F.col("part").cast("long"), "segment"))).select("fp", "turn", "cell")


def _by_rest(rows: DataFrame) -> DataFrame:
    """And by thirds of the bits that neither segment has: cells of six."""
    rot = _rotated(F.col("turn"))

    def thirds(k: int, part: int) -> Column:
        rest, width = None, 0
        for i, (at, w) in enumerate(BEHIND[k]):
            if i != part:
                x = _bits(rot, at, w)
                rest, width = (x if rest is None else F.shiftleft(rest, w).bitwiseOR(x)), width + w
        return F.array(_bits(rest, 0, 10), _bits(rest, 10, 10), _bits(rest, 20, width - 20))

    part = F.col("cell")[2]
    segments = _by_turn(lambda k: F.when(part == 0, thirds(k, 0)).when(part == 1, thirds(k, 1)).otherwise(thirds(k, 2)))
    return rows.select("fp", "turn", "cell", F.posexplode(segments).alias("third", "value")).withColumn("cell", F.concat("cell", F.array(F.col("third").cast("long"), "value"))).select("fp", "turn", "cell")


def cells(distinct: DataFrame) -> DataFrame:
    """fp, turn, cell: two fingerprints (column fp) within LIMIT bits share a cell, and no cell but of the
    last cut holds more than HOT_ROWS of them."""
    n_blocks = max(1, math.ceil(distinct.count() / BLOCK_ROWS))
    block_bits = min(min(FRONTS), (n_blocks - 1).bit_length())
    rows = distinct.select("fp", F.explode(F.array(*map(F.lit, range(len(FRONTS))))).alias("turn"))
    rank = gray_rank(_rotated(F.col("turn"))).bitwiseXOR(F.lit(-(1 << 63)))
    block = F.shiftrightunsigned(rank, 64 - block_bits) if block_bits else F.lit(0).cast("long")
    rows, done = rows.withColumn("cell", F.array(F.col("turn").cast("long"), block)), None
    for deeper in (_by_front, _by_behind, _by_rest):
        hot = cut(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).select("cell", F.lit(True).alias("hot")))
        n = hot.count()
        if not n:
            break
        marked = rows.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, "cell", "left")
        cool = marked.filter("hot is null").drop("hot").select("fp", "turn", "cell")
        done = cool if done is None else done.unionByName(cool)
        rows = deeper(marked.filter("hot").drop("hot"))
    return rows if done is None else done.unionByName(rows.select("fp", "turn", "cell"))


def links(distinct: DataFrame) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all that lie within LIMIT bits."""

    def join(group: pa.Table) -> pa.Table:
        by = sum(FRONTS[: group.column("turn")[0].as_py()])
        a, b = local_stars(_turned(group.column("fp").to_numpy().view(np.uint64), by))
        return pa.table({"a": _turned(a, -by).view(np.int64), "b": _turned(b, -by).view(np.int64)})

    return cells(distinct).groupBy("cell").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp, component: of each document its fingerprint and the smallest key reachable over links."""
    each = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    classes = stored(each.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = components(links(classes.select("fp")))
    named = stored(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    best = named.groupBy("root").agg(F.min("least").alias("component"))
    by_class = stored(join_hot(named, best, "root").select("fp", "component"), "simhash-components")
    return join_hot(each, by_class, "fp", classes).select("key", "fp", "component")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: the document of the smallest key of each component stays, and
    every document without a key. Of rows that share a key one stays."""
    found = near_duplicates(docs, key, text)
    kept = found.filter(F.col("key") == F.col("component")).select(F.col("key").alias(key)).distinct()
    named = docs.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return named.unionByName(docs.filter(F.col(key).isNull()))


def digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("key").alias("doc_id"), hexadecimal(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
