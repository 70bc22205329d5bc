"""Embedding near-duplicates by a cover-tree dual traversal, with exact threshold pairs.

Cosine c of unit vectors is distance sqrt(2 - 2c), so links are pairs within a radius r.

1. Vectors equal in every component are one entry with a weight.
2. Top level of the tree: pivots drawn by a hash of the vector, in proportion to the number of
   entries (a dense region gets many, so no cell is large). Each entry belongs to the cell of its
   nearest pivot; a cell's covering radius is the largest distance in it.
3. Pairs of a vector and a cell are pruned by the covering radius and by the distance to the plane
   between the two pivots. What is left visits the cell, from one side only, first as a sketch: what
   of the vector lies along a few directions, and the length of the rest. The product of two sketches
   is no less than the cosine, so a vector whose sketch reaches none of a cell leaves that cell, and a
   vector of the cell that none reaches is not put into its tree.
4. In a cell a cover tree of nested levels with halving radii stands over its own vectors, and others
   over some NODE_ROWS of its remaining visitors each (those of one home cell lie together). The tree is walked
   down with itself and with each of theirs: a pair of nodes is dropped if even both covering radii
   leave it out of reach, taken as a whole if they leave nothing out, else replaced by the pairs of
   its children. At the leaves the cosine itself decides.
5. A task returns sums of links and one star for each local component; stars are joined by
   large-star and small-star rounds.

A cell with many visitors is split by them. Sketches go out packed, once for GROUP cells. Where
vectors have no structure (random directions in many dimensions) no metric bound between vectors and
cells prunes much: the work is then a blocked matrix product of sketches and still quadratic.

Pivots are MAX_PIVOTS at most, as each task holds them all; beyond MAX_PIVOTS * CELL_ROWS distinct
vectors (16 million) cells grow, and with them what a task holds. No link is lost by that.

Defined cases: null or zero vectors and those with null or non-finite components link with nothing;
vectors of different lengths never link; a vector without an id counts as a link of others but
names no component; an empty table gives no rows; vectors of any length are one row's work; other
columns are not returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilandera.llm.common import join_hot, stored
from hilandera.llm.components import components, local_components

COSINE = 0.95
CELL_ROWS = 4096
#: Pivots that are broadcast at most; cells grow beyond that.
MAX_PIVOTS = 4096
VISITORS = 50_000
#: Visitors of a tree.
NODE_ROWS = 4096
#: Directions of a sketch, cells whose vectors meet sketches in one task (bits of a byte), and sketches that visit them there.
DIRECTIONS, GROUP, SKETCHES = 31, 8, 32_768
EPS = 1e-9
#: What rounding may take from the product of two sketches (some 2e-6 in single precision).
SLACK = 1e-5
CHUNK = 1024
#: Pairs of children from which on a pair of nodes is a matrix product of its own, and pairs listed at a time.
DENSE, LISTED = 4096, 1 << 16


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def _directions(pivots: np.ndarray) -> np.ndarray:
    """Orthonormal columns: first those along which (some CHUNK of) the pivots lie most, then any."""
    k = min(DIRECTIONS, pivots.shape[1])
    most = np.linalg.svd(pivots[:: -(-len(pivots) // CHUNK)], full_matrices=False)[2][:k]
    return np.linalg.qr(np.concatenate([most.T, np.random.default_rng(7).normal(size=(pivots.shape[1], k))], 1))[0][:, :k]


def _sketches(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A row for each unit vector; the product of two rows is their cosine at least (Cauchy and Schwarz on the rest)."""
    along = x @ directions
    return np.concatenate([along, np.sqrt(np.maximum(0.0, 1 - (along * along).sum(1)))[:, None]], 1).astype("<f4")


def _reached(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which sketches of a, and which of b, have a product of `least` with one of the other's (a is b: another one)."""
    of_a, of_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    width, height = 4 * CHUNK, CHUNK // 2
    for t in range(0, len(b), width):
        right = np.ascontiguousarray(b[t : t + width].T)
        for s in range(0, len(a), height):
            if a is b and t + width <= s:  # the same pairs as (t, s)
                continue
            c = a[s : s + height] @ right
            if a is b:
                i = np.arange(max(s, t), min(s + c.shape[0], t + c.shape[1]))
                c[i - s, i - t] = -1
            hit = c.max(1) >= least
            of_a[s : s + height] |= hit
            if hit.any():
                of_b[t : t + width] |= (c[hit] >= least).any(0)
    return (of_a | of_b,) * 2 if a is b else (of_a, of_b)


def sieve(own: np.ndarray, cell: np.ndarray, visitors: np.ndarray, cells: np.ndarray, cosine: float = COSINE, among: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(which of own meet a sketch that may link, visitors by cell: the same). own: sketches, each of one cell
    below GROUP; visitors: sketches, each with the bits of the cells that it visits."""
    met, kept = np.zeros(len(own), bool), np.zeros((len(visitors), GROUP), bool)
    for k in np.unique(cell):
        inside, coming = np.flatnonzero(cell == k), np.flatnonzero(cells >> k & 1)
        home = own[inside]
        if among:
            met[inside] |= _reached(home, home, cosine - SLACK)[0]
        kept[coming, k], of_home = _reached(visitors[coming], home, cosine - SLACK)
        met[inside] |= of_home
    return met, kept


class CoverTree:
    """Levels of nodes over unit vectors x: level k has centres (indices of x), each vector's node,
    the nodes' parents, covering radii and total weights. The last level has a node for each vector."""

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        self.x, n = x, len(x)
        centres, own = np.zeros(1, np.int64), np.zeros(n, np.int64)
        levels = [(centres, own)]
        radius = 1.0
        while len(centres) < n and radius > 0.05:
            centres, own = self._finer(centres, radius)
            levels.append((centres, own))
            radius /= 2
        levels.append((np.arange(n), np.arange(n)))
        # ancestors must be nested: a vector's node is its centre's ancestor, from the finest level up
        self.levels, below = [], None
        for centres, own in reversed(levels):
            member = own if below is None else own[below["centres"]][below["member"]]
            far = np.zeros(len(centres))
            np.maximum.at(far, member, _distance((x * x[centres[member]]).sum(1)))
            level = {"centres": centres, "member": member, "radius": far, "weight": np.bincount(member, weight, len(centres))}
            if below is not None:
                below["parent"] = parent = own[below["centres"]]
                order = np.argsort(parent, kind="stable")
                level |= {"children": order, "first": np.searchsorted(parent[order], np.arange(len(centres) + 1))}
            self.levels.insert(0, level)
            below = level

    def _finer(self, centres: np.ndarray, radius: float):
        """Centres that cover every vector within radius, the given ones first, and each vector's nearest."""
        x, least = self.x, 1 - radius * radius / 2
        best, own = np.full(len(x), -2.0), np.zeros(len(x), np.int64)

        def take(new: np.ndarray, base: int) -> None:
            for s in range(0, len(x), 4 * CHUNK):
                c = x[s : s + 4 * CHUNK] @ x[new].T
                k = c.argmax(1)
                m = c[np.arange(len(k)), k]
                closer = m > best[s : s + len(k)]
                best[s : s + len(k)][closer], own[s : s + len(k)][closer] = m[closer], base + k[closer]

        chosen = [centres]
        take(centres, 0)
        count = len(centres)
        while len(rest := np.flatnonzero(best < least)):
            some = rest[:CHUNK]
            near, free, new = x[some] @ x[some].T >= least, np.ones(len(some), bool), []
            for i in range(len(some)):
                if free[i]:
                    new.append(some[i])
                    free &= ~near[i]
            take(np.array(new), count)
            chosen.append(np.array(new))
            count += len(new)
        return np.concatenate(chosen), own


class Side:
    """A tree in a traversal: what was found for whole nodes, and where its vectors start among all."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, offset: int):
        self.tree, self.weight, self.offset = CoverTree(x, weight), weight, offset
        self.levels, self.last = self.tree.levels, len(self.tree.levels) - 1
        self.given = [np.zeros(len(level["centres"])) for level in self.levels]  # links of each vector of a node
        self.within, self.whole = ([np.zeros(len(level["centres"]), bool) for level in self.levels] for _ in "ab")

    def children(self, k: int, node: int, down: bool) -> np.ndarray:
        level = self.levels[k]
        return level["children"][level["first"][node] : level["first"][node + 1]] if down else np.array([node])

    def settle(self, links: np.ndarray, edges: list) -> None:
        """Adds what was found for nodes to their vectors."""
        for level, given, within, whole in zip(self.levels, self.given, self.within, self.whole, strict=True):
            own = slice(self.offset, self.offset + len(self.weight))
            links[own] += given[level["member"]] - within[level["member"]] * self.weight
            if whole.any():
                inside = np.flatnonzero(whole[level["member"]])
                edges.append((self.offset + inside, self.offset + level["centres"][level["member"][inside]]))


def _child_pairs(a: Side, la: int, i: np.ndarray, down_a: bool, b: Side, lb: int, j: np.ndarray, down_b: bool):
    """Chunks (nodes of a, nodes of b, their cosines or None) of the children's pairs of (i, j); a pair
    of nodes with many children comes as nodes, nodes and a matrix of cosines."""

    def counts(side, k, node, down):
        level = side.levels[k]
        return (level["first"][node], level["first"][node + 1] - level["first"][node]) if down else (node, np.ones(len(node), np.int64))

    (fa, na), (fb, nb) = counts(a, la, i, down_a), counts(b, lb, j, down_b)
    big = na * nb >= DENSE
    for k in np.flatnonzero(big):
        p, q = a.children(la, i[k], down_a), b.children(lb, j[k], down_b)
        right = b.tree.x[b.levels[lb + down_b]["centres"][q]].T
        for s in range(0, len(p), CHUNK):
            yield p[s : s + CHUNK], q, a.tree.x[a.levels[la + down_a]["centres"][p[s : s + CHUNK]]] @ right
    small = np.flatnonzero(~big)
    cuts = np.searchsorted(np.cumsum((na * nb)[small]), np.arange(LISTED, (na * nb)[small].sum() + LISTED, LISTED))
    for some in np.split(small, np.unique(cuts + 1)):
        if len(some):
            n = (na * nb)[some]
            at = np.repeat(some, n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p, q = fa[at] + k // nb[at], fb[at] + k % nb[at]
            yield (a.levels[la]["children"][p] if down_a else p), (b.levels[lb]["children"][q] if down_b else q), None


def _dual(a: Side, b: Side, cosine: float, links: np.ndarray, edges: list) -> None:
    """Adds the links between the vectors of two sides, or among those of one (a is b; then each pair of
    nodes is looked at once)."""
    same, r = a is b, math.sqrt(2 - 2 * cosine)
    waiting = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:
        la, lb, i, j = waiting.pop()
        down_a, down_b = la < a.last and (lb == b.last or la <= lb), lb < b.last and (la == a.last or lb <= la)
        ka, kb = la + down_a, lb + down_b
        ra, rb = a.levels[ka]["radius"], b.levels[kb]["radius"]
        for p, q, c in _child_pairs(a, la, i, down_a, b, lb, j, down_b):
            if c is None:
                c = (a.tree.x[a.levels[ka]["centres"][p]] * b.tree.x[b.levels[kb]["centres"][q]]).sum(1)
            else:
                m, n = np.nonzero(c >= 1 - (ra[p][:, None] + (rb[q] + (r + EPS))) ** 2 / 2)
                p, q, c = p[m], q[n], c[m, n]
            far = ra[p] + rb[q]
            near = c >= 1 - (r + EPS + far) ** 2 / 2
            if same:  # children of one node pair both ways round
                parent = a.levels[ka]["parent"]
                near &= (parent[p] != parent[q]) | (p <= q)
            p, q, c, far = p[near], q[near], c[near], far[near]
            if ka == a.last and kb == b.last:
                hit = (c >= cosine) & (p != q) if same else c >= cosine
                p, q = p[hit], q[hit]
                np.add.at(links, a.offset + p, b.weight[q])
                np.add.at(links, b.offset + q, a.weight[p])
                edges.append((a.offset + p, b.offset + q))
                continue
            all_in = _distance(c) + far <= r - EPS
            x, y = p[all_in], q[all_in]
            if len(x):
                np.add.at(a.given[ka], x, b.levels[kb]["weight"][y])
                other = x != y if same else slice(None)
                np.add.at(b.given[kb], y[other], a.levels[ka]["weight"][x[other]])
                if same:
                    a.within[ka][x[x == y]] = True
                a.whole[ka][x], b.whole[kb][y] = True, True
                edges.append((a.offset + a.levels[ka]["centres"][x], b.offset + b.levels[kb]["centres"][y]))
            p, q = p[~all_in], q[~all_in]
            waiting += [(ka, kb, p[s : s + LISTED], q[s : s + LISTED]) for s in range(0, len(p), LISTED)]


def cell_links(own: np.ndarray, weight: np.ndarray, visitors: np.ndarray, visitor_weight: np.ndarray, cosine: float = COSINE, among: bool = True):
    """(links of each vector, smallest linked index of each) over own and then visitors; links among
    visitors are not looked for, those among own vectors if `among`."""
    n, edges = len(own), []
    links = np.zeros(n + len(visitors))
    home = Side(own, weight, 0)
    if among:
        _dual(home, home, cosine, links, edges)
    for s in range(0, len(visitors), NODE_ROWS):
        guest = Side(visitors[s : s + NODE_ROWS], visitor_weight[s : s + NODE_ROWS], n + s)
        _dual(home, guest, cosine, links, edges)
        guest.settle(links, edges)
    home.settle(links, edges)
    return np.rint(links).astype(np.int64), local_components(len(links), edges)


def _pass(batches, pivots: np.ndarray, each):
    for b in batches:
        if b.num_rows:
            yield from each(b, _units(b.column("raw").to_pylist()), pivots)


def _same_length(entries: DataFrame, cosine: float) -> DataFrame:
    """id, links, root for entries (id, raw, n) of one length: one row for each part of the work that found links."""
    spark, r = entries.sparkSession, math.sqrt(2 - 2 * cosine)
    n = entries.count()
    n_cells = min(MAX_PIVOTS, max(1, math.ceil(n / CELL_ROWS)))
    if n_cells > 1:  # some n_cells rows, by a threshold on a uniform hash
        share = F.pmod(F.xxhash64(F.lit(7), "raw"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, n_cells / n))
        chosen = sorted(bytes(x["raw"]) for x in entries.filter(share).select("raw").collect()) or [bytes(entries.select("raw").first()[0])]
    else:
        chosen = [bytes(entries.select("raw").first()[0])]
    pivots = _units(chosen)
    directions = _directions(pivots)

    def home(b, x, p):
        c = x @ p.T
        k = c.argmax(1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k.astype(np.int32)), pa.array(_distance(c[np.arange(len(k)), k]))], [*b.schema.names, "cell", "far"])

    held = stored(entries.mapInArrow(lambda bs: _pass(bs, pivots, home), "id long, raw binary, n long, cell int, far double"), "cells")
    # one row for each cell
    radius = np.full(len(pivots), -1.0)
    for x in held.groupBy("cell").agg(F.max("far").alias("far")).collect():
        radius[x["cell"]] = x["far"]

    def visited(b, x, p):
        """For each row a byte for each group of cells, with a bit for each cell that the row visits."""
        cell, groups = b.column("cell").to_numpy(), np.zeros((len(x), -(-len(p) // GROUP)), np.uint8)
        for s in range(0, len(x), CHUNK):
            h = cell[s : s + CHUNK]
            d, between = _distance(x[s : s + CHUNK] @ p.T), _distance(p[h] @ p.T)
            mine = d[np.arange(len(h)), h][:, None]
            plane = (d * d - mine * mine) / np.maximum(2 * between, 1e-12)
            near = (d <= radius + r + 1e-7) & (plane <= r + 1e-7) & (radius >= 0) & (np.arange(len(p)) < h[:, None])
            groups[s : s + CHUNK] = np.packbits(near, 1, bitorder="little")
        return groups

    def count(b, x, p):
        n = np.count_nonzero(visited(b, x, p), 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0])], ["group", "n"])

    def visit(b, x, p):
        cell, ids, sketches, groups = b.column("cell").to_numpy(), b.column("id").to_numpy(), _sketches(x, directions), visited(b, x, p)
        for own, of, marks in ((True, cell // GROUP, cell % GROUP), (False, None, groups)):
            for g in range(groups.shape[1]):
                k = np.flatnonzero(of == g if own else marks[:, g])
                if len(k):
                    mark = (marks[k] if own else marks[k, g]).astype(np.uint8)
                    packed = [pa.array([v.tobytes()], pa.binary()) for v in (ids[k], mark, sketches[k])]
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([own]), *packed], ["group", "own", "ids", "marks", "sketches"])

    # one row for each group of cells
    parts = held.mapInArrow(lambda bs: _pass(bs, pivots, count), "group int, n long").groupBy("group").agg(F.ceil(F.sum("n") / SKETCHES).cast("int").alias("parts")).filter("parts > 1").collect()
    parts = F.broadcast(spark.createDataFrame([tuple(x) for x in parts], "group int, parts int"))
    visits = held.mapInArrow(lambda bs: _pass(bs, pivots, visit), "group int, own boolean, ids binary, marks binary, sketches binary")
    met = _dealt(visits.join(parts, "group", "left"), F.xxhash64("ids"), "own").groupBy("group", "part")

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        sides = []
        for own in (True, False):
            ids, marks, sketches = (b"".join(group.filter(pa.compute.equal(group.column("own"), own)).column(c).to_pylist()) for c in ("ids", "marks", "sketches"))
            sides.append((np.frombuffer(ids, "<i8"), np.frombuffer(marks, np.uint8), np.frombuffer(sketches, "<f4").reshape(-1, directions.shape[1] + 1)))
        (ids, cell, own), (guests, cells, visitors) = sides
        # sketches of a cell's own vectors meet one another in part 0 alone
        at_home, away = sieve(own, cell, visitors, cells, cosine, among=not key[1].as_py())
        i, k = np.nonzero(away)
        at = key[0].as_py() * GROUP + np.concatenate([cell[at_home], k]).astype(np.int32)
        return pa.table({"id": np.concatenate([ids[at_home], guests[i]]), "at": at.astype(np.int32)})

    kept = stored(met.applyInArrow(meet, "id long, at int").distinct(), "kept")
    # one row for each cell again
    parts = kept.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts")).filter("parts > 1").collect()
    parts = F.broadcast(spark.createDataFrame([tuple(x) for x in parts], "at int, parts int"))
    own = F.col("at") == F.col("cell")
    near = held.join(kept, "id").join(parts, "at", "left").select("at", "parts", "id", "raw", "n", F.when(own, -1).otherwise(F.col("cell")).alias("home"), own.alias("own"))

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("home", "ascending"), ("id", "ascending")])
        n_own = int(np.count_nonzero(group.column("home").to_numpy() < 0))
        x, w = _units(group.column("raw").to_pylist()), group.column("n").to_numpy().astype(float)
        # links among the cell's own vectors count in part 0 alone
        links, root = cell_links(x[:n_own], w[:n_own], x[n_own:], w[n_own:], cosine, among=not key[1].as_py())
        away = (links > 0) | (root != np.arange(len(root)))
        ids = group.column("id")
        return pa.table({"id": ids.filter(pa.array(away)), "links": links[away], "root": ids.take(pa.array(root[away]))})

    return _dealt(near, F.xxhash64("raw"), "own").groupBy("at", "part").applyInArrow(join, "id long, links long, root long")


def _dealt(rows: DataFrame, spread: Column, everywhere: str) -> DataFrame:
    """rows with part: one below `parts` (null: 1) by `spread`, or each of them where `everywhere` holds."""
    parts = F.coalesce("parts", F.lit(1))
    one = F.array(F.pmod(spread, parts).cast("int"))
    return rows.withColumn("part", F.explode(F.when(F.col(everywhere), F.sequence(F.lit(0), parts - 1)).otherwise(one))).drop("parts")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """key, n_links (other vectors linked directly), component (smallest key reachable) of each vector."""
    kind = dict(vectors.dtypes)[key]

    def read(batches):
        for b in batches:
            raw, lengths = [None] * b.num_rows, pa.compute.list_value_length(b.column(1)).fill_null(0).to_numpy()
            for length in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == length)
                # a null component is no finite one either
                x = b.column(1).take(pa.array(rows)).flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).reshape(-1, length)
                fit = np.isfinite(x).all(1) & x.any(1)
                for i, v in zip(rows[fit].tolist(), (x[fit] / np.abs(x[fit]).max(1)[:, None] + 0.0).astype("<f8"), strict=True):
                    raw[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["key", "raw"])

    rows = stored(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(read, f"key {kind}, raw binary"), "vectors")
    classes = rows.filter(F.col("raw").isNotNull()).groupBy("raw").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    # entries get numbers of their own, fixed as the table is written, as keys may be null or shared
    entries = stored(classes.withColumn("id", F.monotonically_increasing_id()), "entries")
    lengths = sorted(x[0] for x in entries.select(F.octet_length("raw")).distinct().collect())
    found = None
    for length in lengths:
        part = _same_length(entries.filter(F.octet_length("raw") == length).select("id", "raw", "n"), cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    found = stored(found, "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), "root")
    named = entries.select("raw", "id", "key", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = stored(named, "roots")
    best = named.groupBy("root").agg(F.min("key").alias("component"))
    named = join_hot(named, best, "root").join(links, "id", "left").select("raw", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # vectors that link with nothing have no entry
    unfit = rows.filter("raw is null").select("key", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast(kind).alias("component"))
    fit = join_hot(rows.filter("raw is not null"), named, "raw", entries.select("raw", "n")).select("key", "n_links", "component")
    return fit.unionByName(unfit).select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "key").alias("component"))


def digest(vectors: DataFrame) -> DataFrame:
    found = near_duplicates(vectors)
    kept = F.coalesce(F.col("key") == F.col("component"), F.lit(True))
    return found.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))
