"""Near copies by five-word shingles, for the pipeline's stage: the links of the SimHash index, and
those of documents whose sets of shingles have a similarity (Jaccard) of 0.8 or more.

A SimHash of 64 bits cannot find the second kind: such pairs differ in some 10 of its bits, and no
index of segments prunes at that radius. So the stage takes simhash.py's components (fingerprints of
five-word shingles within two bits) and adds the rest by minimum hashes:

1. Texts of equal shingle sets are one class from here on.
2. Candidates: BANDS keys of ROWS minimum hashes each. Two classes of similarity s share a key with
   probability 1 - (1 - s^ROWS)^BANDS, which is 0.99994 at 0.8; what shares none is missed.
3. Each key's classes are linked to the smallest of them; the components of these links hold every
   pair of candidates. A component is dealt to blocks of some BLOCK_SETS classes, and each two of its
   blocks meet in one task, which counts exactly what their sets share and links those of 0.8 or more.
4. Both kinds of links make the components.

Defined cases: a text of fewer words than a shingle has is one shingle, one without words, or a null
one, has none and is a copy of its like; documents without a key stay; of rows that share a key one
stays; an empty table gives no rows; a text of any length is one row's work, its set of shingle hashes
being held; one_of_each keeps all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hilandera.llm import simhash
from hilandera.llm.common import join_hot, stored
from hilandera.llm.components import components, local_components

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 32, 6
SEED = 42
#: Classes of a component that meet in a task are twice this at most, or about.
BLOCK_SETS = 1000
#: Shingles hashed at a time.
SLICE = 2048
_U = np.uint64
_TURNS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_TURNS[0] |= _U(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    last = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)], np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """The keys of a set of shingles, as signed longs."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(found), SLICE):
        np.minimum(least, (_TURNS[0] * found[s : s + SLICE] + _TURNS[1]).min(1), out=least)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _class(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, cls, bands of each document with a key."""

    def each(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_class, sets), pa.binary()), pa.array(map(bands, sets), pa.list_(pa.int64()))], ["key", "cls", "bands"])

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(each, f"key {dict(docs.dtypes)[key]}, cls binary, bands array<long>")


def near_sets(sets: list[np.ndarray], others: list[np.ndarray] | None = None, least: float = LEAST):
    """(indices, indices) of sets of that similarity, for one set after the other: among the sets or,
    where others are given, between the two (the others' indices follow the sets')."""
    every = sets + (others or [])
    size = np.array([len(x) for x in every])
    number = np.unique(np.concatenate(every), return_inverse=True)[1]
    held = slice(0, len(number)) if others is None else slice(int(size[: len(sets)].sum()), len(number))
    order = np.argsort(number[held], kind="stable")
    holders = np.repeat(np.arange(len(every)), size)[held][order]
    ends = np.cumsum(np.bincount(number[held], minlength=number.max(initial=-1) + 1))
    begins, at = np.r_[0, ends[:-1]] if len(ends) else ends, np.r_[0, np.cumsum(size)]
    found = np.ones(len(every), bool)
    found[: 0 if others is None else len(sets)] = False
    for i in range(len(sets)):
        of = number[at[i] : at[i + 1]]
        n = ends[of] - begins[of]
        place = np.arange(n.sum()) + np.repeat(begins[of] - np.r_[0, np.cumsum(n)[:-1]], n) if len(of) else of
        both = np.bincount(holders[place], minlength=len(every))
        near = np.flatnonzero(found & (both >= least * (size + size[i] - both) - 1e-9))
        yield np.full(len(near), i), near


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, component: of each document with a key the smallest key reachable over near copies."""
    kind = dict(docs.dtypes)[key]
    named = docs.filter(F.col(key).isNotNull())
    each = stored(classes(named, key, text), "shingle-classes")
    distinct = stored(each.groupBy("cls").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("bands").alias("bands")), "shingle-bands")
    rows = distinct.select("cls", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    heads = stored(heads, "shingle-heads")
    linked = join_hot(rows, heads.drop("n"), "band", heads.select("band", "n")).filter("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b"))
    members = stored(components(linked).join(distinct.select(F.col("cls").alias("node"), "least"), "node"), "shingle-members")
    parts = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    # a block meets each block of its component, itself too where it is the only one
    members = stored(join_hot(members, parts, "root").withColumn("block", block), "shingle-blocks")

    def sets(batches):
        for b in batches:
            found = [shingles(t) for t in b.column("text").to_pylist()]
            right = pa.array([_class(x) == c for x, c in zip(found, b.column("node").to_pylist(), strict=True)], pa.bool_())
            held = pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("node"), b.column("parts"), b.column("block"), held], ["root", "cls", "parts", "block", "sets"]).filter(right)

    def joined(group: pa.Table) -> pa.Table:
        rows = sorted(set(zip(group.column("block").to_pylist(), group.column("cls").to_pylist(), group.column("sets").to_pylist(), strict=True)))
        names, found = [c for _, c, _ in rows], [np.frombuffer(x, np.uint64) for *_, x in rows]
        first = sum(b == rows[0][0] for b, *_ in rows)
        pairs = near_sets(found) if first == len(rows) else near_sets(found[:first], found[first:])
        label = local_components(len(names), pairs)
        away = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": pa.array([names[i] for i in away], pa.binary()), "b": pa.array([names[label[i]] for i in away], pa.binary())})

    texts = named.select(F.col(key).alias("least"), F.col(text).alias("text")).join(members, "least").select("root", "node", "parts", "block", "text")
    held = texts.mapInArrow(sets, "root binary, cls binary, parts int, block int, sets binary")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pairs = held.withColumn("other", other).select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "cls", "block", "sets")
    exact = stored(pairs.groupBy("root", "x", "y").applyInArrow(joined, "a binary, b binary"), "shingle-links")
    # classes of one SimHash component are linked to the smallest of them
    alike = simhash.near_duplicates(named, key, text, SHINGLE).select("key", "component")
    alike = alike.distinct().join(each.select("key", "cls").distinct(), "key")
    alike = stored(alike.select("component", "cls").distinct(), "shingle-simhash")
    first = stored(alike.groupBy("component").agg(F.min("cls").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "shingle-first")
    first = join_hot(alike, first.drop("n"), "component", first.select("component", "n")).filter("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b"))
    roots = components(exact.unionByName(first)).withColumnsRenamed({"node": "cls", "root": "of"})
    of = stored(distinct.select("cls", "least", "n").join(roots, "cls", "left").withColumn("of", F.coalesce("of", "cls")), "shingle-roots")
    best = of.groupBy("of").agg(F.min("least").cast(kind).alias("component"))
    by_class = stored(join_hot(of, best, "of").select("cls", "component"), "shingle-components")
    return join_hot(each.select("key", "cls"), by_class, "cls", distinct.select("cls", "n")).select("key", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies: the document of the smallest key of each component stays, and every
    document without a key. Of rows that share a key one stays."""
    found = near_duplicates(docs, key, text)
    kept = found.filter(F.col("key") == F.col("component")).select(F.col("key").alias(key)).distinct()
    named = docs.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return named.unionByName(docs.filter(F.col(key).isNull()))
