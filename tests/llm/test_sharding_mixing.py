import math
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hilandera.llm import mixing, sharding

from .conftest import by_id


def slots(rows, shard="shard", slot="slot"):
    by = defaultdict(list)
    for r in rows:
        by[r[shard]].append(r[slot])
    return by


def test_shards_are_even_and_gapless(spark, odd, none):
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    rows = sharding.shard_documents(docs, bucket_bytes=2000).collect()
    by = slots(rows)
    assert sorted(by) == list(range(40)) and {len(x) for x in by.values()} == {25, 26}
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sorted(r.doc_id for r in rows) == list(range(1003))
    again = sharding.shard_documents(docs, bucket_bytes=2000).collect()
    assert sorted(rows) == sorted(again)
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))][:30] != list(range(30))
    out = sharding.shard_documents(odd)
    assert out.count() == odd.count() and {"shard_", "slot_"} <= set(out.columns)
    assert sharding.shard_documents(none).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(sharding.shard_documents(docs, shards=3), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 100


def numbered_files(folder):
    return sorted(f for f in folder.iterdir() if f.name.startswith("part-"))


def test_the_query_writes_whole_records_in_slot_order(spark, tmp_path, monkeypatch):
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"))
    sharding.write_shards(sharding.shard_documents(docs, bucket_bytes=2000), f"file://{tmp_path}/s")
    for shard in (tmp_path / "s").glob("shard=*"):
        slots = [x for f in numbered_files(shard) for x in pq.ParquetFile(f).read()["slot"].to_pylist()]
        assert slots == list(range(len(slots))) and len(slots) in (25, 26)
    monkeypatch.setattr(sharding, "new_folder", lambda spark, label: f"file://{tmp_path}/shared/{label}")
    docs.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    rows = {r.doc_id: r for r in sharding.digest(spark, f"file://{tmp_path}/sf").collect()}
    (written,) = (tmp_path / "shared").iterdir()
    held = {r.doc_id: r for r in spark.read.parquet(f"file://{written}").collect()}
    assert len(rows) == len(held) == 1003 and all((r.shard, r.slot) == (held[i].shard, held[i].slot) for i, r in rows.items())
    assert all(held[i].text == f"some text {i}" and r.text_crc32 == zlib.crc32(held[i].text.encode()) for i, r in rows.items())


def water(sizes, budget=1.5, weights=(5, 2, 1), epochs=2):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), budget * sum(sizes.values())
    while free and left > 1e-9:
        total, over = sum(w[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * w[s] / total
        for s in list(free):
            if target[s] >= epochs * sizes[s]:
                over += target[s] - epochs * sizes[s]
                target[s] = epochs * sizes[s]
                free.discard(s)
        left = over
    return target


def test_mix_meets_its_targets(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"),
    )
    rows = mixing.digest(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
        assert r.shards.count(",") + 1 == r.copies or not r.copies
    want = water(sizes)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9)
    assert all(abs(taken[s] - want[s]) <= 13 for s in sizes)
    assert sorted(rows) == sorted(mixing.digest(docs).collect())
    mixed = mixing.mixture(docs)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert {r.shard for r in mixed.collect()} == set(range(16))


def test_the_mix_is_made_in_the_order_of_its_draws(spark, tmp_path, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("w "), 9).alias("text"))
    monkeypatch.setattr(mixing, "PART_BYTES", 1000)
    mixing.mixture(docs).write.parquet(f"file://{tmp_path}/mix")
    rows = [(r["shard"], r["draw"]) for f in numbered_files(tmp_path / "mix") for r in pq.ParquetFile(f).read().to_pylist()]
    assert len(numbered_files(tmp_path / "mix")) > 16 and rows == sorted(rows) and len(set(rows)) == len(rows)
    made = []
    monkeypatch.setattr(mixing, "stored", lambda df, *_: made.append(df.cache()) or made[-1])
    digest = mixing.digest(docs).collect()
    assert sorted(r.doc_id for r in made[0].collect()) == sorted(r.doc_id for r in digest for _ in range(r.copies)) and "text" in made[0].columns
    shards = {(r.doc_id, r.copy): r.shard for r in made[0].collect()}
    assert all(r.shards == ",".join(str(shards[r.doc_id, k]) for k in range(r.copies)) for r in digest)


def test_odd_documents(odd, none):
    rows = by_id(mixing.digest(odd))
    assert rows[3][0].size == 0 and rows[4][0].size == 0 and len(rows[7]) == 2
    mixed = mixing.mixture(odd)
    assert {"copy_", "shard_", "draw_"} <= set(mixed.columns)
    assert mixing.digest(none).count() == 0 and mixing.mixture(none).count() == 0
