import random

import pytest
from pyspark.sql import functions as F

from hilandera.functions import scans
from hilandera.functions.scans import carried, taken_over
from hilandera.operators import stats, weave
from hilandera.operators import tokens as tok


@pytest.mark.parametrize("fan", [2, 7, 4096])
def test_totals_are_carried(spark, fan):
    rng = random.Random(fan)
    rows = [(k, b, rng.randint(-9, 9), rng.choice([None, rng.randint(0, 99)]), rng.choice([None, f"v{b}"])) for k in ("a", "b", None) for b in range(60) if rng.random() < 0.8]
    totals = spark.createDataFrame(rows, "k string, block long, n long, top long, seen string")
    got = {(r.k, r.block): (r.n, r.top, r.seen) for r in carried(totals, ["k"], "block", {"n": "sum", "top": "max", "seen": "last"}, fan, nulls=True).collect()}
    assert len(got) == len(rows)
    for k, b, *_ in rows:
        before = [r for r in rows if r[0] == k and r[1] < b]
        tops, seen = [r[3] for r in before if r[3] is not None], [r[4] for r in before if r[4] is not None]
        assert got[k, b] == (sum(r[2] for r in before), max(tops, default=None), seen[-1] if seen else None)


def test_blocks_take_over_by_null_keys_too(spark):
    rows = spark.createDataFrame([(None, 0, 1), (None, 1, 2), ("a", 0, 3)], "k string, block long, v long")
    carry = rows.groupBy("k", "block").agg(F.sum("v").alias("base"))
    assert sorted(map(str, taken_over(rows, carry, ["k", "block"], nulls=True).collect())) == sorted(map(str, rows.withColumn("base", F.col("v")).collect()))
    assert carried(carry.limit(0), ["k"], "block", {"base": "sum"}).count() == 0


TEXT = "No sé, la luz del mar.\n\nNunca el sol; y la casa grande ‘de’ piedra — jamás ríe 10 veces con el mar azul.  Los peces\tno nadan \n\n en  seco, ni el gato feliz.\r\n\r\nFin - 2020 façade no "


def long_and_short(spark):
    """Texts in which all that is carried crosses blocks: negations, paragraphs, n-grams, passages."""
    rng = random.Random(11)
    pieces = TEXT.split(" ")
    texts = [TEXT, "no " * 40 + "sol " * 9, "", None, " ".join(rng.choices(pieces, k=700)), "y" * 500 + " sol mar", TEXT * 9]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("block", [16, 70])
def test_blocks_equal_whole_windows(spark, monkeypatch, block):
    docs = long_and_short(spark)
    vad = spark.createDataFrame([(w, 0.9, 0.5, 0.5) for w in ("luz", "mar", "sol", "grande", "piedra", "azul", "feliz", "gato")], "lemma string, v double, a double, d double")

    def everything(size):
        monkeypatch.setattr(tok, "BLOCK", size)
        monkeypatch.setattr(stats, "BLOCK", size)
        monkeypatch.setattr(scans, "FAN", 3 if size < 100 else 4096)
        annotated = tok.annotate(tok.tokenize(docs))
        content = tok.content(annotated)
        toned = tok.negate(tok.add_sentiment(annotated.filter("type = 'w'"), tok.Assets(vad=vad)))
        words = tok.words(annotated)
        tables = [
            annotated.drop("long"), content.drop("long"), words.drop("long"), toned.select("doc_id", "pos", "polarity"), stats.ngrams(content, 2), stats.ngrams(content, 3),
            stats.cooccurrence(content, window=4), stats.frequencies(content), weave.passages(words, "mar", "sol"), weave.passages(words, "sol", "sol"),
        ]
        return [sorted(map(str, t.collect())) for t in tables]

    whole, blocks = everything(1 << 20), everything(block)
    assert all(len(w) > 3 for w in whole)
    for w, b in zip(whole, blocks, strict=True):
        assert w == b


def test_one_long_text_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(tok, "BLOCK", 1000)
    docs = spark.createDataFrame([(0, TEXT * 300)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = tok.tokenize(docs).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([t for t in tasks if t["count"] > 1000]) >= 3


def test_pairs_shuffle_the_sequence_once(spark):
    content = spark.createDataFrame([(0, i, f"w{i % 7}") for i in range(100)], "doc_id long, cpos long, lemma string")
    plan = stats.cooccurrence(content)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Window") >= 1
    hits = weave.passages(spark.createDataFrame([(0, i, f"w{i}", f"w{i % 3}", False) for i in range(90)], "doc_id long, i long, surface string, lemma string, stop boolean"), "w0", "w1")
    joins = [line for line in hits._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line and "bucket" in line]
    assert len(joins) == 1
