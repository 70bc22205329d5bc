"""Lexicons from files: JSON maps, and word vectors from a vocabulary and raw parts. A missing file
leaves its engine not ready."""

from __future__ import annotations

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hilandera.operators.tokens import Assets
from hilandera.sources.json_maps import read_bytes, read_map

#: Where each lexicon lies below the assets' folder.
FILES = {
    "pos": "wordnet/pos-lookup-es.json",
    "lemma": "wordnet/lemmatizer-es.json",
    "edges": "wordnet/synsets-es.json",
    "emolex": "lexicons/nrc-emolex-es.json",
    "intensity": "lexicons/nrc-intensity-es.json",
    "vad": "lexicons/nrc-vad-es.json",
    "swn": "lexicons/sentiwordnet-es.json",
    "vocabulary": "vectors/vocab.json",
    "vectors": "vectors/vectors-*.bin",
}

#: Bytes of vectors that are read at a time.
RANGE_BYTES = 8 << 20


def _map(spark: SparkSession, path: str, value: str) -> DataFrame | None:
    """k, v of a JSON object in one file; None if it can't be read."""
    try:
        return read_map(spark, path, value)
    except AnalysisException:
        return None


def load_vectors(spark: SparkSession, vocabulary: str, parts: str) -> DataFrame | None:
    """word, vec from {dim, dtype, vocab: {word: row}} and raw little-endian parts, in the order of
    their names; half precision widens to single.

    The parts are one run of bytes, which is read in ranges of some RANGE_BYTES, each by whichever task gets
    it; a vector may begin in one part and end in the next. Only the parts' names and sizes are on the driver.
    """
    try:
        head = spark.read.text(vocabulary, wholetext=True).select(F.from_json("value", "dim int, dtype string, vocab map<string,bigint>").alias("m"))
        listed = spark.read.format("binaryFile").load(parts).select("path", "length").collect()
    except AnalysisException:
        return None
    meta = head.select("m.dim", "m.dtype").first()
    dtype = np.dtype("<f2" if meta["dtype"] == "float16" else "<f4")
    width, files, at = meta["dim"] * dtype.itemsize, [], 0
    for path, length in sorted((r["path"], r["length"]) for r in listed):
        files.append((path, at, at + length))
        at += length
    rows, step = at // width, max(1, RANGE_BYTES // width)
    starts = spark.range(0, rows, step, numPartitions=max(1, -(-rows // step))).select(F.col("id").alias("first"), F.least(F.col("id") + step, F.lit(rows)).alias("end"))

    def read(frames):
        for f in frames:
            for first, end in zip(f["first"], f["end"], strict=True):
                data = b"".join(read_bytes(path, max(first * width, a) - a, min(end * width, b) - a) for path, a, b in files if a < end * width and b > first * width)
                yield pd.DataFrame({"row": np.arange(first, end), "vec": list(np.frombuffer(data, dtype).reshape(-1, width // dtype.itemsize).astype("<f4"))})

    words = head.select(F.explode("m.vocab").alias("word", "row"))
    return words.join(starts.mapInPandas(read, "row bigint, vec array<float>"), "row").select("word", "vec")


def load_assets(spark: SparkSession, folder: str) -> Assets:
    """Whatever lexicons the folder has."""
    path = {k: f"{folder}/{v}" for k, v in FILES.items()}
    get = lambda k, value: _map(spark, path[k], value)
    use = lambda d, f: None if d is None else f(d)
    relations = "struct<hypernyms:array<string>,hyponyms:array<string>,meronyms:array<string>>"
    split = lambda d: d.select(F.substring_index("k", "#", 1).alias("head"), F.substring_index("k", "#", -1).alias("pos"), "v")
    rels = F.array(*(F.struct(F.lit(r).alias("rel"), F.col(f"v.{r}").alias("to")) for r in ("hypernyms", "hyponyms", "meronyms")))
    return Assets(
        pos=use(get("pos", "string"), lambda d: d.select(F.col("k").alias("word"), F.col("v").alias("pos"))),
        lemma=use(get("lemma", "string"), lambda d: d.select(F.col("k").alias("key"), F.col("v").alias("lemma"))),
        edges=use(get("edges", relations), lambda d: split(d).select("head", "pos", F.explode(rels).alias("x")).select(F.col("head").alias("src"), "pos", "x.rel", F.posexplode("x.to").alias("ord", "dst"))),
        emolex=use(get("emolex", "map<string,int>"), lambda d: d.select(F.col("k").alias("lemma"), F.array_sort(F.map_keys(F.map_filter("v", lambda _, v: v != 0))).alias("emotions"))),
        intensity=use(get("intensity", "string"), lambda d: d.select(F.col("k").alias("lemma"), F.col("v").alias("intensity"))),
        vad=use(get("vad", "struct<v:double,a:double,d:double>"), lambda d: d.select(F.col("k").alias("lemma"), "v.v", "v.a", "v.d")),
        swn=use(get("swn", "string"), lambda d: split(d).select(F.col("head").alias("lemma"), "pos", F.col("v").alias("payload"))),
        vectors=load_vectors(spark, path["vocabulary"], path["vectors"]),
    )


def put(df: DataFrame, folder: str, key: str) -> bool:
    """Keeps a table under a key, in place of what was there; False if it can't be written."""
    try:
        df.write.mode("overwrite").parquet(f"{folder}/{key}")
    except (AnalysisException, Py4JJavaError):
        return False
    return True


def kept(df: DataFrame, folder: str, key: str) -> DataFrame:
    """A table kept under a key that has none yet, read back from there; it fails if it can't be written."""
    df.write.parquet(f"{folder}/{key}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{key}")


def get(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """The table kept under a key; None if there is none."""
    try:
        return spark.read.parquet(f"{folder}/{key}")
    except AnalysisException:
        return None
