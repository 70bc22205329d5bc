"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled text. A text is compressed in
blocks of 4 KiB with either one; the normalised difference of the two sizes, and how far the text
compresses at all, give a score through logistic regression, calibrated on labelled rows that the
dictionaries have not seen and weighted by how frequent each label is. (What repeats itself compresses
to nothing with either dictionary, so there the difference alone says little.)

Only labelled rows of the training folds are learnt from, SAMPLE_ROWS for each label at most, chosen
by a hash of doc_id; of each the whole text. Half of them give the dictionaries: these texts go to the
driver, SAMPLE_BYTES for each label at most (in the order of the hash; a longer text is passed over).
The other half calibrate: their sizes are taken on the executors, and a row of five numbers goes to
the driver. Scoring reads whole texts, row by row, without a shuffle.

Defined cases: a null text is scored as the empty text, an empty text gets the calibrated score of
zero features; labels that are null are not learnt from; without labels of both kinds the score is
the share of label 1 (0.5 without any label); repeated rows are scored alike; other columns are kept,
and `score` gets a trailing underscore where the table has such a column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hilandera.llm.common import free_name, stored

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 16 << 20
BLOCK_BYTES = 4096
DICTIONARY_BYTES = 112_640
LEVEL = 3
FOLDS = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    trained: tuple[bool, bool]
    weights: tuple[float, ...]
    prior: float


def fold(key: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


class Sizes:
    """Compressed sizes of a text by the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, trained: tuple[bool, bool]):
        import zstandard as z

        kind = lambda t: z.DICT_TYPE_FULLDICT if t else z.DICT_TYPE_RAWCONTENT
        self.by = []
        for data, t in zip((good, bad), trained, strict=True):
            d = z.ZstdCompressionDict(data, dict_type=kind(t))
            d.precompute_compress(level=LEVEL)
            self.by.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str) -> list[float]:
        """1, normalised difference, log of the compressed share with each dictionary, log of the length."""
        data = text.encode()
        if not data:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        good, bad = (sum(len(c.compress(x)) for x in blocks(data)) for c in self.by)
        n = len(data)
        return [1.0, 10 * (bad - good) / (bad + good), float(np.log((good + 8) / (n + 8))), float(np.log((bad + 8) / (n + 8))), float(np.log(n))]


def _dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), True
    except z.ZstdError:
        return b"\n".join(samples)[:DICTIONARY_BYTES] or b" " * 8, False


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first feature is the constant."""
    b, penalty = np.zeros(x.shape[1]), np.r_[1e-3, np.full(x.shape[1] - 1, ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model, from labelled rows outside the held-out fold."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold("key") != 0)).groupBy("key").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n = sum(counts.values())
    prior = counts.get(1, 0) / n if n else 0.5
    if len(counts) < 2:
        return Model(b"", b"", (False, False), (), prior)
    at = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1_000_000))
    share = F.when(F.col("label") == 1, F.lit(sample_rows / counts[1])).otherwise(F.lit(sample_rows / counts[0]))
    known = known.withColumn("at", at).filter(F.col("at") < share * 900_000)
    # whole texts of some 0.9 * SAMPLE_ROWS rows for each label, whatever the tables' sizes
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), "key")
    rows = stored(rows.groupBy("key", "label").agg(F.min("text").alias("text")).withColumn("h", F.xxhash64(F.lit(7), "key")), "labelled")
    before = Window.partitionBy("label").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    some = rows.filter((F.pmod("h", F.lit(2)) == 0) & (F.octet_length("text") <= SAMPLE_BYTES))
    some = some.filter("text <> ''").withColumn("upto", F.sum(F.octet_length("text")).over(before)).filter(F.col("upto") <= SAMPLE_BYTES)
    texts = sorted((r["label"], r["h"], r["key"], r["text"].encode()) for r in some.drop("upto").collect())
    (good, g), (bad, b) = (_dictionary([block for y, _, _, t in texts if y == k for block in blocks(t)]) for k in (1, 0))
    held = Model(good, bad, (g, b), (), prior)

    def measure(batches):
        sizes = Sizes(held.good, held.bad, held.trained)
        for x in batches:
            found = [sizes.features(t) for t in x.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column("label"), pa.array(found, pa.list_(pa.float64()))], ["label", "x"])

    rest = rows.filter(F.pmod("h", F.lit(2)) == 1).orderBy("h", "key").select("label", "text").mapInArrow(measure, "label int, x array<double>").collect()
    y = np.array([r["label"] for r in rest])
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", (False, False), (), prior)
    w = np.where(y == 1, prior / (y == 1).mean(), (1 - prior) / (y == 0).mean())
    return Model(good, bad, (g, b), tuple(map(float, _logistic(np.array([r["x"] for r in rest]), y, w))), prior)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score`, 0 to 1: how likely the text is good."""
    out = free_name(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def each(batches):
        sizes = Sizes(model.good, model.bad, model.trained) if model.weights else None
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            if sizes:
                x = np.array([sizes.features(t or "") for t in texts]).reshape(len(texts), -1)
                p = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30))) if texts else np.empty(0)
            else:
                p = np.full(len(texts), model.prior)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(each, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: whether it was held out, its score and the prediction."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
