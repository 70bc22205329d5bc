"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and BPE, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents:

1. quality rules: documents that the current policy rejects go;
2. near-dedup by five-word shingles: SimHash components and pairs of similarity 0.8 or more; of each
   component the document of the smallest doc_id stays;
3. secret scans: secrets are replaced by [SECRET], and n_chars follows the text;
4. mixing: a row for each copy that the mix takes of a document, in the order of shards and draws;
5. BPE: the ids of each row's text and the text that they decode to, as digests, and the ids.

Defined cases: a null or empty text has no words, so stage 1 drops it; a null doc_id is kept by stage 2
and one document to the others; rows that share a doc_id go through stage 1 one by one, and one of them
leaves stage 2; texts of any length are taken whole; a null source is a source; an empty table gives no
rows; other columns than those of documents are carried to stage 4, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hilandera.llm import bpe, mixing, near_copies, quality_rules, secret_scan
from hilandera.llm.common import new_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(docs)
    text = secret_scan.redacted(F.col("text"), F.col("spans"))
    changed = {"text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*(changed[c].alias(c) if c in changed else c for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs.select("doc_id", "source", "text"), keep=["doc_id", "source"]).select(
        "doc_id",
        "source",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("secrets", secrets), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := new_folder(spark, "pipeline"))
            docs = spark.read.parquet(path)
    return docs


#: Fingerprint components, word counts of a library and its token ids cannot be put in SQL.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
