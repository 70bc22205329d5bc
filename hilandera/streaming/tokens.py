"""The stateless head of the analysis over a stream of documents: markers out, tokens, tags, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions.text import SPACE, TOKEN, WORD, straight_quotes
from hilandera.operators.tokens import Assets, is_stop, lemmatize, tag
from hilandera.sources.texts import without_segment_markers


def annotate_stream(docs: DataFrame, assets: Assets = Assets()) -> DataFrame:
    """doc_id, pos, surface, lemma, tag, stop, neg of each word of a stream of docs (doc_id, text).

    Lexicons are static tables, so every join is stream with static. Paragraph numbers and all that
    looks at other tokens need a whole document: use the batch operators for them.
    """
    t = without_segment_markers(docs).select("doc_id", F.posexplode(F.regexp_extract_all(straight_quotes("text"), F.lit(TOKEN), F.lit(0))).alias("pos", "surface"))
    t = t.filter(F.substring("surface", 1, 1).rlike(WORD) & ~F.col("surface").rlike(SPACE)).withColumn("low", F.lower("surface"))
    t = t.withColumn("tag", F.lit("n")) if assets.pos is None else tag(t, "low", assets)
    t = lemmatize(t, "low", "tag", assets)
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "surface", "lemma", "tag", is_stop(F.col("lemma"), F.col("low")).alias("stop"), F.col("low").isin(*C.NEGATION).alias("neg"))
