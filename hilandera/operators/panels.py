"""What the panels show: words in three orders, seeds as entered, chosen documents, sentiment of the top words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hilandera.operators.tokens import Assets, add_sentiment, tag

#: Documents that can be compared at a time.
MOST_DOCUMENTS = 3
#: Order of a panel -> columns that come before the word, largest first.
ORDERS = {"alpha": (), "relevance": ("rel", "freq"), "freq": ("freq", "rel")}


def word_panel(words: DataFrame, sort: str = "freq", out: str = "place") -> DataFrame:
    """words (doc_id, word, freq, rel) with their place in the panel; ties go by the word in Spanish
    collation, then by code points."""
    order = Window.partitionBy("doc_id").orderBy(*map(F.desc, ORDERS[sort]), F.collate("word", "es"), "word")
    return words.withColumn(out, F.row_number().over(order).cast("bigint"))


def enter_seeds(entries: DataFrame, freqs: DataFrame) -> DataFrame:
    """doc_id, ord, word: entries (ord, entry) without the spaces around them, in lower case, as far as
    they are words of the document; of equal ones the first."""
    seeds = entries.select("ord", F.lower(F.trim("entry")).alias("word")).groupBy("word").agg(F.min("ord").alias("ord"))
    return freqs.select("doc_id", F.col("lemma").alias("word")).join(seeds, "word").select("doc_id", "ord", "word")


def toggled(chosen: DataFrame, key: str, value, most: int | None = None) -> DataFrame:
    """chosen (ord, key) without the value if it is there; else with it behind the others, if fewer than
    `most` are chosen."""
    has = F.max(F.col(key).eqNullSafe(F.lit(value))).alias("has")
    state = chosen.agg(has, F.count(F.lit(1)).alias("n"), (F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord"))
    room = ~F.coalesce("has", F.lit(False)) & (F.col("n") < most if most else F.lit(True))
    types = dict(chosen.dtypes)
    new = state.filter(room).select(F.col("ord").cast(types["ord"]).alias("ord"), F.lit(value).cast(types[key]).alias(key))
    return chosen.filter(~F.col(key).eqNullSafe(F.lit(value))).unionByName(new, allowMissingColumns=True)


def top_sentiments(top: DataFrame, assets: Assets) -> DataFrame:
    """doc_id, lemma, tag, polarity, arousal of each document's top words, which are tagged anew as words."""
    return add_sentiment(tag(top.select("doc_id", "lemma"), "lemma", assets), assets).select("doc_id", "lemma", "tag", "polarity", "arousal")
