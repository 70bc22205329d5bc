"""Small lexicons made by rule from a vocabulary, for queries and tests: real ones are licensed and not at hand.

The md5 digest of a word decides what a lexicon says of it, so that any SQL engine can repeat it.
Nothing in them is linguistic knowledge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.operators.tokens import Assets, tag


def number(word: Column, at: int, digits: int = 1) -> Column:
    """So many hexadecimal digits of the word's md5, from place `at`."""
    return F.conv(F.substring(F.md5(word), at, digits), 16, 10).cast("bigint")


def _letter(n: Column) -> Column:
    return F.substring(F.lit("nvar"), (n % 4 + 1).cast("int"), F.lit(1))


def words_and_lemmas(words: DataFrame) -> Assets:
    """Parts of speech for half of the words (word), lemmas for those in -s and -ó."""
    w = F.col("word")
    pos = words.filter(number(w, 1) < 8).select("word", _letter(number(w, 1)).alias("pos"))
    plural = words.filter(w.endswith("s") & (F.length(w) > 3)).select(w.alias("key"), F.expr("substring(word, 1, length(word) - 1)").alias("lemma"))
    past = words.filter(w.endswith("ó") & (F.length(w) > 2)).select(F.concat(w, F.lit("#v")).alias("key"), F.expr("concat(substring(word, 1, length(word) - 1), 'ar')").alias("lemma"))
    return Assets(pos=pos, lemma=plural.unionByName(past))


def with_lemma_lexicons(assets: Assets, lemmas: DataFrame) -> Assets:
    """assets with the lexicons of lemmas (lemma): emotions, tone, payloads, vectors and edges."""
    w = F.col("lemma")
    vad = lemmas.filter(number(w, 2) < 12).select("lemma", *((number(w, at, 4) / 65535).alias(k) for k, at in (("v", 3), ("a", 7), ("d", 11))))
    emotions = F.array_compact(F.array(*(F.when(number(w, 20 + i) < 3, F.lit(e)) for i, e in enumerate(C.EMOTIONS))))
    emolex = lemmas.select("lemma", emotions.alias("emotions")).filter(F.size("emotions") > 0)
    intensity = lemmas.filter(number(w, 15) < 4).select("lemma", (number(w, 16, 2) / 255).alias("intensity"))
    two = lemmas.filter(number(w, 3) < 8).select("lemma", F.explode(F.array(_letter(number(w, 3)), _letter(number(w, 3) + 1))).alias("pos"))
    swn = two.withColumn("payload", F.concat_ws(":", "pos", F.substring(F.md5("lemma"), 1, 4)))
    vectors = lemmas.select(w.alias("word"), F.array(*((number(w, 1 + 2 * i, 2) / 255 - 0.5).cast("float") for i in range(4))).alias("vec"))
    parts = assets.__dict__ | {"vad": vad, "emolex": emolex, "intensity": intensity, "swn": swn, "vectors": vectors}
    return Assets(**parts | {"edges": _edges(lemmas, assets)})


def _edges(lemmas: DataFrame, assets: Assets) -> DataFrame:
    """A word's hypernym is the word without its first two letters, its meronym the one without its last
    two, if they are words too; hyponyms are hypernyms reversed."""
    long = lemmas.filter(F.length("lemma") >= 5)
    up = long.select(F.col("lemma").alias("src"), F.expr("substring(lemma, 3)").alias("dst"), F.lit("hypernyms").alias("rel"))
    part = long.select(F.col("lemma").alias("src"), F.expr("substring(lemma, 1, length(lemma) - 2)").alias("dst"), F.lit("meronyms").alias("rel"))
    known = lemmas.select(F.col("lemma").alias("dst"))
    up, part = up.join(known, "dst", "left_semi"), part.join(known, "dst", "left_semi")
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("hyponyms").alias("rel"))
    edges = up.unionByName(down).unionByName(part)
    order = F.row_number().over(Window.partitionBy("src", "rel").orderBy("dst")) - 1
    return tag(edges.withColumn("ord", order), "src", assets, "pos").select("src", "pos", "rel", "ord", "dst")
