"""What the reader shows beside the text: its minimap, a word's details, and which words are lit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions.colour import polarity_colour
from hilandera.functions.text import fixed
from hilandera.operators.panels import MOST_DOCUMENTS

# --- fixed values -----------------------------------------------------------------------------

#: Pixels of the minimap: its width, its least height, the step between emotions, room at the right.
WIDTH, LEAST_HEIGHT, STEP, MARGIN = 80, 100, 4, 2
#: Share of the width where the emotions begin.
EMOTIONS_AT = 0.7
#: Least height of a document in a stack.
STACK_HEIGHT = 300
EMOTION_COLOURS = {
    "anger": "#ff6b6b",
    "anticipation": "#f7dc6f",
    "disgust": "#bb8fce",
    "fear": "#85c1e9",
    "joy": "#82e0aa",
    "sadness": "#45b7d1",
    "surprise": "#f0b27a",
    "trust": "#4ecdc4",
}
FREQUENCY, RELEVANCE, POLARITY, AROUSAL, COMMUNITY = "Frec: ", " · Rel: ", " · Pol: ", " · Act: ", "Comunidad "

# --- end of fixed values ----------------------------------------------------------------------


def known_emotions() -> Column:
    """The word's emotions in their fixed order."""
    return F.filter(F.array(*map(F.lit, C.EMOTIONS)), lambda e: F.coalesce(F.array_contains("emotions", e), F.lit(False)))


def most_dots(width: int = WIDTH) -> int:
    """Emotions that a row of the minimap has room for, one at least."""
    n = 1
    while width * EMOTIONS_AT + STEP * n <= width - MARGIN:
        n += 1
    return n


def minimap(words: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, pos, y, height, strength, ink, ink_strength, dots of each content word, from the top.

    words: doc_id, pos, stop, freq, polarity, emotions. ink is null without a polarity; dots are the
    colours of the first emotions that there is room for.
    """
    doc = Window.partitionBy("doc_id")
    n, tallest = F.count(F.lit(1)).over(doc), F.max("freq").over(doc)
    tall = F.greatest(F.lit(LEAST_HEIGHT), n)
    place = F.row_number().over(doc.orderBy("pos")) - 1
    colours = F.create_map(*(F.lit(x) for pair in EMOTION_COLOURS.items() for x in pair))
    known = F.col("polarity").isNotNull()
    return words.filter("not stop").select(
        "doc_id", "pos",
        (place / n * tall).alias("y"),
        F.greatest(F.lit(1.0), tall / n).alias("height"),
        (0.2 + F.when(tallest > 0, F.col("freq") / tallest).otherwise(0.0) * 0.8).alias("strength"),
        F.when(known, polarity_colour(F.col("polarity"))).alias("ink"),
        F.when(known, F.least(F.lit(1.0), F.abs("polarity") * 2 + 0.1)).alias("ink_strength"),
        F.transform(F.slice(known_emotions(), 1, most_dots(width)), lambda e: colours[e]).alias("dots"),
    )


def details(words: DataFrame) -> DataFrame:
    """doc_id, pos, title, line, community, emotions: what a content word's tooltip says; community is
    null for words without one."""
    one, three = fixed(1), fixed(3)
    signed = F.concat(F.when(F.col("polarity") > 0, "+").otherwise(""), three("polarity"))
    line = F.concat(
        F.lit(FREQUENCY), F.col("freq").cast("string"), F.lit(RELEVANCE), one(F.coalesce(F.col("rel").cast("double"), F.lit(0.0))),
        F.coalesce(F.concat(F.lit(POLARITY), signed), F.lit("")), F.coalesce(F.concat(F.lit(AROUSAL), three("arousal")), F.lit("")),
    )
    return words.filter("not stop").select(
        "doc_id", "pos",
        F.concat("surface", F.lit(" "), "lemma", F.lit(" · "), "tag").alias("title"), line.alias("line"),
        F.when(F.col("comm") >= 0, F.concat(F.lit(COMMUNITY), F.col("comm").cast("string"))).alias("community"),
        F.array_join(known_emotions(), ",").alias("emotions"),
    )


def lit(words: DataFrame, hovered: str | None = None, locked: Sequence[str] = (), seeds: Sequence[str] = ()) -> DataFrame:
    """words (word) with `lit`: true for the hovered word, locked ones and seeds; for all words if none
    is hovered or locked."""
    if hovered is None and not locked:
        return words.withColumn("lit", F.lit(True))
    return words.withColumn("lit", F.col("word").isin(*{*([] if hovered is None else [hovered]), *locked, *seeds}))


def stacked(chosen: Sequence, height: int, mode: str = "stack") -> list[tuple]:
    """(document, height) of the chosen documents, three at most, that a view shows: each of them in a
    stack, else the first."""
    shown = list(chosen)[:MOST_DOCUMENTS]
    if len(shown) < 2 or mode != "stack":
        return [(d, height) for d in shown[:1]]
    return [(d, max(STACK_HEIGHT, height // len(shown))) for d in shown]
