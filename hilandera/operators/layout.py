"""Geometry of a segment view: closed-form column expressions over the word grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions.colour import palette, polarity_colour

# fixed values: the segment minimap's height and margin
BAR_HEIGHT, BAR_MARGIN = 28, 3


@dataclass(frozen=True)
class View:
    """The canvas and the visible segments."""

    width: float = 900.0
    height: float = 540.0
    start: int = 0
    size: int = C.VIEW
    segments: int = C.SEGMENTS
    sort: str = C.SORT

    # fixed values: margins, room for the emotion bars, gap between words
    left, right, top, bottom, bars, gap = 80, 20, 20, 10, 40, 2

    @property
    def columns(self) -> int:
        return max(0, min(self.start + self.size, self.segments) - self.start)

    @property
    def chart_width(self) -> float:
        return self.width - self.left - self.right

    @property
    def chart_height(self) -> float:
        return self.height - self.top - self.bars - self.bottom

    @property
    def node_width(self) -> float:
        return max(4.0, min(self.chart_width / max(1, self.columns) * 0.4, 30.0))

    def x(self, column: Column) -> Column:
        if self.columns == 1:
            return F.lit(self.left + self.chart_width / 2)
        return self.left + column / (self.columns - 1) * self.chart_width


def columns(spark: SparkSession, view: View = View()) -> DataFrame:
    """col, seg, x of each visible segment."""
    c = spark.range(view.columns).select(F.col("id").alias("col"))
    return c.select("col", (F.col("col") + view.start).alias("seg"), view.x(F.col("col")).cast("double").alias("x"))


def columns_of(docs: DataFrame, view: View = View()) -> DataFrame:
    """doc_id, col, seg, x of each visible segment of each document."""
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(view.columns - 1).cast("bigint")) if view.columns else F.array().cast("array<bigint>")
    c = docs.select("doc_id", F.explode(places).alias("col"))
    return c.select("doc_id", "col", (F.col("col") + view.start).alias("seg"), view.x(F.col("col")).cast("double").alias("x"))


def nodes(grid: DataFrame, words: DataFrame, maxima: DataFrame, view: View = View()) -> DataFrame:
    """doc_id, word, rank (from 0), col, seg, x, y, w, h, opacity, is_real of each word in each visible segment."""
    n = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    visible = grid.filter(F.col("seg").between(view.start, view.start + view.columns - 1))
    rows = visible.join(words.select("doc_id", "word", (F.col("rank") - 1).alias("rank")), ["doc_id", "word"]).join(maxima, "doc_id").join(n, "doc_id")
    base = F.greatest(F.lit(10.0), view.chart_height - (F.col("_n") - 1) * view.gap) / F.col("_n")
    tallest = F.greatest(F.lit(2.0), base * 2)
    by_freq, by_rel = F.col("norm_freq") / F.col("max_seg_norm_freq"), F.col("rel") / F.col("max_seg_rel")
    primary, secondary = (by_rel, by_freq) if view.sort == "relevance" else (by_freq, by_rel)
    real = F.col("act") > 0
    height = F.when(real, 1 + primary * (tallest - 1)).otherwise(0.0)
    col = F.col("seg") - view.start
    return rows.select(
        "doc_id", "word", "rank", col.alias("col"), "seg",
        (view.x(col) - view.node_width / 2).alias("x"),
        (view.top + F.col("rank") * (base + view.gap) + (base - height) / 2).alias("y"),
        F.lit(view.node_width).alias("w"), height.alias("h"),
        F.when(real, 0.25 + secondary * 0.75).otherwise(0.0).alias("opacity"), real.alias("is_real"),
    )


def _along() -> Window:
    return Window.partitionBy("doc_id", "word").orderBy("col")


def links(of: DataFrame) -> DataFrame:
    """doc_id, word, src_col, tgt_col: neighbouring columns in which a word is there."""
    return of.withColumn("_next", F.lead("is_real").over(_along())).filter("is_real and _next").select("doc_id", "word", F.col("col").alias("src_col"), (F.col("col") + 1).alias("tgt_col"))


def labels(of: DataFrame) -> DataFrame:
    """doc_id, word, col: where a word's label stands, its first column and each first one after a gap."""
    before = F.coalesce(F.lag("is_real").over(_along()), F.lit(False))
    return of.withColumn("_before", before).filter("is_real and not _before").select("doc_id", "word", "col")


def word_colours(words: DataFrame, mode: str, values: DataFrame | None = None) -> DataFrame:
    """words (doc_id, word, rank from 1) with colour. mode valencia: by polarity (values: doc_id, lemma,
    polarity); rango: by rank; else by cluster (a column of words)."""
    if mode == "valencia":
        v = values.select("doc_id", F.col("lemma").alias("word"), "polarity")
        return words.join(v, ["doc_id", "word"], "left").withColumn("colour", polarity_colour(F.coalesce("polarity", F.lit(0.0))))
    return words.withColumn("colour", palette(F.col("rank") - 1 if mode == "rango" else F.col("cluster")))


def segment_names(bounds: DataFrame) -> DataFrame:
    """bounds (seg, label) with name: the number from 1, with an S before it where a label explains it."""
    number = (F.col("seg") + 1).cast("string")
    return bounds.withColumn("name", F.when(F.col("label").isNotNull(), F.concat(F.lit("S"), number)).otherwise(number))


def link_boxes(of: DataFrame) -> DataFrame:
    """doc_id, word, rank, src_col, left, right, top, bottom: the box between a word's neighbouring nodes."""
    there = F.when(F.col("is_real"), F.struct("x", "y", (F.col("y") + F.col("h")).alias("end")))
    both = of.withColumn("_next", F.lead(there).over(_along())).filter(F.col("is_real") & F.col("_next").isNotNull())
    return both.select(
        "doc_id", "word", "rank", F.col("col").alias("src_col"), (F.col("x") + F.col("w")).alias("left"), F.col("_next.x").alias("right"),
        F.least("y", "_next.y").alias("top"), F.greatest(F.col("y") + F.col("h"), F.col("_next.end")).alias("bottom"),
    )


def hit(of: DataFrame, x: float, y: float) -> DataFrame:
    """The word whose node or link is under a point, the first by rank, in each document."""
    node = of.filter("is_real").select("doc_id", "word", "rank", F.col("x").alias("left"), (F.col("x") + F.col("w")).alias("right"), F.col("y").alias("top"), (F.col("y") + F.col("h")).alias("bottom"))
    boxes = node.unionByName(link_boxes(of).drop("src_col"))
    inside = boxes.filter(F.lit(x).between(F.col("left"), F.col("right")) & F.lit(y).between(F.col("top"), F.col("bottom")))
    return inside.groupBy("doc_id").agg(F.min_by("word", "rank").alias("word"))


def arousal_line(tone: DataFrame, every: DataFrame, segments: int = C.SEGMENTS, width: float = 800.0) -> DataFrame:
    """doc_id, seg, x, y of the minimap's line: arousal over the document's largest, 0 where a segment of
    `every` has none."""
    low, span = BAR_HEIGHT - BAR_MARGIN, BAR_HEIGHT - 2 * BAR_MARGIN
    known = every.join(tone.select("doc_id", "seg", "arousal"), ["doc_id", "seg"], "left").withColumn("arousal", F.coalesce("arousal", F.lit(0.0)))
    most = F.max("arousal").over(Window.partitionBy("doc_id"))
    share = F.col("arousal") / F.when(most > 0, most).otherwise(1.0)
    return known.select("doc_id", "seg", ((F.col("seg") + 0.5) * (width / segments)).alias("x"), (low - share * span).alias("y"))


def window_start(x: Column, width: float, segments: int = C.SEGMENTS, size: int = C.VIEW) -> Column:
    """The first visible segment after a click on the minimap: the one clicked comes to the middle."""
    clicked = F.floor(x / width * segments)
    return F.greatest(F.lit(0), F.least(clicked - size // 2, F.lit(max(0, segments - size)))).cast("bigint")


@dataclass(frozen=True)
class Layout:
    """A window's columns, nodes with their colours, links and labels."""

    columns: DataFrame
    nodes: DataFrame
    links: DataFrame
    labels: DataFrame


def windowed(grid: DataFrame, words: DataFrame, maxima: DataFrame, view: View = View(), mode: str = "rango", values: DataFrame | None = None) -> Layout:
    """The layout of the segments that a view shows; mode and values: see word_colours."""
    of = nodes(grid, words, maxima, view)
    coloured = of.join(word_colours(words, mode, values).select("doc_id", "word", "colour"), ["doc_id", "word"])
    return Layout(columns(grid.sparkSession, view), coloured, links(of), labels(of))


def emotion_bars(emotions: DataFrame) -> DataFrame:
    """doc_id, seg, emotion, share, height: each share over the document's largest."""
    pairs = ", ".join(f"'{e}', {e}" for e in C.SEGMENT_EMOTIONS)
    long = emotions.select("doc_id", "seg", F.expr(f"stack({len(C.SEGMENT_EMOTIONS)}, {pairs}) as (emotion, share)"))
    most = F.max("share").over(Window.partitionBy("doc_id"))
    return long.withColumn("height", F.when(most > 0, F.col("share") / most).otherwise(0.0))


def reader_marks(words: DataFrame) -> DataFrame:
    """words (doc_id, freq, rel, polarity, arousal, comm, stop) with the reader's marks of content words:
    brightness, bold, border width, tint."""
    doc = Window.partitionBy("doc_id")
    content = ~F.col("stop")
    strength = F.least(F.lit(1.0), F.abs("arousal") * 2)
    top = lambda c: F.greatest(F.max(c).over(doc).cast("double"), F.lit(1e-300))
    return words.withColumns(
        {
            "brightness": F.when(content, 0.3 + 0.7 * F.col("freq") / top("freq")),
            "bold": F.when(content, F.col("rel") / top("rel") > 0.3),
            "border": F.when(content & (F.abs("arousal") > 0.01), 1 + strength * 2),
            "tint": F.when(content & (F.col("comm") >= 0), palette(F.col("comm"))),
            "ink": F.when(content & F.col("polarity").isNotNull(), polarity_colour(F.col("polarity"))),
        }
    )
