"""The analysis as a whole: stage 1 from texts, stage 2 over it, and the segment view over both."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions.lineage import cut
from hilandera.operators import graph, segments, stats, vectors
from hilandera.operators import tokens as tok
from hilandera.operators.tokens import Assets
from hilandera.sources import assets as tables
from hilandera.sources.texts import without_segment_markers


@dataclass(frozen=True)
class Params:
    top_n: int = C.TOP_N
    depth: int = C.DEPTH
    decay: float = C.DECAY
    flow: str = C.FLOW
    segments: int = C.SEGMENTS
    mode: str = C.MODE
    sort: str = C.SORT
    ngram: int = C.NGRAM

    def clamped(self) -> Params:
        """The nearest parameters within the supported ranges."""
        hold = lambda x, low, high: min(high, max(low, x))
        return Params(hold(self.top_n, 10, 100), hold(self.depth, 1, 3), hold(self.decay, 0.1, 0.9), self.flow, hold(self.segments, 3, 50), self.mode, self.sort, self.ngram)


@dataclass(frozen=True)
class Stage1:
    """Of each document: its annotated tokens, content, frequencies, top words and what hangs on them.
    persist() lets another stage 2 (other depth, decay or flow) start from here."""

    annotated: DataFrame
    content: DataFrame
    freqs: DataFrame
    top: DataFrame
    pairs: DataFrame
    communities: DataFrame
    bigrams: DataFrame
    trigrams: DataFrame
    totals: DataFrame

    def held(self) -> Stage1:
        """The same, with the tables kept that all others are made from."""
        for d in (self.annotated, self.freqs):
            d.persist()
        return self

    def persist(self) -> Stage1:
        # a few rows a document: later plans hold them without what they were made from
        return replace(self.held(), communities=cut(self.communities))


@dataclass(frozen=True)
class Stage2:
    relevance: DataFrame
    enriched: DataFrame
    view: DataFrame

    def persist(self) -> Stage2:
        self.enriched.persist()
        return self


def totals(annotated: DataFrame) -> DataFrame:
    """doc_id, words (all of them), content (those that are no stop words)."""
    return annotated.filter("type = 'w'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.sum((~F.col("stop")).cast("bigint")).alias("content"))


def stage1(docs: DataFrame, assets: Assets = Assets(), top_n: int = C.TOP_N) -> Stage1:
    """docs: doc_id, text. Blank documents give no rows."""
    annotated = tok.by_document(tok.annotate(tok.tokenize(without_segment_markers(docs)), assets))
    content = tok.content(annotated)
    freqs = stats.frequencies(content)
    top = stats.top(freqs, top_n)
    pairs = stats.cooccurrence(content, top)
    return Stage1(annotated, content, freqs, top, pairs, stats.communities(top, pairs), stats.top_ngrams(content, 2, top_n), stats.top_ngrams(content, 3, top_n), totals(annotated))


def stage2(first: Stage1, assets: Assets, depth: int = C.DEPTH, decay: float = C.DECAY, flow: str = C.FLOW, relevance: DataFrame | None = None) -> Stage2:
    """relevance: that of these parameters, where it is there already."""
    relevance = cut(graph.spread_activation(first.freqs, assets, depth, decay, flow)) if relevance is None else relevance
    enriched = tok.enrich(first.annotated, first.freqs, relevance, first.communities, assets)
    return Stage2(relevance, enriched, tok.weave_view(first.annotated))


def analyze(docs: DataFrame, assets: Assets = Assets(), params: Params = Params()) -> tuple[Stage1, Stage2]:
    """Both stages, kept: another stage 2 can start from the first, views and sinks from the second."""
    p = params.clamped()
    first = stage1(docs, assets, p.top_n).persist()
    return first, stage2(first, assets, p.depth, p.decay, p.flow).persist()


class Stage1Store:
    """Stage 1 by text: a folder that keeps what was analysed, under the digest of each text.

    refresh() analyses the texts that the folder does not have, each distinct one once, and keeps them as a
    run of its own; the run's digests are listed last, so a run that fails leaves nothing behind that is
    read. Results depend on the text, the lexicons and top_n alone: a folder is for one choice of these.
    """

    def __init__(self, spark: SparkSession, folder: str, assets: Assets = Assets(), top_n: int = C.TOP_N):
        self.spark, self.folder, self.assets, self.top_n = spark, folder, assets, top_n

    def known(self) -> DataFrame:
        """digest, run: where each text's results are; of runs that met the first by name counts."""
        none = self.spark.createDataFrame([], "digest string, run string")
        listed = tables.get(self.spark, self.folder, "runs")
        return none if listed is None else listed.groupBy("digest").agg(F.min("run").alias("run"))

    def refresh(self, docs: DataFrame) -> tuple[Stage1, DataFrame]:
        """(stage 1 of docs (doc_id, text), the digests of the texts that were analysed for it)."""
        keyed = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
        run = uuid.uuid4().hex
        texts = keyed.select("digest", "text").dropDuplicates(["digest"]).join(self.known(), "digest", "left_anti")
        new = tables.kept(texts.select(F.col("digest").alias("doc_id"), "text"), self.folder, f"{run}/texts")
        if not new.isEmpty():
            part = stage1(new, self.assets, self.top_n)
            for f in fields(Stage1):
                tables.kept(getattr(part, f.name), self.folder, f"{run}/{f.name}")
            new.select(F.col("doc_id").alias("digest"), F.lit(run).alias("run")).write.mode("append").parquet(f"{self.folder}/runs")
        at = keyed.select("doc_id", "digest").join(self.known(), "digest")
        return Stage1(**{f.name: self._of(at, f.name) for f in fields(Stage1)}), new.select(F.col("doc_id").alias("digest"))

    def _of(self, at: DataFrame, name: str) -> DataFrame:
        """The rows of docs in one of the tables."""
        path = F.regexp_extract(F.col("_metadata.file_path"), "/([0-9a-f]{32})/[^/]+/[^/]+$", 1)
        every = self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/*/{name}")
        rows = every.select(F.col("doc_id").alias("digest"), path.alias("run"), *(c for c in every.columns if c != "doc_id"))
        return at.join(rows, ["digest", "run"]).select("doc_id", *(c for c in every.columns if c != "doc_id"))


@dataclass(frozen=True)
class SegmentView:
    segmented: DataFrame
    words: DataFrame
    grid: DataFrame
    emotions: DataFrame
    tone: DataFrame
    maxima: DataFrame


def segment_view(enriched: DataFrame, freqs: DataFrame, relevance: DataFrame, assets: Assets, params: Params = Params(), seeds: DataFrame | None = None, bounds: DataFrame | None = None) -> SegmentView:
    """Segments, selected words, their grid and clusters, emotions and tone."""
    placed, words, grid = segment_words(tok.content(enriched.withColumn("type", F.lit("w"))), freqs, relevance, assets, params, seeds, bounds)
    return SegmentView(placed, words, grid, segments.segment_emotions(placed), segments.segment_tone(placed), segments.grid_maxima(grid, words))


def segment_words(content: DataFrame, freqs: DataFrame, relevance: DataFrame, assets: Assets, params: Params = Params(), seeds: DataFrame | None = None, bounds: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(content in segments, selected words, their grid). What lexicons say of the tone of words is not read for these:
    the content words of stage 1 do."""
    if bounds is None:
        placed, every = segments.equal_segments(content, params.segments), segments.all_segments(freqs, params.segments)
    else:
        placed, every = segments.custom_segments(content, bounds), bounds.select("doc_id", "seg")
    counts = segments.segment_counts(placed, params.ngram).persist()
    single = params.ngram == 1
    totals = freqs.select("doc_id", F.col("lemma").alias("word"), "freq") if single else segments.total_counts(counts)
    if params.mode in ("seeds", "semillas") and seeds is not None:
        words = stats.select_seeds(totals, seeds).withColumn("rel", F.lit(1.0))
        if single:
            words = words.drop("rel").join(relevance.select("doc_id", F.col("lemma").alias("word"), "rel"), ["doc_id", "word"], "left").withColumn("rel", F.coalesce("rel", F.lit(1.0)))
    else:
        most = (1 << 31) - 1 if params.mode == "persistentes" else params.top_n
        words = stats.select_words(totals, relevance if single else None, params.sort, most, params.ngram)
        if params.mode == "persistentes":
            words = segments.persistent(words, counts, params.top_n)
    words = cut(words)
    grid = segments.word_grid(words, every, counts, relevance if single else None, assets.vectors if single else None, params.decay).persist()
    if single:
        words = words.join(vectors.clusters(words, assets.vectors).select("doc_id", "word", "cluster"), ["doc_id", "word"])
    return placed, words, grid
