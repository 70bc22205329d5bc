"""Segments of content sequences: equal or custom cuts, counts inside, emotions, tone, the word grid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions.scans import carried, taken_over
from hilandera.operators.stats import ngrams
from hilandera.operators.vectors import forms, listed

#: Content words that share a bucket of bounds, and parts whose sizes are summed in one block.
BUCKET, PARTS = 64, 4096
#: Pairs of words that are compared at a time.
PAIRS = 1 << 18


def equal_segments(content: DataFrame, n: int = C.SEGMENTS) -> DataFrame:
    """content with seg, 0 to n-1: equal sizes, the last one takes the remainder."""
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    size = F.greatest(F.floor(total / n), F.lit(1))
    return content.withColumn("seg", F.least(F.floor(F.col("cpos") / size), F.lit(n - 1)).cast("bigint"))


def custom_segments(content: DataFrame, bounds: DataFrame) -> DataFrame:
    """content with seg and label, from bounds (doc_id, seg, label, start_token, end_token; the end excluded).

    Bounds are dealt to the buckets of BUCKET places that they touch, so a word meets the few of its own
    bucket. Bounds may overlap: a word is in each of its segments.
    """
    first, last = (F.floor(c / BUCKET).cast("bigint") for c in (F.col("start_token"), F.col("end_token") - 1))
    dealt = bounds.filter("end_token > start_token").withColumn("_bucket", F.explode(F.sequence(first, last)))
    inside = (F.col("cpos") >= F.col("start_token")) & (F.col("cpos") < F.col("end_token"))
    return content.withColumn("_bucket", F.floor(F.col("cpos") / BUCKET).cast("bigint")).join(dealt, ["doc_id", "_bucket"]).filter(inside).drop("start_token", "end_token", "_bucket")


def bounds_of(parts: DataFrame, content: DataFrame) -> DataFrame:
    """Bounds for custom_segments from parts (doc_id, part, label) of texts that were cut at markers and
    the content (doc_id, part, ...) of each: running sums of the parts' content words, in blocks of parts."""
    n = content.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n"))
    sized = parts.select("doc_id", "part", "label").join(n, ["doc_id", "part"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sized = sized.withColumn("_block", F.floor(F.col("part") / PARTS).cast("bigint"))
    before = carried(sized.groupBy("doc_id", "_block").agg(F.sum("n").alias("_base")), ["doc_id"], "_block", {"_base": "sum"})
    own = F.sum("n").over(Window.partitionBy("doc_id", "_block").orderBy("part"))
    whole = taken_over(sized.withColumn("end_token", own), before, ["doc_id", "_block"]).withColumn("end_token", F.col("end_token") + F.col("_base"))
    return whole.select("doc_id", F.col("part").alias("seg"), "label", (F.col("end_token") - F.col("n")).alias("start_token"), "end_token")


def all_segments(docs: DataFrame, n: int = C.SEGMENTS) -> DataFrame:
    """doc_id, seg for every segment, empty ones included."""
    return docs.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("seg"))


def segment_counts(segmented: DataFrame, n: int = 1) -> DataFrame:
    """doc_id, seg, word, freq, norm_freq: n-grams inside segments, and their share of the segment's n-grams."""
    if n == 1:
        items = segmented.select("doc_id", "seg", F.col("lemma").alias("word"))
    else:
        items = ngrams(segmented, n, ("doc_id", "seg")).select("doc_id", "seg", F.col("gram").alias("word"))
    counts = items.groupBy("doc_id", "seg", "word").agg(F.count(F.lit(1)).alias("freq"))
    return counts.withColumn("norm_freq", F.col("freq") / F.sum("freq").over(Window.partitionBy("doc_id", "seg")))


def total_counts(counts: DataFrame) -> DataFrame:
    """doc_id, word, freq over all segments."""
    return counts.groupBy("doc_id", "word").agg(F.sum("freq").alias("freq"))


def persistent(ranked_words: DataFrame, counts: DataFrame, top_n: int = C.TOP_N) -> DataFrame:
    """The words (doc_id, word, rank) that occur in two segments or more, re-ranked, the first top_n."""
    in_segments = counts.groupBy("doc_id", "word").agg(F.count_distinct("seg").alias("_n")).filter("_n >= 2").drop("_n")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank")).cast("bigint")
    return ranked_words.join(in_segments, ["doc_id", "word"]).withColumn("rank", rank).filter(F.col("rank") <= top_n)


def segment_emotions(segmented: DataFrame) -> DataFrame:
    """doc_id, seg and, for each of four emotions, the share of content words that carry it."""
    share = lambda e: F.avg(F.coalesce(F.array_contains("emotions", e), F.lit(False)).cast("double")).alias(e)
    return segmented.groupBy("doc_id", "seg").agg(*map(share, C.SEGMENT_EMOTIONS))


def segment_tone(segmented: DataFrame) -> DataFrame:
    """doc_id, seg, polarity, arousal: means over known values, 0 if there are none."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return segmented.groupBy("doc_id", "seg").agg(mean("polarity"), mean("arousal"))


def word_grid(words: DataFrame, segments: DataFrame, counts: DataFrame, relevance: DataFrame | None = None, vectors: DataFrame | None = None, decay: float = C.DECAY, least: float = 0.4) -> DataFrame:
    """doc_id, seg, word, freq, norm_freq, rel, act for every segment and selected word.

    A word that a segment lacks borrows from the alike lemma there (similarity over `least`) with the
    largest sim * freq * decay. Words are the few selected ones, each with its segments, so the grid
    has words * segments rows a document. Pass relevance and vectors for single words only.
    """
    grid = words.select("doc_id", "word").join(segments, "doc_id").join(counts, ["doc_id", "seg", "word"], "left")
    grid = grid.withColumns({"freq": F.coalesce(F.col("freq").cast("double"), F.lit(0.0)), "norm_freq": F.coalesce("norm_freq", F.lit(0.0))})
    if vectors is not None:
        grid = grid.join(loans(words, counts, vectors, decay, least), ["doc_id", "seg", "word"], "left")
        lacks = F.col("freq") == 0
        grid = grid.withColumns({"norm_freq": F.when(lacks, F.coalesce("norm_boost", F.lit(0.0))).otherwise(F.col("norm_freq")), "freq": F.when(lacks, F.coalesce("boost", F.lit(0.0))).otherwise(F.col("freq"))})
    if relevance is not None:
        grid = grid.join(relevance.select("doc_id", F.col("lemma").alias("word"), F.col("rel").alias("_rel")), ["doc_id", "word"], "left")
        known = F.when(F.col("_rel") != 0, F.col("_rel")).otherwise(F.lit(1.0))
    else:
        known = F.lit(1.0)
    return grid.select("doc_id", "seg", "word", "freq", "norm_freq", F.when(F.col("freq") > 0, known * F.col("norm_freq")).otherwise(0.0).alias("rel"), F.col("freq").alias("act"))


def loans(words: DataFrame, counts: DataFrame, vectors: DataFrame, decay: float = C.DECAY, least: float = 0.4) -> DataFrame:
    """doc_id, seg, word, boost, norm_boost: the largest sim * freq * decay that the lemmas of a segment lend a
    selected word, and sim * norm_freq * decay of the lemma that lends it.

    A document's words, each with its segments, meet the selected ones there: pairs are never shuffled, nor
    rows, and two words are compared once for all segments, in matrices of PAIRS at most. Sums go component
    by component, in order.
    """
    form = lambda name: forms(vectors, name).select(F.col(name).alias("word"), F.col(f"{name}_vec").alias("vec"), F.col(f"{name}_norm").alias("norm"))
    place = F.struct("seg", F.col("freq").cast("double").alias("freq"), F.col("norm_freq").cast("double").alias("share"))
    lent = counts.groupBy("doc_id", "word").agg(F.collect_list(place).alias("places")).join(form("b"), "word")
    asking = words.select("doc_id", "word").join(form("a"), "word")
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}

    def each(rows: pa.Table) -> pa.Table:
        asks, (vec, size), norm = rows.column("places").is_null().to_numpy(), listed(rows.column("vec")), rows.column("norm").to_numpy()
        owner = np.repeat(np.arange(len(asks)), pc.fill_null(pc.list_value_length(rows.column("places")), 0).to_numpy())
        names, freq, share = (pc.struct_field(pc.list_flatten(rows.column("places")), k) for k in range(3))
        _, first, seg = np.unique(names.to_numpy(), return_index=True, return_inverse=True)
        freq, share, found = freq.to_numpy(), share.to_numpy(), []
        # a word asks once
        asked = list(dict(zip(rows.column("word").filter(pa.array(asks)).to_pylist(), np.flatnonzero(asks).tolist(), strict=True)).values())
        for length in np.unique(size[asked]) if asked else ():
            a = np.array([i for i in asked if size[i] == length])
            others, every = np.flatnonzero(~asks & (size == length)), np.arange(len(a))
            best, to = np.full((len(first), len(a)), -np.inf), np.zeros((len(first), len(a)))
            step = max(1, PAIRS // len(a))
            for s in range(0, len(others), step):
                b = others[s : s + step]
                sim = np.zeros((len(b), len(a)))
                for k in range(length):
                    sim += vec[b, k][:, None] * vec[a, k]
                sim /= norm[b][:, None] * norm[a]
                at = np.full(len(asks), -1)
                at[b] = np.arange(len(b))
                places = np.flatnonzero(at[owner] >= 0)
                places = places[np.argsort(seg[places], kind="stable")]
                for own in np.split(places, np.flatnonzero(np.diff(seg[places])) + 1):
                    g, near = seg[own[0]], sim[at[owner[own]]]
                    amount = np.where(near <= least, -np.inf, near * freq[own][:, None] * decay)
                    k = amount.argmax(0)
                    most = amount[k, every]
                    more = ~(most <= best[g]) & ~np.isnan(best[g])
                    best[g, more], to[g, more] = most[more], (near[k, every] * share[own][k] * decay)[more]
            g, k = np.nonzero(best != -np.inf)
            found.append((first[g], a[k], best[g, k], to[g, k]))
        at, by, boost, norm_boost = (np.concatenate(x) for x in zip((first[:0], first[:0], freq[:0], freq[:0]), *found, strict=True))
        by = pa.array(by)
        return pa.table({"doc_id": rows.column("doc_id").take(by), "seg": names.take(pa.array(at)), "word": rows.column("word").take(by), "boost": boost, "norm_boost": norm_boost})

    both = lent.unionByName(asking, allowMissingColumns=True)
    return both.groupBy("doc_id").applyInArrow(each, f"doc_id {kinds['doc_id']}, seg {kinds['seg']}, word {kinds['word']}, boost double, norm_boost double")


def grid_maxima(grid: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, max_freq, max_rel, max_seg_freq, max_seg_rel, max_seg_norm_freq; 1 in place of 0."""
    one = lambda c, name: F.coalesce(F.nullif(F.max(c).cast("double"), F.lit(0.0)), F.lit(1.0)).alias(name)
    a = words.groupBy("doc_id").agg(one("freq", "max_freq"), one("rel", "max_rel"))
    b = grid.groupBy("doc_id").agg(one("freq", "max_seg_freq"), one("rel", "max_seg_rel"), one("norm_freq", "max_seg_norm_freq"))
    return a.join(b, "doc_id")
