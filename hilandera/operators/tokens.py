"""Token streams: texts as rows (doc_id, pos), tagged, lemmatized, flagged.

Windows are partitioned by document and ordered by position. A text of more than BLOCK characters is cut
into parts where tokens end: whatever runs along such a text (positions, paragraphs, numbers of content
words, open negations) runs within blocks of BLOCK tokens and is carried from block to block, so one huge
document keeps many tasks busy. Where there are such texts, rows tell by `long` whether theirs is one.
What is carried, a row for each block of a long text, is checkpointed, as several plans read it. A
doc_id is not null and names one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions.lineage import cut
from hilandera.functions.scans import carried, taken_over
from hilandera.functions.text import SPACE, TOKEN, WORD, part, straight_quotes, suffix_tag

#: Characters of a text, and tokens of a block, beyond which a text is analysed in blocks.
BLOCK = 1 << 20
#: Keys, none of them a word, that tokens which are no words are dealt to.
ASIDE = 4096


@dataclass(frozen=True)
class Assets:
    """Lexicons as tables; a missing one leaves its engine not ready.

    pos (word, pos); lemma (key, lemma), key = word or word#pos; edges (src, pos, rel, ord, dst);
    emolex (lemma, emotions array); intensity (lemma, intensity); vad (lemma, v, a, d);
    swn (lemma, pos, payload); vectors (word, vec).
    """

    pos: DataFrame | None = None
    lemma: DataFrame | None = None
    edges: DataFrame | None = None
    emolex: DataFrame | None = None
    intensity: DataFrame | None = None
    vad: DataFrame | None = None
    swn: DataFrame | None = None
    vectors: DataFrame | None = None


def by_document(rows: DataFrame) -> DataFrame:
    """rows with each document's in one partition, so that what runs along documents shuffles nothing more;
    where there are long texts, as they are. The number of partitions is the session's, as texts and counts
    are much smaller than the tokens that follow from them."""
    if "long" in rows.columns:
        return rows
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def in_order(*keys: str) -> Window:
    return Window.partitionBy("doc_id").orderBy(*(keys or ("pos",)))


def by_length(rows: DataFrame, whole: Callable[[DataFrame], DataFrame], blocked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """whole(the rows of short texts) and blocked(those of long ones, with _block) together."""
    if "long" not in rows.columns:
        return whole(rows)
    block = F.floor(F.col("pos") / BLOCK).cast("bigint")
    return whole(rows.filter("not long")).unionByName(blocked(rows.filter("long").withColumn("_block", block)).drop("_block"))


def in_block() -> Window:
    return Window.partitionBy("doc_id", "_block").orderBy("pos")


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """rows (doc_id, pos) numbered from 0 in each document."""

    def blocked(of: DataFrame) -> DataFrame:
        before = carried(cut(of.groupBy("doc_id", "_block").agg(F.count(F.lit(1)).alias("_before"))), ["doc_id"], "_block", {"_before": "sum"})
        own = of.withColumn(out, F.row_number().over(in_block()) - 1)
        return taken_over(own, before, ["doc_id", "_block"]).withColumn(out, (F.col(out) + F.col("_before")).cast("bigint")).drop("_before")

    return by_length(rows, lambda of: of.withColumn(out, (F.row_number().over(in_order()) - 1).cast("bigint")), blocked)


def _kinds(tokens: DataFrame) -> DataFrame:
    first = F.substring("raw", 1, 1)
    kind = F.when(first.rlike(WORD), "w").when(first.rlike(SPACE), F.when(_breaks(F.col("raw")), "p").otherwise("s")).otherwise("x")
    return tokens.withColumn("pos", F.col("pos").cast("bigint")).withColumn("type", kind)


def _breaks(raw: Column) -> Column:
    return F.contains(raw, F.lit("\n\n")) | F.contains(raw, F.lit("\r\n\r\n"))


def tokenize(docs: DataFrame, blocks: bool | None = None) -> DataFrame:
    """doc_id, pos, raw, type (w word, s space, p paragraph break, x other), para, and long if there are long texts.

    The raw tokens of a text, put together, are the text with straight quotes. blocks: whether there
    are long texts; by default one is looked for, which a single one found ends.
    """
    text = straight_quotes("text")
    tokens_of = lambda c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    size, so_far = F.length("text"), F.sum((F.col("type") == "p").cast("bigint"))
    blocks = not docs.filter(size > BLOCK).isEmpty() if blocks is None else blocks
    # texts are dealt out, not their tokens
    dealt = by_document((docs.filter(size <= BLOCK) if blocks else docs).select("doc_id", "text"))
    short = _kinds(dealt.select("doc_id", F.posexplode(tokens_of(text)).alias("pos", "raw")))
    short = short.withColumn("para", so_far.over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    if not blocks:
        return short
    # parts are dealt out before their tokens are rows
    parts = docs.filter(size > BLOCK).select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(part(BLOCK)), F.lit(0))).alias("_part", "part")).repartition("doc_id", "_part")
    sizes = parts.select("doc_id", "_part", F.size(tokens_of(F.col("part"))).cast("bigint").alias("_at"), F.size(F.filter(tokens_of(F.col("part")), _breaks)).cast("bigint").alias("_para"))
    placed = taken_over(parts, carried(cut(sizes), ["doc_id"], "_part", {"_at": "sum", "_para": "sum"}), ["doc_id", "_part"])
    long = _kinds(placed.select("doc_id", "_part", "_at", "_para", F.posexplode(tokens_of(F.col("part"))).alias("pos", "raw")))
    here = so_far.over(Window.partitionBy("doc_id", "_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    long = long.withColumn("para", F.col("_para") + here).withColumn("pos", F.col("_at") + F.col("pos"))
    return short.withColumn("long", F.lit(False)).unionByName(long.select(*short.columns, F.lit(True).alias("long")))


def tag(words: DataFrame, word: str, assets: Assets, out: str = "tag") -> DataFrame:
    """words with the part of speech of a column of lower-case words."""
    if assets.pos is None:
        return words.withColumn(out, suffix_tag(word))
    lexicon = assets.pos.select(F.col("word").alias("_word"), F.col("pos").alias("_pos"))
    return words.join(lexicon, F.col(word) == F.col("_word"), "left").withColumn(out, F.coalesce("_pos", suffix_tag(word))).drop("_word", "_pos")


def lemmatize(words: DataFrame, word: str, pos: str, assets: Assets, out: str = "lemma") -> DataFrame:
    """Lemma by word#pos, else by word, else the word. The lexicon is gathered by word, so that a word meets
    it under the key of other lexicons of words."""
    if assets.lemma is None:
        return words.withColumn(out, F.col(word))
    own = F.substring_index("key", "#", -1)
    readings = F.array(F.struct(F.col("key").alias("_word"), F.lit(None).cast("string").alias("_pos")))
    under = F.struct(F.expr("substring(key, 1, length(key) - length(substring_index(key, '#', -1)) - 1)").alias("_word"), own.alias("_pos"))
    every = assets.lemma.select("lemma", F.explode(F.when(F.contains("key", F.lit("#")), F.concat(readings, F.array(under))).otherwise(readings)).alias("r"))
    each = every.groupBy("r._word", "r._pos").agg(F.max("lemma").alias("_lemma"))
    tagged = F.map_from_entries(F.collect_list(F.when(F.col("_pos").isNotNull() & F.col("_lemma").isNotNull(), F.struct("_pos", "_lemma"))))
    lexicon = each.groupBy("_word").agg(F.max(F.when(F.col("_pos").isNull(), F.col("_lemma"))).alias("_l2"), tagged.alias("_by"))
    words = words.join(lexicon, F.col(word) == F.col("_word"), "left")
    return words.withColumn(out, F.coalesce(F.col("_by")[F.col(pos)], "_l2", word)).drop("_word", "_l2", "_by")


def is_stop(lemma: Column, surface: Column) -> Column:
    return lemma.isin(*C.STOP_WORDS) | surface.isin(*C.STOP_WORDS) | surface.isin(*C.NEGATION)


def annotate(tokens: DataFrame, assets: Assets = Assets()) -> DataFrame:
    """tokens with surface, lemma, tag, stop, neg. What is no word is a stop, tagged x."""
    word = F.col("type") == "w"
    # what is no word meets nothing in a lexicon: a key of its own keeps it from one task
    aside = F.concat(F.lit(" "), F.pmod(F.xxhash64("doc_id", "pos"), F.lit(ASIDE)).cast("string"))
    t = tokens.withColumn("low", F.when(word, F.lower("raw")).otherwise(aside))
    t = t.withColumn("tag", F.lit("n")) if assets.pos is None else tag(t, "low", assets)
    t = lemmatize(t, "low", "tag", assets)
    return t.select(
        "doc_id", "pos", F.col("raw").alias("surface"),
        F.when(word, F.col("lemma")).otherwise(F.col("raw")).alias("lemma"),
        F.when(word, F.col("tag")).otherwise("x").alias("tag"),
        F.when(word, is_stop(F.col("lemma"), F.col("low"))).otherwise(True).alias("stop"),
        F.when(word, F.col("low").isin(*C.NEGATION)).otherwise(False).alias("neg"),
        "type", "para", *(c for c in ("long",) if c in tokens.columns),
    )


def content(annotated: DataFrame) -> DataFrame:
    """Words that are no stops, numbered from 0 in each document (cpos)."""
    return numbered(annotated.filter((F.col("type") == "w") & ~F.col("stop")), "cpos")


def words(annotated: DataFrame) -> DataFrame:
    """The words, stops among them, numbered from 0 in each document (i)."""
    return numbered(annotated.filter("type = 'w'"), "i")


def _tones(assets: Assets) -> list[tuple[DataFrame, list[tuple[str, str]]]]:
    """What the lexicons say of a lemma: tables by lemma, each with its columns (name, type)."""
    double = lambda *names: [(c, "double") for c in names]
    tables = [(assets.emolex, [("emotions", "array<string>")]), (assets.intensity, double("intensity")), (assets.vad, double("v", "a", "d"))]
    payloads = [(f"_{p}", "string") for p in "nvar"]
    by = None if assets.swn is None else assets.swn.groupBy("lemma").agg(*(F.max(F.when(F.col("pos") == p, F.col("payload"))).alias(f"_{p}") for p in "nvar"))
    return [*tables, (by, payloads)]


def _felt(words: DataFrame) -> DataFrame:
    """words (tag, and what the lexicons say of the lemma) with polarity, arousal, payload and has."""
    own = F.coalesce(*(F.when(F.col("tag") == p, F.col(f"_{p}")) for p in "nvar"))
    out = words.withColumn("payload", F.coalesce(own, "_n", "_v", "_a", "_r")).drop("_n", "_v", "_a", "_r")
    out = out.withColumn("polarity", (F.col("v") - 0.5) * 2).withColumnRenamed("a", "arousal")
    has = F.coalesce(*(F.col(c).cast("string") for c in ("intensity", "payload", "polarity")), F.array_join("emotions", ","))
    return out.withColumn("has", has.isNotNull()).drop("v", "d")


def _with_tones(lemmas: DataFrame, assets: Assets) -> DataFrame:
    """lemmas (lemma) with what the lexicons say of them: outer joins by lemma."""
    out = lemmas
    for table, columns in _tones(assets):
        if table is None:
            out = out.withColumns({c: F.lit(None).cast(kind) for c, kind in columns})
        else:
            out = out.join(table.select("lemma", *(c for c, _ in columns)), "lemma", "left")
    return out


def add_sentiment(words: DataFrame, assets: Assets) -> DataFrame:
    """words (lemma, tag) with polarity, arousal, emotions, intensity, payload and has: outer joins with
    the lexicons; a payload falls back to the first part of speech in n, v, a, r that has one."""
    return _felt(_with_tones(words, assets))


def told(words: DataFrame, *known: DataFrame) -> DataFrame:
    """words (doc_id, lemma) with what is known of a document's lemma, by tables (doc_id, lemma, ...), a row
    for each. They meet where the document lies: tables that lie together by document, above all the words, are
    not shuffled. What is known of a lemma goes before its words in the order, and none of it is held."""
    of = lambda t: [c for c in t.columns if c not in ("doc_id", "lemma")]
    both = words.select("doc_id", "lemma", F.struct(*of(words)).alias("_word"))
    for i, t in enumerate(known):
        both = both.unionByName(by_document(t).select("doc_id", "lemma", F.struct(*of(t)).alias(f"_mark{i}")), allowMissingColumns=True)
    order = Window.partitionBy("doc_id", "lemma").orderBy(F.col("_word").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.select("doc_id", "lemma", "_word", *(F.first(f"_mark{i}", ignorenulls=True).over(order).alias(f"_mark{i}") for i in range(len(known))))
    return met.filter("_word is not null").select("doc_id", "lemma", "_word.*", *(F.col(f"_mark{i}.{c}").alias(c) for i, t in enumerate(known) for c in of(t)))


def _lemmas(words: DataFrame, assets: Assets) -> DataFrame:
    """doc_id, lemma of each word's lemma once, with what the lexicons say of it."""
    return _with_tones(words.select("doc_id", "lemma").distinct(), assets)


def toned(words: DataFrame, assets: Assets) -> DataFrame:
    """add_sentiment for words of documents (doc_id, lemma, tag): lexicons meet each lemma of a document once."""
    return _felt(told(words, _lemmas(words, assets)))


def negate(words: DataFrame, scope: int = C.NEGATION_SCOPE) -> DataFrame:
    """words (pos, neg, stop, polarity) with the polarity of the first `scope` content words after a
    negation turned; another negation starts anew. Zero stays zero."""

    def counted(of: DataFrame, order: Window) -> DataFrame:
        rows = order.rowsBetween(Window.unboundedPreceding, 0)
        n = of.withColumn("_c", F.sum((~F.col("stop")).cast("bigint")).over(rows))
        return n.withColumn("_c0", F.last(F.when(F.col("neg"), F.col("_c")), ignorenulls=True).over(rows))

    def blocked(of: DataFrame) -> DataFrame:
        # content words before the block, and how many there were at the last negation
        own, on = counted(of, in_block()), ["doc_id", "_block"]
        totals = cut(own.groupBy(*on).agg(F.max("_c").alias("_before"), F.max("_c0").alias("_open")))
        before = carried(totals.drop("_open"), ["doc_id"], "_block", {"_before": "sum"})
        opened = taken_over(totals.drop("_before"), before, on).withColumn("_open", F.col("_open") + F.col("_before"))
        carry = carried(opened, ["doc_id"], "_block", {"_open": "max"})
        whole = taken_over(own, carry, on)
        return whole.withColumn("_c", F.col("_c") + F.col("_before")).withColumn("_c0", F.coalesce(F.col("_c0") + F.col("_before"), "_open")).drop("_before", "_open")

    n = by_length(words, lambda of: counted(of, in_order()), blocked)
    inside = ~F.col("stop") & (F.col("_c") - F.col("_c0")).between(1, scope)
    turned = F.when(F.coalesce(inside, F.lit(False)), -F.col("polarity")).otherwise(F.col("polarity")) + F.lit(0.0)
    return n.withColumn("polarity", turned).drop("_c", "_c0")


def enrich(annotated: DataFrame, freqs: DataFrame, relevance: DataFrame, communities: DataFrame, assets: Assets) -> DataFrame:
    """The words with rel (else 0), freq (else 0), polarity, arousal, emotions and comm (else -1).

    What is known of a document's lemma, by the lexicons too, is gathered before its words meet it, once; the
    words of a document stay together, as negations need them.
    """
    defaults = {"freq": F.lit(0).cast("bigint"), "rel": F.lit(0.0), "comm": F.lit(-1)}
    words = annotated.filter("type = 'w'")
    known = (t.select("doc_id", "lemma", name) for t, name in ((freqs, "freq"), (relevance, "rel"), (communities, "comm")))
    met = told(words, _lemmas(words, assets), *known)
    return negate(by_document(_felt(met).withColumns({k: F.coalesce(k, v) for k, v in defaults.items()})))


def weave_view(annotated: DataFrame) -> DataFrame:
    """doc_id, para, ord, surface, lemma, stop, type: paragraphs without their leading spaces, every
    other space as one blank."""
    shown = annotated.filter("type <> 'p'")
    para = Window.partitionBy("doc_id", "para").orderBy("pos")
    any_before = F.max((F.col("type") != "s").cast("int")).over(para.rowsBetween(Window.unboundedPreceding, 0)) == 1
    v = shown.withColumn("_keep", any_before).filter("_keep")
    blank = lambda c: F.when(F.col("type") == "s", " ").otherwise(F.col(c)).alias(c)
    return v.select("doc_id", "para", (F.row_number().over(para) - 1).cast("bigint").alias("ord"), blank("surface"), blank("lemma"), "stop", "type", "pos")


def dim_unselected(view: DataFrame, selected: DataFrame) -> DataFrame:
    """view with stop = true for content words outside selected (doc_id, lemma)."""
    marked = selected.select("doc_id", "lemma").distinct().withColumn("_in", F.lit(True))
    return view.join(marked, ["doc_id", "lemma"], "left").withColumn("stop", F.col("stop") | (F.col("type") == "w") & F.col("_in").isNull()).drop("_in")
