"""Queries over whole results: custom segments, kept analyses, views by relevance and polarity, exports, reports.

Communities cannot be found in SQL, so those that exports show are given by rule here: a top word's is its
rank modulo three. What finds them is tested by itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions import colour
from hilandera.functions.lineage import cut, shared_folder
from hilandera.functions.text import xml_escaped
from hilandera.operators import layout, panels, reader, segments, stats, weave
from hilandera.operators import tokens as tok
from hilandera.plans import analysis, sql
from hilandera.plans.queries import _CELLS, _EVERY, _GRAPH, _GRID, _INK, _LEX, _PLAIN, _SEG, _SPREAD, _WEAVE, _WORDS, ORACLES, QUERIES, Work, _cosine, _marked, es, query, six, table, work
from hilandera.sources import exports, texts

__all__ = ["ORACLES", "QUERIES"]


# --- custom segments and kept analyses ----------------------------------------------------------

_TURNS = "SELECT conv_id * 1000000 + turn AS doc_id, text FROM conversations"


def _turns(spark, d) -> tuple[DataFrame, DataFrame]:
    """(bounds, content) of conversations as documents whose segments are their turns."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part"), F.col("role").alias("label"), "text")
    each = turns.select(F.struct("doc_id", "part").alias("doc_id"), "text")
    words = tok.content(tok.annotate(tok.tokenize(each))).select("doc_id.doc_id", "doc_id.part", "cpos", "lemma")
    bounds = segments.bounds_of(turns, words)
    place = bounds.select("doc_id", F.col("seg").alias("part"), "start_token")
    return bounds, words.join(place, ["doc_id", "part"]).select("doc_id", (F.col("start_token") + F.col("cpos")).alias("cpos"), "lemma")


_TURN_COUNTS = "counts AS (SELECT doc_id // 1000000 AS doc_id, doc_id % 1000000 AS seg, lemma AS word, count(*) AS freq FROM content GROUP BY ALL)"


@query(sql.query(sql.raw(_TURNS), sql.PLAIN, sql.FLAGS, _TURN_COUNTS, select="SELECT doc_id, seg, word, freq, round(freq / sum(freq) OVER (PARTITION BY doc_id, seg), 6) AS norm_freq FROM counts"))
def turn_segments(spark, d):
    bounds, content = _turns(spark, d)
    return segments.segment_counts(segments.custom_segments(content, bounds)).select("doc_id", "seg", "word", "freq", *six("norm_freq"))


@query(
    sql.query(
        sql.raw(_TURNS), sql.PLAIN, sql.FLAGS, _TURN_COUNTS, "sizes AS (SELECT doc_id, seg, sum(freq) AS n FROM counts GROUP BY ALL)",
        """ended AS (SELECT conv_id, turn, role, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY conv_id ORDER BY turn) AS e
      FROM conversations LEFT JOIN sizes ON doc_id = conv_id AND seg = turn)""",
        select="SELECT conv_id AS doc_id, turn AS seg, 'S' || (turn + 1) AS name, role AS label, (e - n)::BIGINT AS start_token, e::BIGINT AS end_token FROM ended",
    )
)
def turn_bounds(spark, d):
    return layout.segment_names(_turns(spark, d)[0])


_CHANGED = "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' sol y mar' ELSE text END AS text FROM documents WHERE lang = 'es'"


@query(
    sql.query(
        sql.raw(_CHANGED), sql.PLAIN, sql.FLAGS,
        """counts AS (SELECT doc_id, count(*) AS words, sum(CASE WHEN stop THEN 0 ELSE 1 END)::BIGINT AS content FROM flagged GROUP BY doc_id)""",
        select="SELECT doc_id, words, content, text NOT IN (SELECT text FROM documents WHERE lang = 'es') AS analysed FROM counts JOIN texts USING (doc_id)",
    )
)
def refreshed_stage1(spark, d):
    """Totals after a change of a tenth of the documents, and whose texts were analysed for it."""
    store = analysis.Stage1Store(spark, f"{shared_folder(spark)}/stage1-{uuid.uuid4().hex}")
    docs = es(spark, d)
    store.refresh(docs)
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" sol y mar"))).otherwise(F.col("text")))
    first, new = store.refresh(changed)
    named = changed.select("doc_id", F.sha2("text", 256).alias("digest")).join(new.withColumn("analysed", F.lit(True)), "digest", "left")
    return first.totals.join(named, "doc_id").select("doc_id", "words", "content", F.coalesce("analysed", F.lit(False)).alias("analysed"))


# --- words and views ------------------------------------------------------------------------------


def _given(w: Work) -> DataFrame:
    return stats.top(w.freqs).select("doc_id", "lemma", ((F.col("rank") - 1) % 3).cast("int").alias("comm"))


def _whole(w: Work) -> DataFrame:
    return tok.enrich(w.annotated, w.freqs.select("doc_id", "lemma", "freq"), w.relevance, _given(w), w.full)


_WHOLE = (*_SPREAD, sql.TONE, f"""whole AS (SELECT e.*, coalesce(f.freq, 0) AS freq, coalesce(r.rel, 0) AS rel, CASE WHEN f.rank <= {C.TOP_N} THEN (f.rank - 1) % 3 ELSE -1 END AS comm
    FROM enriched e LEFT JOIN freqs f ON f.doc_id = e.doc_id AND f.lemma = e.lemma LEFT JOIN relevance r ON r.doc_id = e.doc_id AND r.lemma = e.lemma)""")  # fmt: skip
_COLOURS = "[" + ", ".join(f"'{c}'" for c in C.PALETTE) + "]"


@query(sql.query(*_WHOLE, select=f"SELECT doc_id, pos, comm::INT AS comm, CASE WHEN NOT stop AND comm >= 0 THEN {_COLOURS}[comm + 1] END AS tint, CASE WHEN NOT stop THEN {_INK} END AS ink FROM whole"))
def reader_tints(spark, d):
    return layout.reader_marks(_whole(work(spark, d))).select("doc_id", "pos", "comm", "tint", "ink")


@query(sql.query(*_WHOLE, select=f"SELECT doc_id, pos, '{reader.COMMUNITY}' || comm AS community FROM whole WHERE NOT stop AND comm >= 0"))
def word_communities(spark, d):
    return reader.details(_whole(work(spark, d))).filter("community is not null").select("doc_id", "pos", "community")


@query(sql.query(*_SPREAD, select="SELECT f.doc_id, max(freq) AS max_freq, round(coalesce(nullif(max(rel), 0), 1), 6) AS max_rel FROM freqs f JOIN relevance r ON r.doc_id = f.doc_id AND r.lemma = f.lemma GROUP BY 1"))
def doc_maxima(spark, d):
    w = work(spark, d)
    return stats.maxima(w.freqs, w.relevance).select("doc_id", "max_freq", *six("max_rel"))


@query(sql.query(*_CELLS, select="SELECT doc_id, coalesce(nullif(max(CASE WHEN a <> b THEN cooc END), 0), 1)::DOUBLE AS max_cooc, round(coalesce(nullif(max(CASE WHEN a <> b THEN activ END), 0), 1), 6) AS max_activ FROM cells GROUP BY 1"))
def weave_maxima(spark, d):
    return weave.cell_maxima(work(spark, d).weave[1]).select("doc_id", "max_cooc", *six("max_activ"))


@query(
    sql.query(
        *_WEAVE,
        select="SELECT doc_id, seed, word, rel, dist, row_number() OVER (PARTITION BY doc_id ORDER BY ord, dist, t.word COLLATE es, t.word) AS rank FROM terms t JOIN (SELECT word AS seed, ord FROM seeds) USING (seed)",
    )
)
def weave_terms(spark, d):
    return work(spark, d).weave[0].select("doc_id", "seed", "word", "rel", "dist", "rank")


@query(sql.query(*_SEG, sql.TONE, _WORDS, "mean AS (SELECT doc_id, lemma, avg(polarity) AS polarity FROM enriched WHERE NOT stop AND polarity IS NOT NULL GROUP BY ALL)", select=f"SELECT s.doc_id, word, CASE WHEN polarity > 0.05 THEN '{C.POSITIVE}' WHEN polarity < -0.05 THEN '{C.NEGATIVE}' ELSE '{C.NEUTRAL}' END AS colour FROM selected s LEFT JOIN mean m ON m.doc_id = s.doc_id AND m.lemma = s.word"))
def word_valences(spark, d):
    w = work(spark, d)
    return layout.word_colours(stats.select_words(w.named, None), "valencia", stats.mean_polarity(w.toned)).select("doc_id", "word", "colour")


_BY_REL = layout.View(sort="relevance")


@query(
    sql.query(
        *_SPREAD, sql.SEGMENTS, _EVERY,
        f"""selected AS (SELECT * FROM (SELECT f.doc_id, f.lemma AS word, freq, coalesce(nullif(rel, 0), 1) AS rel, row_number() OVER (PARTITION BY f.doc_id ORDER BY coalesce(nullif(rel, 0), 1) DESC, freq DESC, f.lemma COLLATE es, f.lemma) AS rank
      FROM freqs f JOIN relevance r ON r.doc_id = f.doc_id AND r.lemma = f.lemma WHERE length(f.lemma) >= 2) WHERE rank <= {C.TOP_N})""",
        "grid AS (SELECT s.doc_id, e.seg, s.word, s.rank, coalesce(f.freq, 0)::DOUBLE AS freq, coalesce(f.norm_freq, 0) AS norm_freq, coalesce(s.rel * f.norm_freq, 0) AS rel FROM selected s JOIN every_seg e ON e.doc_id = s.doc_id LEFT JOIN seg_freq f ON f.doc_id = s.doc_id AND f.seg = e.seg AND f.word = s.word)",
        f"""bound AS (SELECT doc_id, coalesce(nullif(max(norm_freq), 0), 1) AS mf, coalesce(nullif(max(rel), 0), 1) AS mr FROM grid GROUP BY 1),
    counted AS (SELECT doc_id, greatest(10.0, {_BY_REL.chart_height} - (count(*) - 1) * 2) / count(*) AS base FROM selected GROUP BY 1)""",
        select="""SELECT g.doc_id, word, seg, round(CASE WHEN freq > 0 THEN 1 + rel / mr * (greatest(2, base * 2) - 1) ELSE 0 END, 6) AS h, round(CASE WHEN freq > 0 THEN 0.25 + norm_freq / mf * 0.75 ELSE 0 END, 6) AS opacity
    FROM grid g JOIN bound b ON b.doc_id = g.doc_id JOIN counted c ON c.doc_id = g.doc_id""",
    )
)
def layout_by_relevance(spark, d):
    w = work(spark, d)
    # words and grid are read several times: neither is made anew for each
    words = cut(stats.select_words(w.named, w.relevance, "relevance"))
    grid = segments.word_grid(words, segments.all_segments(w.docs), w.counts, w.relevance).persist()
    return layout.nodes(grid, words, segments.grid_maxima(grid, words), _BY_REL).select("doc_id", "word", "seg", *six("h", "opacity"))


@query(
    sql.query(
        *_SPREAD, sql.SEGMENTS, _WORDS, _EVERY, _GRID,
        "alike AS (SELECT s.doc_id, s.word, f.seg, sim * f.freq * 0.5 AS boost, sim * f.norm_freq * 0.5 AS norm_boost FROM (SELECT doc_id, word, lemma, sim FROM (SELECT s.doc_id, s.word, f.lemma, " + _cosine("s.word", "f.lemma") + " AS sim FROM selected s JOIN freqs f ON f.doc_id = s.doc_id) WHERE sim > 0.4) s JOIN seg_freq f ON f.doc_id = s.doc_id AND f.word = s.lemma)",
        "best AS (SELECT doc_id, seg, word, max(boost) AS boost, arg_max(norm_boost, boost) AS norm_boost FROM alike GROUP BY 1, 2, 3)",
        "lent AS (SELECT g.doc_id, g.seg, g.word, CASE WHEN freq > 0 THEN freq ELSE coalesce(boost, 0) END AS freq, CASE WHEN freq > 0 THEN norm_freq ELSE coalesce(norm_boost, 0) END AS norm_freq FROM grid g LEFT JOIN best b ON b.doc_id = g.doc_id AND b.seg = g.seg AND b.word = g.word)",
        select="SELECT l.doc_id, seg, word, round(freq, 5) AS freq, round(CASE WHEN freq > 0 THEN coalesce(nullif(r.rel, 0), 1) * norm_freq ELSE 0 END, 5) AS rel FROM lent l JOIN relevance r ON r.doc_id = l.doc_id AND r.lemma = l.word",
    )
)
def segment_grid(spark, d):
    """The segment view's grid: words by frequency, what they lack lent by alike ones, with relevance."""
    w = work(spark, d)
    words = cut(stats.select_words(w.named, None))
    grid = segments.word_grid(words, segments.all_segments(w.docs), w.counts, w.relevance, w.full.vectors)
    return grid.select("doc_id", "seg", "word", F.round("freq", 5).alias("freq"), F.round("rel", 5).alias("rel"))


@query(
    sql.query(
        *_SPREAD, sql.TONE,
        select="SELECT e.doc_id, e.pos, e.lemma, f.freq, round(r.rel, 6) AS rel, round(polarity, 6) + 0 AS polarity FROM enriched e JOIN freqs f ON f.doc_id = e.doc_id AND f.lemma = e.lemma JOIN relevance r ON r.doc_id = e.doc_id AND r.lemma = e.lemma WHERE NOT stop",
    )
)
def stage2_words(spark, d):
    """Both stages as a whole: the content words that stage 2 enriches."""
    w = work(spark, d)
    second = analysis.stage2(analysis.stage1(w.docs, w.assets).persist(), w.graph)
    return second.enriched.filter("not stop").select("doc_id", "pos", "lemma", "freq", *six("rel"), (F.round("polarity", 6) + F.lit(0.0)).alias("polarity"))


@query(sql.query(*_SEG, _WORDS, select="SELECT f.doc_id, f.pos, f.lemma, f.stop OR s.word IS NULL AS stop FROM flagged f LEFT JOIN selected s ON s.doc_id = f.doc_id AND s.word = f.lemma"))
def dimmed_words(spark, d):
    w = work(spark, d)
    selected = stats.select_words(w.named, None).select("doc_id", F.col("word").alias("lemma"))
    return tok.dim_unselected(tok.weave_view(w.annotated), selected).filter("type = 'w'").select("doc_id", "pos", "lemma", "stop")


@query(sql.query(*_GRAPH, sql.SEEDS, select="SELECT ord::BIGINT AS ord, word FROM seeds WHERE ord <> 1 UNION ALL SELECT max(ord)::BIGINT + 1, 'otra' FROM seeds HAVING max(ord) IS NOT NULL"))
def toggled_seeds(spark, d):
    seeds = work(spark, d).seeds.select(F.col("ord").cast("bigint").alias("ord"), "word")
    first = seeds.orderBy("ord").first()
    return panels.toggled(panels.toggled(seeds, "word", first["word"] if first else ""), "word", "otra").select("ord", "word")


_RGB = "list_transform([1, 3, 5], lambda i: ('0x' || substr(md5(lemma), i, 2))::INT)"


@query(
    sql.query(
        *_LEX,
        f"rgb AS (SELECT DISTINCT lemma, {_RGB} AS c FROM content)",
        "parts AS (SELECT lemma, c, c[1] / 255 AS r, c[2] / 255 AS g, c[3] / 255 AS b, greatest(c[1], c[2], c[3]) / 255 AS hi, least(c[1], c[2], c[3]) / 255 AS lo FROM rgb)",
        """hsl AS (SELECT lemma, c, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END * 60 AS h,
      CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END * 100 AS s, (hi + lo) * 50 AS l FROM parts)""",
        select="SELECT lemma, c[1] AS r, c[2] AS g, c[3] AS b, round(h, 5) AS h, round(s, 5) AS s, round(l, 5) AS l, (c[1] + c[2] + c[3])::INT AS back FROM hsl",
    )
)
def lemma_colours(spark, d):
    """Each lemma's own colour (of its digest) as RGB and HSL, and the sum of the channels that HSL gives back."""
    rgb = work(spark, d).lemmas.select("lemma", colour.hex_to_rgb(F.concat(F.lit("#"), F.substring(F.md5("lemma"), 1, 6))).alias("c"))
    both = rgb.withColumn("o", colour.rgb_to_hsl(F.col("c"))).withColumn("x", colour.hsl_to_rgb(F.col("o")))
    return both.select("lemma", "c.*", *(F.round(f"o.{k}", 5).alias(k) for k in "hsl"), (F.col("x.r") + F.col("x.g") + F.col("x.b")).alias("back"))


# --- sources and sinks ----------------------------------------------------------------------------


@query("WITH marked AS (SELECT doc_id, 'before' || '---SEG: first ---' || replace(text, chr(10), '---SEG:more---') AS t FROM documents WHERE lang = 'es') SELECT doc_id, replace(replace(t, '---SEG: first ---', chr(10) || chr(10)), '---SEG:more---', chr(10) || chr(10)) AS text FROM marked")
def unmarked_texts(spark, d):
    return texts.without_segment_markers(_marked(spark, d, "SEG")).select("doc_id", "text")


_TEI_HEAD = '<TEI><teiHeader><titleStmt><title>{0}</title></titleStmt></teiHeader><text><body><p>'


@query(
    r"SELECT doc_id, 0 AS part, 'n. ' || doc_id AS label, array_to_string(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^[ \t\r]+|[ \t\r]+$', '', 'g')), chr(10) || chr(10)) AS text FROM documents WHERE lang = 'es'"
)
def tei_paragraphs(spark, d):
    """Documents put into TEI, a paragraph for each line, and imported again."""
    lines = F.replace(xml_escaped("text"), F.lit("\n"), F.lit("</p><p>"))
    head, tail = _TEI_HEAD.split("{0}")
    tei = F.concat(F.lit(head), F.concat(F.lit("n. "), F.col("doc_id").cast("string")), F.lit(tail), lines, F.lit("</p></body></text></TEI>"))
    return texts.import_tei(es(spark, d).select("doc_id", tei.alias("text"))).filter("error is null").select("doc_id", "part", "label", "text")


_NL = "chr(10)"
_FOUR = "printf('%.4f', {0})"
_FLAGS_SQL = ", ".join(f"CASE WHEN {c} THEN '1' ELSE '0' END" for c in sql.EMOTIONS.values())


@query(
    sql.query(
        *_WHOLE,
        f"lines AS (SELECT doc_id, pos, concat_ws(',', raw, lemma, tag, stop::INT, freq, {_FOUR.format('rel')}, coalesce({_FOUR.format('polarity + 0')}, ''), coalesce({_FOUR.format('arousal')}, ''), CASE WHEN comm >= 0 THEN comm::VARCHAR ELSE '' END, {_FLAGS_SQL}) AS line FROM whole)",
        select=f"SELECT doc_id, '{exports.csv_header()}' || {_NL} || string_agg(line, {_NL} ORDER BY pos) AS csv FROM lines GROUP BY 1",
    )
)
def csv_communities(spark, d):
    return exports.csv_documents(_whole(work(spark, d)))


def _esc(c: str) -> str:
    return f"""replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


def _feature(name: str, value: str) -> str:
    return f"""'    <f name="{name}"><numeric value="' || {value} || '"/></f>'"""


_EMOTION_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{e}' END" for e, c in sql.EMOTIONS.items()) + "], lambda x: x IS NOT NULL)"
_TEI_WORD = f"""concat_ws({_NL}, '<w lemma="' || {_esc('w.lemma')} || '" pos="' || tag || '">', '  <fs>', {_feature('freq', 'freq')}, {_feature('rel', _FOUR.format('rel'))},
    CASE WHEN polarity IS NOT NULL THEN {_feature('polarity', _FOUR.format('polarity + 0'))} END, CASE WHEN arousal IS NOT NULL THEN {_feature('arousal', _FOUR.format('arousal'))} END,
    CASE WHEN comm >= 0 THEN {_feature('community', 'comm')} END, CASE WHEN len(emotions) > 0 THEN '    <f name="emotions"><string>' || array_to_string(emotions, ',') || '</string></f>' END,
    '  </fs>', '  ' || {_esc('v.raw')}, '</w>')"""
_TEI = (
    *_WHOLE,
    "paras AS (SELECT *, sum(CASE WHEN type = 'p' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS para FROM raw)",
    "begun AS (SELECT *, max(CASE WHEN type <> 's' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, para ORDER BY pos ROWS UNBOUNDED PRECEDING) AS b FROM paras WHERE type <> 'p')",
    f"felt AS (SELECT *, {_EMOTION_LIST} AS emotions FROM whole)",
    f"lines AS (SELECT v.doc_id, para, v.pos, CASE WHEN v.type = 's' THEN ' ' WHEN v.type = 'x' OR w.stop THEN {_esc('v.raw')} ELSE {_TEI_WORD} END AS line FROM begun v LEFT JOIN felt w ON w.doc_id = v.doc_id AND w.pos = v.pos WHERE b = 1)",
    f"held AS (SELECT doc_id, para, '<p>' || {_NL} || string_agg(line, {_NL} ORDER BY pos) || {_NL} || '</p>' AS p FROM lines GROUP BY 1, 2)",
    f"bodies AS (SELECT doc_id, string_agg(p, {_NL} ORDER BY para) AS body FROM held GROUP BY 1)",
)


def _head_sql(title: str, kind: str, source: str) -> str:
    return f"""'<teiHeader>', '  <fileDesc>', '    <titleStmt><title>' || {title} || '</title></titleStmt>', '    <publicationStmt><p>Generated by {exports.NAME}</p></publicationStmt>', '    <sourceDesc><p>{source}</p></sourceDesc>', '  </fileDesc>',
    '  <profileDesc>', '    <langUsage><language ident="es">Spanish</language></langUsage>', '  </profileDesc>', '</teiHeader>'"""


_TEI_TEXT = f"""'<TEI xmlns="http://www.tei-c.org/ns/1.0">', {_head_sql("doc_id::VARCHAR", "TEI", "Multi-layered textual analysis (Spanish)")}, '<text xml:lang="es">', '<body>', coalesce(body, '<p>' || {_NL} || '</p>'), '</body>', '</text>', '</TEI>'"""


@query(sql.query(*_TEI, select=f"SELECT doc_id, concat_ws({_NL}, '{exports.DECLARATION}', {_TEI_TEXT}) AS tei FROM texts LEFT JOIN bodies USING (doc_id)"))
def tei_communities(spark, d):
    w = work(spark, d)
    return exports.tei_documents(w.docs, tok.weave_view(w.annotated), _whole(w))


@query(
    sql.query(
        *_TEI,
        select=f"""SELECT 1 AS part, doc_id, concat_ws({_NL}, {_TEI_TEXT}) AS line FROM texts LEFT JOIN bodies USING (doc_id)
    UNION ALL SELECT 0, NULL, concat_ws({_NL}, '{exports.DECLARATION}', '<teiCorpus xmlns="http://www.tei-c.org/ns/1.0">', {_head_sql(f"'{exports.NAME} Corpus'", "teiCorpus", "Multi-document analysis (Spanish)")}) UNION ALL SELECT 2, NULL, '</teiCorpus>'""",
    )
)
def tei_corpus(spark, d):
    w = work(spark, d)
    return exports.tei_corpus_lines(w.docs, tok.weave_view(w.annotated), _whole(w))


def _grams_cte(name: str, n: int, most: int) -> str:
    lead = ", ".join(f"lead(lemma, {k}) OVER w AS l{k}" for k in range(1, n))
    gram = " || ' ' || ".join(["lemma", *(f"l{k}" for k in range(1, n))])
    counts = f"SELECT doc_id, gram, count(*) AS freq, min(cpos) AS first FROM (SELECT doc_id, cpos, {gram} AS gram FROM (SELECT *, {lead} FROM content WINDOW w AS (PARTITION BY doc_id ORDER BY cpos))) WHERE gram IS NOT NULL GROUP BY ALL"
    return f"{name} AS (SELECT doc_id, string_agg('- ' || gram || ' (' || freq || ')', {_NL} ORDER BY rank) AS g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, first) AS rank FROM ({counts})) WHERE rank <= {most} GROUP BY 1)"


def _section(title: str, body: str, always: bool) -> str:
    text = f"concat_ws({_NL}, '## {title}', '', {body}, '')"
    return text if always else f"CASE WHEN {body} IS NOT NULL THEN {text} END"


@query(
    sql.query(
        *_SPREAD,
        "sized AS (SELECT doc_id, count(*) AS words, sum(CASE WHEN stop THEN 0 ELSE 1 END)::BIGINT AS content FROM flagged GROUP BY 1)",
        f"top AS (SELECT f.doc_id, f.lemma, f.freq, f.rank, (f.rank - 1) % 3 AS comm, rel FROM freqs f JOIN relevance r ON r.doc_id = f.doc_id AND r.lemma = f.lemma WHERE rank <= {C.TOP_N})",
        f"listed AS (SELECT doc_id, count(*) AS n, string_agg(rank || '. **' || lemma || '** — frec: ' || freq || ', relev: ' || printf('%.1f', round(rel, 1)), {_NL} ORDER BY rank) AS g FROM top WHERE rank <= 25 GROUP BY 1)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, comm ORDER BY rank) AS place, count(*) OVER (PARTITION BY doc_id, comm) AS size FROM top)",
        "members AS (SELECT doc_id, comm, size, string_agg(lemma, ', ' ORDER BY place) AS m FROM placed WHERE place <= 15 GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"),
        f"grouped AS (SELECT doc_id, string_agg('- **Comunidad ' || comm || '** (' || size || '): ' || m || CASE WHEN size > 15 THEN '...' ELSE '' END, {_NL} ORDER BY comm) AS g FROM members GROUP BY 1)",
        _grams_cte("two", 2, 15), _grams_cte("three", 3, 10),
        select=f"""SELECT t.doc_id, concat_ws({_NL}, '# Informe de análisis', '', '**Documento:** ' || t.doc_id, '**Tokens totales:** ' || format('{{:,}}', coalesce(words, 0)), '**Palabras de contenido:** ' || format('{{:,}}', coalesce(content, 0)), '**Top N:** ' || coalesce(l.n, 0), '',
    {_section("Palabras más frecuentes", "l.g", True)}, {_section("Comunidades (Louvain)", "c.g", True)}, {_section("Bigramas principales", "b.g", False)}, {_section("Trigramas principales", "x.g", False)}, '---', '*Generado por {exports.NAME}*') AS report
    FROM texts t LEFT JOIN sized s ON s.doc_id = t.doc_id LEFT JOIN listed l ON l.doc_id = t.doc_id LEFT JOIN grouped c ON c.doc_id = t.doc_id LEFT JOIN two b ON b.doc_id = t.doc_id LEFT JOIN three x ON x.doc_id = t.doc_id""",
    )
)
def report_communities(spark, d):
    w = work(spark, d)
    top = stats.top(w.freqs)
    return exports.reports(w.docs, analysis.totals(w.annotated), top, w.relevance, _given(w), stats.top_ngrams(w.content, 2), stats.top_ngrams(w.content, 3))


@query(sql.query(*_PLAIN, select=f"SELECT doc_id, rank, gram, freq FROM (SELECT doc_id, gram, count(*) AS freq, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(cpos)) AS rank FROM (SELECT doc_id, cpos, lemma || ' ' || lead(lemma) OVER (PARTITION BY doc_id ORDER BY cpos) AS gram FROM content) WHERE gram IS NOT NULL GROUP BY 1, 2) WHERE rank <= {C.TOP_N}"))
def stage1_bigrams(spark, d):
    """Stage 1 as a whole, read at its end."""
    return analysis.stage1(es(spark, d)).bigrams.select("doc_id", "rank", "gram", "freq")
