"""Sinks: CSV rows, TEI documents and corpora, Markdown reports, as text columns; files through Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions.text import csv_field, fixed, xml_escaped
from hilandera.operators.tokens import by_document

NAME = "Hilandera"


def csv_rows(enriched: DataFrame) -> DataFrame:
    """doc_id, pos, line: 17 fields for each word, stops included."""
    four = fixed(4)
    has = lambda e: F.coalesce(F.array_contains("emotions", e), F.lit(False)).cast("int").cast("string")
    fields = [
        csv_field("surface"), csv_field("lemma"), csv_field("tag"), F.col("stop").cast("int").cast("string"), F.col("freq").cast("string"),
        four(F.col("rel").cast("double")), F.coalesce(four("polarity"), F.lit("")), F.coalesce(four("arousal"), F.lit("")),
        F.when(F.col("comm") >= 0, F.col("comm").cast("string")).otherwise(""), *map(has, C.EMOTIONS),
    ]
    return enriched.select("doc_id", "pos", F.concat_ws(",", *fields).alias("line"))


def csv_header() -> str:
    return ",".join(["surface", "lemma", "pos", "stop", "freq", "rel", "polarity", "arousal", "community", *(f"emo_{e}" for e in C.EMOTIONS)])


def _lines(rows: DataFrame, order: list[str], line: str = "line") -> DataFrame:
    """doc_id, body: a document's lines in order."""
    held = F.sort_array(F.collect_list(F.struct(*order, line)))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(held, lambda x: x[line]), "\n").alias("body"))


def csv_documents(enriched: DataFrame) -> DataFrame:
    """doc_id, csv: header and rows."""
    return _lines(csv_rows(enriched), ["pos"]).select("doc_id", F.concat(F.lit(csv_header() + "\n"), "body").alias("csv"))


def tei_tokens(view: DataFrame, enriched: DataFrame) -> DataFrame:
    """doc_id, para, ord, line: content words with their features, everything else as text."""
    four = fixed(4)
    # a place's word stands before it in the order of its document; neither is shuffled if both lie by document
    features = ["tag", "freq", "rel", "polarity", "arousal", "comm", "emotions"]
    shown = by_document(view).select("doc_id", "pos", F.struct("para", "ord", "surface", "lemma", "stop", "type").alias("_shown"))
    w = by_document(enriched).select("doc_id", "pos", F.struct("pos", *features).alias("_w"))
    order = Window.partitionBy("doc_id").orderBy("pos", F.col("_shown").isNotNull())
    both = shown.unionByName(w, allowMissingColumns=True).withColumn("_w", F.lag("_w").over(order)).filter("_shown is not null")
    same = F.col("_w.pos") == F.col("pos")
    both = both.select("doc_id", "_shown.*", *(F.when(same, F.col(f"_w.{c}")).alias(c) for c in features))
    feature = lambda name, value: F.concat(F.lit(f'    <f name="{name}"><numeric value="'), value, F.lit('"/></f>'))
    known = F.filter(F.array(*map(F.lit, C.EMOTIONS)), lambda e: F.array_contains("emotions", e))
    emotions = F.when(F.size(known) > 0, F.concat(F.lit('    <f name="emotions"><string>'), F.array_join(known, ","), F.lit("</string></f>")))
    content = F.concat_ws(
        "\n",
        F.concat(F.lit('<w lemma="'), xml_escaped("lemma"), F.lit('" pos="'), xml_escaped("tag"), F.lit('">')),
        F.lit("  <fs>"),
        feature("freq", F.col("freq").cast("string")),
        feature("rel", four(F.col("rel").cast("double"))),
        F.when(F.col("polarity").isNotNull(), feature("polarity", four("polarity"))),
        F.when(F.col("arousal").isNotNull(), feature("arousal", four("arousal"))),
        F.when(F.col("comm") >= 0, feature("community", F.col("comm").cast("string"))),
        emotions,
        F.lit("  </fs>"),
        F.concat(F.lit("  "), xml_escaped("surface")),
        F.lit("</w>"),
    )
    line = F.when(F.col("type") == "s", " ").when((F.col("type") == "x") | F.col("stop"), xml_escaped("surface")).otherwise(content)
    return both.select("doc_id", "para", "ord", line.alias("line"))


def _header(title: Column, kind: str, source: str) -> list[Column]:
    return [
        F.lit("<teiHeader>"), F.lit("  <fileDesc>"), F.concat(F.lit("    <titleStmt><title>"), title, F.lit("</title></titleStmt>")),
        F.lit(f"    <publicationStmt><p>Generated by {NAME}</p></publicationStmt>"), F.lit(f"    <sourceDesc><p>{source}</p></sourceDesc>"), F.lit("  </fileDesc>"),
        F.lit("  <profileDesc>"), F.lit('    <langUsage><language ident="es">Spanish</language></langUsage>'), F.lit("  </profileDesc>"), F.lit("</teiHeader>"),
    ]


DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'


def tei_documents(docs: DataFrame, view: DataFrame, enriched: DataFrame, declare: bool = True) -> DataFrame:
    """doc_id, tei: one TEI document for each of docs (doc_id, label)."""
    tokens = tei_tokens(view, enriched)
    held = F.sort_array(F.collect_list(F.struct("ord", "line")))
    paras = tokens.groupBy("doc_id", "para").agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("line"))
    paras = paras.withColumn("line", F.concat(F.lit("<p>\n"), "line", F.lit("\n</p>")))
    body = docs.select("doc_id", "label").join(_lines(paras, ["para"]), "doc_id", "left")
    head = _header(xml_escaped("label"), "TEI", "Multi-layered textual analysis (Spanish)")
    parts = [*([F.lit(DECLARATION)] if declare else []), F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0">'), *head, F.lit('<text xml:lang="es">'), F.lit("<body>"), F.coalesce("body", F.lit("<p>\n</p>")), F.lit("</body>"), F.lit("</text>"), F.lit("</TEI>")]
    return body.select("doc_id", F.concat_ws("\n", *parts).alias("tei"))


def tei_corpus_lines(docs: DataFrame, view: DataFrame, enriched: DataFrame) -> DataFrame:
    """ord, line: the corpus around its documents, which carry no declaration of their own. A file is
    written from the ordered rows; the corpus is never one value."""
    each = tei_documents(docs, view, enriched, declare=False).select(F.lit(1).alias("part"), "doc_id", F.col("tei").alias("line"))
    one = docs.sparkSession.range(1)
    head = one.select(F.lit(0).alias("part"), F.concat_ws("\n", F.lit(DECLARATION), F.lit('<teiCorpus xmlns="http://www.tei-c.org/ns/1.0">'), *_header(F.lit(f"{NAME} Corpus"), "teiCorpus", "Multi-document analysis (Spanish)")).alias("line"))
    tail = one.select(F.lit(2).alias("part"), F.lit("</teiCorpus>").alias("line"))
    return each.unionByName(head, allowMissingColumns=True).unionByName(tail, allowMissingColumns=True).select("part", "doc_id", "line")


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Text files whose lines, file by file, are in order."""
    lines.orderBy(*order).select("line").write.text(path)


def reports(docs: DataFrame, totals: DataFrame, top: DataFrame, relevance: DataFrame, comms: DataFrame, bigrams: DataFrame, trigrams: DataFrame) -> DataFrame:
    """doc_id, report: a Markdown report for each of docs (doc_id, label).

    totals: doc_id, words, content; top: doc_id, lemma, freq, rank; bigrams, trigrams: doc_id, gram, freq, rank.
    """
    one = fixed(1)
    rows = top.join(relevance, ["doc_id", "lemma"], "left").withColumn("r", one(F.coalesce("rel", F.lit(0.0))))
    words = _lines(rows.filter("rank <= 25").select("doc_id", "rank", F.concat(F.col("rank").cast("string"), F.lit(". **"), "lemma", F.lit("** — frec: "), F.col("freq").cast("string"), F.lit(", relev: "), "r").alias("line")), ["rank"])
    named = comms.join(top.select("doc_id", "lemma", "rank"), ["doc_id", "lemma"])
    place = F.row_number().over(Window.partitionBy("doc_id", "comm").orderBy("rank"))
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "comm"))
    members = named.withColumn("place", place).withColumn("size", size).filter("place <= 15").groupBy("doc_id", "comm", "size").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "lemma"))), lambda x: x["lemma"]), ", ").alias("m"))
    line = F.concat(F.lit("- **Comunidad "), F.col("comm").cast("string"), F.lit("** ("), F.col("size").cast("string"), F.lit("): "), "m", F.when(F.col("size") > 15, "...").otherwise(""))
    groups = _lines(members.select("doc_id", "comm", line.alias("line")), ["comm"])
    grams = lambda g, k: _lines(g.filter(F.col("rank") <= k).select("doc_id", "rank", F.concat(F.lit("- "), "gram", F.lit(" ("), F.col("freq").cast("string"), F.lit(")")).alias("line")), ["rank"])
    out = docs.select("doc_id", "label").join(totals, "doc_id", "left").join(top.groupBy("doc_id").agg(F.count(F.lit(1)).alias("top_n")), "doc_id", "left")
    for name, part in (("b_words", words), ("b_groups", groups), ("b_two", grams(bigrams, 15)), ("b_three", grams(trigrams, 10))):
        out = out.join(part.withColumnRenamed("body", name), "doc_id", "left")
    number = lambda c: F.format_number(F.coalesce(c, F.lit(0)), 0)
    section = lambda title, c, always=False: F.when(F.lit(always) | F.col(c).isNotNull(), F.concat_ws("\n", F.lit(f"## {title}"), F.lit(""), F.col(c), F.lit("")))
    text = F.concat_ws(
        "\n",
        F.lit("# Informe de análisis"), F.lit(""), F.concat(F.lit("**Documento:** "), "label"), F.concat(F.lit("**Tokens totales:** "), number("words")),
        F.concat(F.lit("**Palabras de contenido:** "), number("content")), F.concat(F.lit("**Top N:** "), F.coalesce("top_n", F.lit(0)).cast("string")), F.lit(""),
        section("Palabras más frecuentes", "b_words", True), section("Comunidades (Louvain)", "b_groups", True), section("Bigramas principales", "b_two"), section("Trigramas principales", "b_three"),
        F.lit("---"), F.lit(f"*Generado por {NAME}*"),
    )
    return out.select("doc_id", text.alias("report"))
