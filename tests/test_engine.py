"""Operators on small inputs with results worked out by hand."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions import colour
from hilandera.functions.text import clamped, csv_field, fixed, xml_escaped
from hilandera.operators import graph, layout, segments, stats, vectors, weave
from hilandera.operators import tokens as tok
from hilandera.operators.tokens import Assets
from hilandera.plans import analysis
from hilandera.sources import assets as sources
from hilandera.sources import exports, texts


def docs(spark, *items):
    return spark.createDataFrame([(i, f"D{i}", t) for i, t in enumerate(items)], "doc_id long, label string, text string")


def content(spark, *items):
    return tok.content(tok.annotate(tok.tokenize(docs(spark, *items))))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tokens(spark):
    text = "El niño no-sé, dijo: —¡hola!\n\nFin - 2020 ‘x’ “y” façade z\n \nw"
    t = tok.tokenize(docs(spark, text)).orderBy("pos").collect()
    assert "".join(r.raw for r in t) == text.translate(str.maketrans("‘’“”", "''\"\""))
    assert [r.raw for r in t if r.type == "w"] == ["El", "niño", "no-sé", "dijo", "hola", "Fin", "-", "2020", "'x'", "y", "fa", "ade", "z", "w"]
    assert [r.raw for r in t if r.type == "p"] == ["\n\n"] and {r.para for r in t} == {0, 1}
    assert [r.para for r in t if r.type == "p"] == [1]
    assert next(r.type for r in t if r.raw == " ") == "s" and next(r.type for r in t if r.raw == "ç") == "x"


def test_tags_lemmas_and_stops(spark):
    lexicon = Assets(
        pos=spark.createDataFrame([("casas", "n"), ("bajo", "a")], "word string, pos string"),
        lemma=spark.createDataFrame([("casas", "casa"), ("bajo#a", "bajo"), ("bajo", "bajar"), ("fue", "ir")], "key string, lemma string"),
    )
    a = tok.annotate(tok.tokenize(docs(spark, "Casas bajo fue lentamente dad ar constructor nunca cantando")), lexicon).filter("type = 'w'")
    got = {r.surface: (r.tag, r.lemma, r.stop, r.neg) for r in a.collect()}
    assert got["Casas"] == ("n", "casa", False, False) and got["bajo"][:3] == ("a", "bajo", True)
    assert got["fue"][1:3] == ("ir", True) and got["lentamente"][0] == "r" and got["dad"][0] == "n" and got["ar"][0] == "n"
    assert got["nunca"][2:] == (True, True) and got["cantando"][0] == "v" and got["constructor"][1] == "constructor"
    assert "ni siquiera" not in C.NEGATION and len(C.STOP_WORDS) == 238


def test_counts_and_ties(spark):
    f = stats.frequencies(content(spark, "casa luz 10 2 casa luz 10 2"))
    assert [r.lemma for r in f.orderBy("rank").collect()] == ["2", "10", "casa", "luz"]
    assert {r.rel_freq for r in f.collect()} == {0.25}
    g = stats.top_ngrams(content(spark, "uva el pan\n\nuva pan sol"), 2)
    assert [(r.gram, r.freq) for r in g.orderBy("rank").collect()] == [("uva pan", 2), ("pan uva", 1), ("pan sol", 1)]
    assert stats.top_ngrams(content(spark, "uva"), 3).count() == 0


def test_cooccurrence(spark):
    pairs = {(r.a, r.b): r.n for r in stats.cooccurrence(content(spark, "luz mar luz pez"), window=2).collect()}
    assert pairs == {("luz", "luz"): 2, ("luz", "mar"): 2, ("mar", "luz"): 2, ("mar", "pez"): 1, ("pez", "mar"): 1, ("luz", "pez"): 1, ("pez", "luz"): 1}
    few = spark.createDataFrame([(0, "mar"), (0, "pez")], "doc_id long, lemma string")
    assert stats.cooccurrence(content(spark, "luz mar luz pez"), few, 2).count() == 2


def test_communities(spark):
    top = spark.createDataFrame([(0, w, i + 1) for i, w in enumerate("abcxyz")], "doc_id long, lemma string, rank long")
    links = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]
    both = [(0, p, q, 3) for p, q in links] + [(0, q, p, 3) for p, q in links] + [(0, "c", "x", 1), (0, "x", "c", 1), (0, "a", "a", 9)]
    pairs = spark.createDataFrame(both, "doc_id long, a string, b string, n long")
    assert {r.lemma: r.comm for r in stats.communities(top, pairs).collect()} == dict(zip("abcxyz", (0, 0, 0, 1, 1, 1), strict=True))
    assert {r.comm for r in stats.communities(top, pairs.limit(0)).collect()} == {0}


def test_negation_scope(spark):
    vad = spark.createDataFrame([(w, 1.0, 0.5, 0.5) for w in ("feliz", "triste", "alegre", "casa", "luz")] + [("cero", 0.5, 0.1, 0.1)], "lemma string, v double, a double, d double")
    a = tok.annotate(tok.tokenize(docs(spark, "no muy bueno feliz triste alegre casa", "no luz nunca raro triste cero casa")))
    t = tok.negate(tok.add_sentiment(a.filter("type = 'w'"), Assets(vad=vad)))
    got = {(r.doc_id, r.surface): r.polarity for r in t.collect()}
    assert [got[0, w] for w in ("feliz", "triste", "alegre", "casa")] == [-1, -1, -1, 1]
    assert [got[1, w] for w in ("luz", "raro", "triste", "casa")] == [-1, None, -1, 1] and str(got[1, "cero"]) == "0.0"
    assert not tok.add_sentiment(a, Assets()).filter("has or polarity is not null").count()


def test_payload_fallback(spark):
    swn = spark.createDataFrame([("luz", "v", "pv"), ("luz", "r", "pr")], "lemma string, pos string, payload string")
    w = spark.createDataFrame([("luz", "r"), ("luz", "n"), ("mar", "n")], "lemma string, tag string")
    assert rows(tok.add_sentiment(w, Assets(swn=swn)).fillna("-", ["payload"]), "lemma", "tag", "payload") == [("luz", "n", "pv"), ("luz", "r", "pr"), ("mar", "n", "-")]


@pytest.mark.parametrize(("n", "sizes"), [(0, {}), (5, {0: 1, 1: 1, 2: 1, 3: 1, 4: 1}), (10, {i: 1 for i in range(10)}), (23, {i: 2 for i in range(9)} | {9: 5})])
def test_equal_segments(spark, n, sizes):
    c = content(spark, " ".join(f"w{i}x" for i in range(n)))
    assert {r.seg: r["count"] for r in segments.equal_segments(c).groupBy("seg").count().collect()} == sizes
    assert segments.all_segments(docs(spark, "x")).count() == 10


def test_custom_segments(spark):
    d = docs(spark, "intro pez ---SEG: Uno ---\nluz luz mar---SEG:Dos---   ---SEG:Tres---sol")
    parts = texts.split_segments(d)
    assert rows(parts, "part", "label", "text") == [(0, C.PREAMBLE, "intro pez"), (1, "Uno", "luz luz mar"), (3, "Tres", "sol")]
    each = parts.selectExpr("doc_id * 100 + part as doc_id", "text")
    words = tok.content(tok.annotate(tok.tokenize(each))).selectExpr("cast(floor(doc_id / 100) as bigint) as doc_id", "doc_id % 100 as part", "lemma")
    bounds = segments.bounds_of(parts, words)
    assert rows(bounds, "seg", "start_token", "end_token") == [(0, 0, 2), (1, 2, 5), (3, 5, 6)]
    cut = segments.custom_segments(tok.content(tok.annotate(tok.tokenize(texts.without_segment_markers(d)))), bounds)
    assert rows(segments.segment_counts(cut), "seg", "word", "freq") == [(0, "intro", 1), (0, "pez", 1), (1, "luz", 2), (1, "mar", 1), (3, "sol", 1)]
    assert rows(layout.segment_names(bounds), "name") == [("S1",), ("S2",), ("S4",)]


def test_document_markers(spark):
    d = docs(spark, "intro ---DOC:A--- uno ---DOC: B ---  dos\n", "---DOC:A--- solo", "x ---DOC:A--- ---DOC:B--- y")
    assert rows(texts.split_documents(d), "doc_id", "part", "label", "text") == [(0, 1, "A", "uno"), (0, 2, "B", "dos"), (2, 2, "B", "y")]


def test_document_set(spark):
    d = docs(spark, "a", "b")
    assert texts.add_document(d, 7, "n", "t").count() == 3
    assert rows(texts.remove_document(d, 0), "doc_id") == [(1,)]
    assert texts.remove_document(texts.remove_document(d, 0), 1).count() == 1
    assert rows(texts.update_document(d, 1, text="z", label="L"), "label", "text") == [("D0", "a"), ("L", "z")]


def word_graph(spark):
    """perro -> animal -> ser (not in the corpus) -> ente; a cycle gato <-> felino; rabo part of perro."""
    e = [("perro", "hypernyms", 0, "animal"), ("animal", "hypernyms", 0, "serx"), ("serx", "hypernyms", 0, "entex"), ("gato", "hypernyms", 0, "felino"), ("felino", "hypernyms", 0, "gato"), ("perro", "meronyms", 0, "rabo"), ("animal", "hyponyms", 0, "gato"), ("perro", "hyponyms", 0, "rabo")]
    return Assets(edges=spark.createDataFrame([(s, "n", r, o, t) for s, r, o, t in e], "src string, pos string, rel string, ord int, dst string"))


def freqs(spark):
    return spark.createDataFrame([(0, w, n) for w, n in (("perro", 3), ("animal", 2), ("entex", 1), ("gato", 4), ("felino", 1), ("rabo", 1))], "doc_id long, lemma string, freq long")


def test_activation(spark):
    f, g = freqs(spark), word_graph(spark)
    got = {r.lemma: r.rel for r in graph.spread_activation(f, g, 2).collect()}
    # gato: from animal and felino at one hop, from perro at two; entex: two hops from animal, through a word outside
    assert got == {"perro": 1, "animal": 1.5, "entex": 1.25, "gato": 2.25, "felino": 1.75, "rabo": 1.5}
    assert {r.lemma: r.rel for r in graph.spread_activation(f, g, 1, 0.5, "up").collect()}["rabo"] == 1
    assert {r.rel for r in graph.spread_activation(f, Assets()).collect()} == {1.0}
    terms = spark.createDataFrame([(0, "perro")], "doc_id long, word string")
    assert rows(graph.pair_activation(f, terms, g), "target", "score") == [("animal", 1.5), ("gato", 0.75), ("rabo", 1.5)]
    pairs = spark.createDataFrame([("perro", "entex"), ("entex", "perro"), ("gato", "gato")], "a string, b string")
    assert rows(graph.distances(pairs, g, 3), "a", "b", "d") == [("entex", "perro", -1), ("gato", "gato", 0), ("perro", "entex", 3)]
    assert rows(graph.distances(pairs, g, 2), "d") == [(-1,), (-1,), (0,)]


def test_expansion_and_weave(spark):
    f, g = freqs(spark), word_graph(spark)
    seeds = spark.createDataFrame([(1, "perro"), (2, "nadar")], "ord int, word string")
    found = graph.expand_seeds(seeds, f, g, 3)
    assert rows(found, "word", "rel", "dist") == [("animal", "hyp↑", 1), ("entex", "hyp↑", 3), ("felino", "hyp↑", 3), ("gato", "hyp↓", 2), ("rabo", "hyp↓", 1)]
    terms = weave.terms_of(seeds, found, f)
    assert [r.word for r in terms.orderBy("rank").collect()] == ["perro", "animal", "rabo", "gato", "entex", "felino"]
    c = spark.createDataFrame([(0, i, w) for i, w in enumerate(["perro", "animal", "perro", "gato"])], "doc_id long, cpos long, lemma string")
    cells = {(r.a, r.b): (r.cooc, r.activ, r.prox) for r in weave.cells(c, terms, f, g).collect()}
    assert len(cells) == 36 and cells["perro", "perro"] == (2, 0, 1) and cells["animal", "perro"] == (2, 1.5, 0) and cells["perro", "animal"] == (2, 1.5, 0.5)
    two = weave.cells(c, terms, f, g)
    assert {(r.a, r.b): r.docs for r in weave.stack(two).collect()}["perro", "animal"] == 1
    assert weave.cell_maxima(two).first().max_cooc == 2
    other = spark.createDataFrame([(1, "perro", "gato", "mer", 1, 1)], "doc_id long, seed string, word string, rel string, dist int, rank long")
    assert ("gato", "mer", 1) in rows(weave.union_terms(terms.unionByName(other)), "word", "rel", "dist")


def test_passages(spark):
    words = [f"w{i}" for i in range(40)]
    words[10], words[12], words[30] = "sol", "mar", "sol"
    w = spark.createDataFrame([(0, i, x, x, False) for i, x in enumerate(words)], "doc_id long, i long, surface string, lemma string, stop boolean")
    (p,) = weave.passages(w, "sol", "mar").collect()
    assert (p.rank, p.start, p.end) == (1, 2, 21) and p.passage.split()[0] == "w2"


def vecs(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "word string, vec array<float>")


def test_vectors(spark):
    v = vecs(spark)
    pairs = spark.createDataFrame([("a", "a"), ("a", "c"), ("a", "z"), ("a", "none")], "a string, b string")
    assert rows(vectors.similarities(pairs, v), "b", "sim") == [("a", 1.0), ("c", 0.0), ("none", 0.0), ("z", 0.0)]
    q = spark.createDataFrame([("a",), ("none",)], "word string")
    assert [(r.other, r.rank) for r in vectors.most_similar(q, v, 2).orderBy("rank").collect()] == [("b", 1), ("c", 2)]
    words = spark.createDataFrame([(0, w, i + 1) for i, w in enumerate(["a", "b", "c", "n"])], "doc_id long, word string, rank long")
    assert {r.word: r.cluster for r in vectors.clusters(words, v, 2).collect()} == {"a": 0, "b": 0, "c": 1, "n": 0}
    assert {r.word: r.cluster for r in vectors.clusters(words, v.limit(0), 3).collect()} == {"a": 0, "b": 1, "c": 2, "n": 0}
    assert {r.cluster for r in vectors.clusters(words, None).collect()} == {0}
    seen = spark.createDataFrame([(0, 0, "a", True), (0, 1, "a", False), (0, 0, "b", False), (0, 1, "b", True), (0, 0, "c", False), (0, 1, "c", True)], "doc_id long, col long, word string, is_real boolean")
    assert rows(vectors.cross_links(seen, v), "src", "dst", "col") == [("a", "b", 0)]


def test_selection_and_grid(spark):
    f = spark.createDataFrame([(0, "ñu", 2), (0, "nube", 2), (0, "zar", 3), (0, "x", 9)], "doc_id long, word string, freq long")
    rel = spark.createDataFrame([(0, "ñu", 2.0), (0, "zar", 0.0)], "doc_id long, lemma string, rel double")
    order = lambda df: [r.word for r in df.orderBy("rank").collect()]
    assert order(stats.select_words(f, None)) == ["zar", "nube", "ñu"] and order(stats.select_words(f, rel, "relevance")) == ["ñu", "zar", "nube"]
    assert order(stats.select_words(f, rel)) == ["zar", "ñu", "nube"]
    seeds = spark.createDataFrame([(1, "x"), (2, "otra"), (3, "zar")], "ord int, word string")
    assert order(stats.select_seeds(f, seeds)) == ["x", "zar"]
    counts = spark.createDataFrame([(0, 0, "a", 2, 1.0), (0, 1, "b", 4, 0.5), (0, 1, "c", 4, 0.5)], "doc_id long, seg long, word string, freq long, norm_freq double")
    words = spark.createDataFrame([(0, "a", 2, 1.0, 1)], "doc_id long, word string, freq long, rel double, rank long")
    every = spark.createDataFrame([(0, s) for s in range(3)], "doc_id long, seg long")
    grid = {r.seg: (r.freq, r.norm_freq, r.rel) for r in segments.word_grid(words, every, counts, None, vecs(spark)).collect()}
    sim = 1 / np.sqrt(1.01)
    assert grid[0] == (2, 1, 1) and grid[2] == (0, 0, 0) and np.allclose(grid[1], (sim * 2, sim * 0.25, sim * 0.25), rtol=1e-6)
    assert segments.grid_maxima(segments.word_grid(words, every, counts), words).first()[1:] == (2, 1, 2, 1, 1)
    assert rows(segments.persistent(words, counts), "word") == []


def test_layout(spark):
    view = layout.View(width=900, height=540, size=2, segments=3)
    assert [r.x for r in layout.columns(spark, view).orderBy("col").collect()] == [80, 880]
    assert layout.columns(spark, layout.View(segments=1)).first().x == 480
    grid = spark.createDataFrame([(0, s, w, f, f / 4, f / 4, f) for w, row in (("a", (4.0, 2.0, 1.0)), ("b", (0.0, 4.0, 0.0))) for s, f in enumerate(row)], "doc_id long, seg long, word string, freq double, norm_freq double, rel double, act double")
    words = spark.createDataFrame([(0, "a", 4, 1.0, 1), (0, "b", 4, 1.0, 2)], "doc_id long, word string, freq long, rel double, rank long")
    n = layout.nodes(grid, words, segments.grid_maxima(grid, words), view)
    base = (470 - 2) / 2
    got = {(r.word, r.col): r for r in n.collect()}
    assert len(got) == 4 and got["a", 0].h == base * 2 and got["a", 0].opacity == 1 and got["b", 0].h == got["b", 0].opacity == 0
    assert got["a", 1].opacity == 0.625 and got["b", 1].y == 20 + base + 2 + (base - 2 * base) / 2 and got["a", 0].x == 80 - 15
    assert rows(layout.links(n), "word", "src_col", "tgt_col") == [("a", 0, 1)] and rows(layout.labels(n), "word", "col") == [("a", 0), ("b", 1)]
    assert layout.hit(n, 80, 30).first().word == "a"
    assert rows(layout.word_colours(words, "rango"), "colour") == sorted([(C.PALETTE[0],), (C.PALETTE[1],)])


def test_colours(spark):
    one = lambda c: tuple(spark.range(1).select(c.alias("c")).first().c)
    assert one(colour.hex_to_rgb(F.lit("#888"))) == (136, 136, 136) and one(colour.hex_to_rgb(F.lit("#4ecdc4"))) == (78, 205, 196)
    hsl = colour.rgb_to_hsl(colour.hex_to_rgb(F.lit("#4ecdc4")))
    assert np.allclose(one(hsl), (175.7480315, 55.9471366, 55.4901961)) and one(colour.hsl_to_rgb(hsl)) == (78, 205, 196)
    assert one(colour.polarity_rgb(F.lit(1.0))) == (0x82, 0xE0, 0xAA) and one(colour.polarity_rgb(F.lit(0.01))) == (136, 136, 136)
    red, pink = (F.struct(F.lit(h).alias("h"), F.lit(50.0).alias("s"), F.lit(50.0).alias("l")) for h in (10.0, 350.0))
    assert one(colour.between_hsl(red, pink, F.lit(0.75)))[0] == 355


def test_formats(spark):
    d = spark.createDataFrame([(1.005, 0.03125, -0.0), (2.5, -0.00001, -1.5)], "a double, b double, c double")
    assert [tuple(r) for r in d.select(fixed(2)("a"), fixed(4)("b"), fixed(0)("c")).collect()] == [("1.00", "0.0313", "0"), ("2.50", "-0.0000", "-2")]
    s = spark.createDataFrame([('a"b',), ("a,b",), ("a\rb",), (None,)], "s string")
    assert [r[0] for r in s.select(csv_field("s")).collect()] == ['"a""b"', '"a,b"', "a\rb", ""]
    assert spark.createDataFrame([("<a & \"b\">",)], "s string").select(xml_escaped("s")).first()[0] == "&lt;a &amp; &quot;b&quot;&gt;"
    assert spark.range(1).select(clamped(F.lit(200), 10, 100)).first()[0] == 100
    assert analysis.Params(top_n=500, depth=9, decay=2.0, segments=1).clamped() == analysis.Params(100, 3, 0.9, "bi", 3)


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>T<hi>1</hi></title></titleStmt></teiHeader><text><body>
<p>uno <w lemma="x"><fs/>dos </w>, <hi>no</hi>tres</p><p>fin</p></body></text></TEI>"""


def test_tei_import(spark):
    d = docs(spark, TEI, "<TEI><body><p>a</p></body></TEI>", "<TEI>", "<a/>")
    got = {r.doc_id: r for r in texts.import_tei(d).collect()}
    assert (got[0].label, got[0].text) == ("T1", "uno dos, tres\n\nfin") and got[1].label == "Documento 1"
    assert got[2].error.startswith("XML") and got[3].error == "no TEI element"


def test_analysis_and_exports(spark, tmp_path):
    d = docs(spark, "Luz, mar y luz.\n\n  No sol \"x\" <b>", "")
    first, second = analysis.analyze(d)
    words = {r.surface: r for r in second.enriched.collect()}
    assert len(words) == 8 and words["luz"].freq == 2 and words["luz"].rel == 1 and words["y"].freq == 0 and words["y"].comm == -1
    assert rows(first.totals, "words", "content") == [(8, 6)]
    assert "".join(r.surface for r in second.view.filter("para = 1").orderBy("ord").collect()) == 'No sol "x" <b>'
    csv = exports.csv_documents(second.enriched).first().csv.split("\n")
    assert csv[0].count(",") == 16 and csv[1] == "Luz,luz,n,0,2,1.0000,,,0" + ",0" * 8
    tei = exports.tei_documents(d, second.view, second.enriched)
    (back,) = texts.import_tei(tei.filter("doc_id = 0").withColumnRenamed("tei", "text")).collect()
    assert back.label == "D0" and [t for t in back.text.replace("\n", " ").split() if t] == ["Luz", ",", "mar", "y", "luz", ".", "No", "sol", '"', "x", '"', "<", "b", ">"]
    exports.write_lines(exports.tei_corpus_lines(d, second.view, second.enriched), ["part", "doc_id"], f"file://{tmp_path}/corpus")
    whole = "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/corpus").collect())
    assert whole.count("<?xml") == 1 and whole.count("<TEI ") == 2
    report = exports.reports(d, first.totals, first.top, second.relevance, first.communities, first.bigrams, first.trigrams).filter("doc_id = 0").first().report
    assert "1. **luz** — frec: 2, relev: 1.0" in report and "**Tokens totales:** 8" in report and "- luz mar (1)" in report
    view = analysis.segment_view(second.enriched, first.freqs, second.relevance, Assets(vectors=vecs(spark)), analysis.Params(segments=3))
    assert view.grid.count() == 3 * view.words.count() and rows(view.tone, "polarity") == [(0.0,)] * 3
    dimmed = tok.dim_unselected(second.view, view.words.filter("word = 'luz'").selectExpr("doc_id", "word as lemma"))
    assert {r.surface for r in dimmed.filter("not stop").collect()} == {"Luz", "luz"}
    assert layout.reader_marks(second.enriched).filter("bold").count() == 6


def test_vectors_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "RANGE_BYTES", 100)
    (tmp_path / "vocab.json").write_text(json.dumps({"dim": 5, "dtype": "float32", "vocab": {f"w{i}": i for i in range(60)}}))
    raw = np.arange(300, dtype="<f4").tobytes()
    # the first vectors of the second and third file begin in the file before
    for k, (a, b) in enumerate(((0, 407), (407, 411), (411, 1200))):
        (tmp_path / f"v-{k}.bin").write_bytes(raw[a:b])
    got = sources.load_vectors(spark, f"file://{tmp_path}/vocab.json", f"file://{tmp_path}/v-*.bin")
    assert {r.word: r.vec for r in got.collect()} == {f"w{i}": [5.0 * i + k for k in range(5)] for i in range(60)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "splits=Some(12)" in plan and sources.load_vectors(spark, f"file://{tmp_path}/none.json", f"file://{tmp_path}/v-*.bin") is None


def test_assets_from_files(spark, tmp_path):
    for k in ("wordnet", "lexicons", "vectors"):
        (tmp_path / k).mkdir()
    write = lambda k, v: (tmp_path / sources.FILES[k]).write_text(json.dumps(v))
    write("pos", {"sol": "n"})
    write("edges", {"sol#n": {"hypernyms": ["astro", "luz"]}})
    write("vad", {"sol": {"v": 0.9, "a": 0.5, "d": 0.1}})
    write("emolex", {"sol": {"joy": 1, "fear": 0}})
    write("vocabulary", {"dim": 3, "dtype": "float16", "vocab": {"sol": 0, "mar": 1}})
    raw = struct.pack("<6e", 1, 2, 3, -0.5, 65504, 6e-8)
    (tmp_path / "vectors/vectors-0.bin").write_bytes(raw[:8])
    (tmp_path / "vectors/vectors-1.bin").write_bytes(raw[8:])
    a = sources.load_assets(spark, f"file://{tmp_path}")
    assert a.lemma is None and a.swn is None and rows(a.pos, "word", "pos") == [("sol", "n")]
    assert rows(a.edges, "src", "pos", "rel", "ord", "dst") == [("sol", "n", "hypernyms", 0, "astro"), ("sol", "n", "hypernyms", 1, "luz")]
    assert a.emolex.first().emotions == ["joy"] and a.vad.first().v == 0.9
    got = {r.word: r.vec for r in a.vectors.collect()}
    assert got["sol"] == [1, 2, 3] and np.allclose(got["mar"], np.array([-0.5, 65504, 6e-8], np.float16).astype(np.float32))


def test_stream(spark, tmp_path):
    from hilandera.streaming.tokens import annotate_stream

    docs(spark, "no muy claro", "Luz-mar ---SEG:x--- sol").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, label string, text string").parquet(f"file://{tmp_path}/in")
    q = annotate_stream(stream).writeStream.format("memory").queryName("words").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("words"), "surface", "stop", "neg") == [("Luz-mar", False, False), ("claro", True, False), ("muy", True, False), ("no", True, True), ("sol", False, False)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("uno\n\ndos")
    (r,) = texts.read_texts(spark, f"file://{tmp_path}").collect()
    assert (r.label, r.text) == ("a.txt", "uno\n\ndos")
