"""Plans whose work must grow no faster than their input: where rows go, and what is shuffled."""

import random
import re
from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

from hilandera.operators import segments, stats
from hilandera.operators import tokens as tok
from hilandera.operators.tokens import Assets
from hilandera.plans import analysis, outputs, queries
from hilandera.sources import exports


@contextmanager
def plain_plans(spark):
    """Without broadcasts and changes of the plan at run time, as tables of any size are planned."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def lexicon(spark):
    return Assets(
        pos=spark.createDataFrame([("casas", "n"), ("bajo", "a")], "word string, pos string"),
        lemma=spark.createDataFrame([("casas", "casa"), ("bajo#a", "bajo"), ("bajo", "bajar")], "key string, lemma string"),
    )


def test_tokens_that_are_no_words_do_not_meet_in_one_task(spark):
    docs = spark.createDataFrame([(i, "casas ¡bajo! . , ; : luz " * 20) for i in range(40)], "doc_id long, text string")
    with plain_plans(spark):
        others = tok.annotate(tok.tokenize(docs), lexicon(spark)).filter("type <> 'w'")
        parts = [r["count"] for r in others.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(parts) < 0.5 * sum(parts)


def test_lemmas_by_part_of_speech_from_one_lexicon_of_words(spark):
    rows = [("a#b", "n"), ("a#b", "v"), ("x", "n"), ("y", "v"), ("z", "r"), ("z", "x")]
    keys = [("a#b#n", "one"), ("a#b", "two"), ("x#v", "three"), ("y#v", "four"), ("y", "five"), ("z#x", "six")]
    words, lemma = spark.createDataFrame(rows, "w string, tag string"), spark.createDataFrame(keys, "key string, lemma string")
    found = dict(keys)
    want = sorted((w, t, found.get(f"{w}#{t}", found.get(w, w))) for w, t in rows)
    assert sorted(tuple(r) for r in tok.lemmatize(words, "w", "tag", Assets(lemma=lemma)).collect()) == want


def test_what_runs_along_documents_shuffles_texts_alone(spark):
    docs = spark.createDataFrame([(1, "casas bajo luz"), (2, "luz")], "doc_id long, text string")
    with plain_plans(spark):
        counts = stats.frequencies(tok.content(tok.annotate(tok.tokenize(docs))))
        assert exchanges(counts) == 1


def test_enriched_words_stay_with_their_document(spark):
    docs = spark.createDataFrame([(1, "casas bajo luz"), (2, "luz")], "doc_id long, text string")
    with plain_plans(spark):
        annotated = tok.by_document(tok.annotate(tok.tokenize(docs), lexicon(spark)))
        freqs = stats.frequencies(tok.content(annotated))
        known = freqs.select("doc_id", "lemma", "freq", F.lit(2.0).alias("rel"), F.lit(1).alias("comm"))
        words = tok.enrich(annotated, known, known.filter("doc_id = 2"), known.filter("doc_id = 1"), lexicon(spark))
        assert exchanges(words.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))) == exchanges(words)
        got = sorted((r.doc_id, r.lemma, r.freq, r.rel, r.comm) for r in words.collect())
    assert got == [(1, "bajo", 0, 0.0, -1), (1, "casa", 1, 0.0, 1), (1, "luz", 1, 0.0, 1), (2, "luz", 1, 2.0, -1)]


def test_pairs_of_alike_words_are_not_shuffled(spark):
    words = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "doc_id long, word string, rank long")
    counts = spark.createDataFrame([(1, 0, "a", 2, 0.5), (1, 1, "c", 4, 1.0), (1, 1, "d", 1, 0.1), (1, 1, "zero", 9, 1.0)], "doc_id long, seg long, word string, freq long, norm_freq double")
    every = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, seg long")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [1.0, 1.0]), ("d", [2.0, 0.0]), ("b", [0.0, 1.0]), ("zero", [0.0, 0.0])], "word string, vec array<float>")
    with plain_plans(spark):
        grid = segments.word_grid(words, every, counts, vectors=vectors)
        lines = grid._jdf.queryExecution().executedPlan().toString().splitlines()
        # the grid's joins take four, vectors by word four, words by document two, the finished loans one
        assert sum("Exchange hashpartitioning" in x for x in lines) <= 11
        got = {(r.seg, r.word): round(r.freq, 6) for r in grid.collect()}
    assert got == {(0, "a"): 2.0, (1, "a"): round(4 * 0.5**0.5 * 0.5, 6), (0, "b"): 0.0, (1, "b"): round(4 * 0.5**0.5 * 0.5, 6)}


def test_what_later_plans_hold_is_cut_from_what_made_it(spark):
    docs = spark.createDataFrame([(1, "casas luz mar luz"), (2, "luz")], "doc_id long, text string")
    first, second = analysis.analyze(docs)
    for made in (first.communities, second.relevance):
        assert "InMemoryRelation" not in made._jdf.queryExecution().executedPlan().toString()


def _kept(spark):
    """Annotated words that lie by document, their counts, and lexicons of words and lemmas."""
    docs = spark.createDataFrame([(1, "casas bajo no luz, luz"), (2, "luz")], "doc_id long, text string")
    tones = Assets(**lexicon(spark).__dict__ | {"vad": spark.createDataFrame([("luz", 1.0, 0.25, 0.5)], "lemma string, v double, a double, d double")})
    annotated = tok.by_document(tok.annotate(tok.tokenize(docs), tones))
    return annotated, stats.frequencies(tok.content(annotated)), tones


def _enriched(annotated, freqs, tones):
    return tok.enrich(annotated, freqs, freqs.select("doc_id", "lemma", F.lit(2.0).alias("rel")), freqs.filter("lemma = 'casa'").select("doc_id", "lemma", F.lit(1).alias("comm")), tones)


def test_words_meet_what_is_known_of_their_lemma_in_their_document(spark):
    with plain_plans(spark):
        annotated, freqs, tones = _kept(spark)
        words = _enriched(annotated, freqs, tones)
        # words are neither dealt out by document and lemma nor by lemma; lemmas of a document are
        plan = words._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(doc_id#\d+L?, lemma#", plan)
        got = sorted((r.doc_id, r.pos, r.lemma, r.freq, r.rel, r.comm, r.polarity) for r in words.collect())
    none = (0, 0.0, -1, None)
    assert got == [(1, 0, "casa", 1, 2.0, 1, None), (1, 2, "bajo", *none), (1, 4, "no", *none), (1, 6, "luz", 2, 2.0, -1, -1.0), (1, 9, "luz", 2, 2.0, -1, -1.0), (2, 0, "luz", 1, 2.0, -1, 1.0)]


def test_exported_words_are_not_shuffled_by_place(spark):
    with plain_plans(spark):
        annotated, freqs, tones = _kept(spark)
        lines = exports.tei_tokens(tok.weave_view(annotated), _enriched(annotated, freqs, tones))
        # the view and the words meet where their document lies
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(doc_id#\d+L?, pos#", plan)
        got = [r.line for r in lines.filter("doc_id = 1").orderBy("ord").collect()]
    assert [x if len(x) < 9 else x.split('"')[1] for x in got] == ["casa", " ", "bajo", " ", "no", " ", "luz", ",", " ", "luz"]


def test_selected_words_are_found_once(spark):
    # the grid, its maxima and its places read the words; none ranks them anew
    plan = outputs.layout_by_relevance(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collate(" not in plan


def test_the_segment_view_reads_no_tones_and_finds_no_communities(spark, monkeypatch):
    # its grid and clusters follow from stage 1's counts and relevance alone
    monkeypatch.setattr(queries, "_ANALYSIS", {})
    plan = queries.segment_view(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "polarity" not in plan and "emotions" not in plan and "comm#" not in plan
    assert not queries._ANALYSIS


def test_loans_equal_plain_loops_and_need_no_join_of_pairs(spark, monkeypatch):
    rng = random.Random(4)
    vec = {f"w{i}": [rng.uniform(-1, 1) for _ in range(3 if i % 5 else 4)] for i in range(40)}
    counts = [(d, s, w, rng.randint(1, 9), rng.random()) for d in (1, 2) for s in range(4) for w in rng.sample(sorted(vec), 25)] + [(3, 0, "w1", 1, 1.0)]
    words = [(d, w) for d in (1, 2, 4) for w in rng.sample(sorted(vec), 6)] + [(1, "none")]
    best = {}
    for d, a in words:
        for e, s, b, n, share in counts:
            if d == e and a in vec and len(vec[a]) == len(vec[b]):
                norm = lambda v: sum(x * x for x in v) ** 0.5
                sim = sum(x * y for x, y in zip(vec[a], vec[b], strict=True)) / (norm(vec[a]) * norm(vec[b]))
                if sim > 0.4:
                    best[d, s, a] = max(best.get((d, s, a), (0, 0)), (sim * n * 0.5, sim * share * 0.5))
    args = spark.createDataFrame(words, "doc_id long, word string"), spark.createDataFrame(counts, "doc_id long, seg long, word string, freq long, norm_freq double"), spark.createDataFrame(list(vec.items()), "word string, vec array<double>")
    for most in (segments.PAIRS, 20):
        monkeypatch.setattr(segments, "PAIRS", most)
        found = segments.loans(*args)
        got = {(r.doc_id, r.seg, r.word): (r.boost, r.norm_boost) for r in found.collect()}
        assert got.keys() == best.keys() and all(abs(x - y) < 1e-12 for k in got for x, y in zip(got[k], best[k], strict=True))
    # pairs of words are rows of no plan
    assert "zip_with" not in found._jdf.queryExecution().executedPlan().toString() and "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
