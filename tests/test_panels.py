import pytest

from hilandera.operators import panels, vectors


def test_panel_orders(spark):
    words = spark.createDataFrame([(1, "zeta", 2, 1.0), (1, "árbol", 2, 3.0), (1, "casa", 5, 1.0), (1, "nube", 5, 1.0)], "doc_id int, word string, freq long, rel double")
    order = lambda sort: [r.word for r in panels.word_panel(words, sort).orderBy("place").collect()]
    assert order("alpha") == ["árbol", "casa", "nube", "zeta"]
    assert order("relevance") == ["árbol", "casa", "nube", "zeta"]
    assert order("freq") == ["casa", "nube", "árbol", "zeta"]


def test_seeds_are_trimmed_lowered_and_known(spark):
    freqs = spark.createDataFrame([(1, "casa"), (2, "casa"), (2, "luz")], "doc_id int, lemma string")
    entries = spark.createDataFrame([(1, "  Casa "), (2, "casa"), (3, "sol"), (4, "LUZ"), (5, None)], "ord int, entry string")
    assert sorted(map(tuple, panels.enter_seeds(entries, freqs).collect())) == [(1, 1, "casa"), (2, 1, "casa"), (2, 4, "luz")]


def test_toggling(spark):
    chosen = spark.createDataFrame([], "ord int, doc string")
    held = lambda df: [r.doc for r in df.orderBy("ord").collect()]
    for value, after in [("a", ["a"]), ("b", ["a", "b"]), ("c", ["a", "b", "c"]), ("d", ["a", "b", "c"]), ("b", ["a", "c"]), ("d", ["a", "c", "d"])]:
        chosen = spark.createDataFrame(panels.toggled(chosen, "doc", value, panels.MOST_DOCUMENTS).collect(), "ord int, doc string")
        assert held(chosen) == after


@pytest.mark.parametrize("rows", [2000, 2])
def test_nearest_of_equal_vectors_are_the_smallest_words(spark, monkeypatch, rows):
    monkeypatch.setattr(vectors, "QUERY_ROWS", rows)
    held = spark.createDataFrame([(i, [1.0, 1.0] if i % 2 else [1.0, float(i)]) for i in reversed(range(200))], "word long, vec array<double>").coalesce(1)
    found = vectors.most_similar(spark.createDataFrame([(i,) for i in (3, 5, 9, 11, 13)], "word long"), held, 4).collect()
    for q in (3, 5, 9, 11, 13):
        assert [r.other for r in sorted(found, key=lambda r: r["rank"]) if r.word == q] == [i for i in range(1, 20, 2) if i != q][:4]
