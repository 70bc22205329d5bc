from pyspark.sql import functions as F

from hilandera.operators import layout, reader
from hilandera.sources import assets

_WORDS = "doc_id int, pos long, surface string, lemma string, tag string, stop boolean, freq long, rel double, polarity double, arousal double, comm int, emotions array<string>"


def words(spark):
    rows = [
        (1, 0, "Casas", "casa", "n", False, 4, 1.25, 0.2, 0.5, 2, ["joy", "anger"]),
        (1, 2, "el", "el", "n", True, 0, 0.0, None, None, -1, None),
        (1, 4, "sol", "sol", "n", False, 2, 1.0, None, None, -1, None),
        (2, 0, "mal", "mal", "n", False, 1, 0.0, -0.0004, None, 0, ["trust"]),
    ]
    return spark.createDataFrame(rows, _WORDS)


def test_minimap_rows(spark):
    a, b, c = reader.minimap(words(spark)).orderBy("doc_id", "pos").collect()
    assert (a.y, a.height, a.strength, a.ink, a.ink_strength, a.dots) == (0, 50, 1.0, "#82e0aa", 0.5, ["#ff6b6b", "#82e0aa"])
    assert (b.y, b.height, b.strength, b.ink, b.ink_strength, b.dots) == (50, 50, 0.6000000000000001, None, None, [])
    assert (c.y, c.height, c.ink, c.dots) == (0, 100, "#888", ["#4ecdc4"])
    assert [reader.most_dots(w) for w in (2, 20, 60, 80)] == [1, 2, 5, 6]
    assert reader.minimap(words(spark).filter("stop")).count() == 0


def test_details(spark):
    a, b, c = reader.details(words(spark)).orderBy("doc_id", "pos").collect()
    assert (a.title, a.line, a.community, a.emotions) == ("Casas casa · n", "Frec: 4 · Rel: 1.3 · Pol: +0.200 · Act: 0.500", "Comunidad 2", "anger,joy")
    assert (b.line, b.community, b.emotions) == ("Frec: 2 · Rel: 1.0", None, "")
    assert c.line == "Frec: 1 · Rel: 0.0 · Pol: -0.000"


def test_lit_words(spark):
    some = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "word string")
    on = lambda *x: [r.word for r in reader.lit(some, *x).filter("lit").orderBy("word").collect()]
    assert on() == on(None, [], ["a"]) == ["a", "b", "c", "d"]
    assert on("b") == ["b"]
    assert on(None, ["c"], ["a"]) == ["a", "c"]


def test_stacks():
    assert reader.stacked([], 540) == []
    assert reader.stacked(["x"], 540) == [("x", 540)]
    assert reader.stacked(["x", "y"], 540, "overlay") == [("x", 540)]
    assert reader.stacked(["x", "y", "z", "w"], 1200) == [("x", 400), ("y", 400), ("z", 400)]
    assert reader.stacked(["x", "y"], 540) == [("x", 300), ("y", 300)]


def test_links_are_hit(spark):
    rows = [(1, "a", 0, k, 100.0 * k, 10.0 + 20 * k, 30.0, 5.0, k != 2) for k in range(4)] + [(1, "b", 1, k, 100.0 * k, 12.0, 30.0, 5.0, k > 1) for k in range(4)]
    of = spark.createDataFrame(rows, "doc_id int, word string, rank int, col int, x double, y double, w double, h double, is_real boolean")
    boxes = [tuple(r) for r in layout.link_boxes(of).orderBy("word").collect()]
    assert boxes == [(1, "a", 0, 0, 30.0, 100.0, 10.0, 35.0), (1, "b", 1, 2, 230.0, 300.0, 12.0, 17.0)]
    under = lambda x, y: [r.word for r in layout.hit(of, x, y).collect()]
    assert under(50, 20) == ["a"] and under(250, 15) == ["b"] and under(150, 15) == [] and under(310, 14) == ["b"]


def test_minimap_clicks(spark):
    starts = spark.range(0, 800, 100).select(layout.window_start(F.col("id"), 800.0, 20, 10)).collect()
    assert [r[0] for r in starts] == [0, 0, 0, 2, 5, 7, 10, 10]
    assert spark.range(1).select(layout.window_start(F.col("id") + 700, 800.0, 5, 10)).first()[0] == 0


def test_tables_by_key(spark, tmp_path):
    assert assets.get(spark, str(tmp_path), "k") is None
    for n in (3, 2):
        assert assets.put(spark.range(n), str(tmp_path), "k")
        assert assets.get(spark, str(tmp_path), "k").count() == n
