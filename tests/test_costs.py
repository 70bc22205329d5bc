"""Work of sinks and communities that must not be done for each row or through a frame for each document."""

import random

import pandas as pd

from hilandera.functions import text
from hilandera.operators import stats
from hilandera.sources import texts
from tests.test_clusters import plain_communities


def test_a_number_is_written_once_for_all_its_rows(spark, monkeypatch):
    made, plain = [], text.Decimal

    def counted(x):
        made.append(x)
        return plain(x)

    write = text.fixed(4).func
    monkeypatch.setattr(text, "Decimal", counted)
    values = pd.Series([0.000051, None, -0.0, 0.125, 12345.5, -0.000051, 0.0, float("nan")] * 100)
    got = write(values).tolist()
    assert got[:4] == ["0.0001", None, "0.0000", "0.1250"] and got[5:8] == ["-0.0001", "0.0000", None] and got == got[:8] * 100
    assert len(made) <= 6
    assert write(pd.Series([None, None], dtype=float)).tolist() == [None, None] and write(pd.Series([], dtype=float)).tolist() == []


def test_communities_go_through_arrow_and_equal_plain_loops_on_many_words(spark):
    rng = random.Random(3)
    top, pairs, want = [], [], {}
    for d in ("x", "y", "z"):
        n = 100
        weight = [[0] * n for _ in range(n)]
        for i in range(n):
            for j in range(i):
                if rng.random() < 0.2:
                    weight[i][j] = weight[j][i] = rng.choice([1, 2, 4, 8])
        top += [(d, f"w{i}", i + 1) for i in range(n)]
        pairs += [(d, f"w{i}", f"w{j}", weight[i][j]) for i in range(n) for j in range(n) if weight[i][j]]
        want |= {(d, f"w{i}"): c for i, c in enumerate(plain_communities(n, weight))}
    got = stats.communities(spark.createDataFrame([*top, ("alone", "w", 1)], "doc_id string, lemma string, rank long"), spark.createDataFrame(pairs, "doc_id string, a string, b string, n long"))
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.lemma): r.comm for r in got.collect()} == want | {("alone", "w"): 0}


def test_tei_is_read_row_by_row_and_names_are_looked_up_in_order(spark):
    two = '<c xmlns:a="u" xmlns:b="v"><a:TEI><titleStmt><b:title>t<q>u</q></b:title></titleStmt><b:body><a:p>1</a:p><p>2</p><b:p>3 <w>d</w></b:p></b:body></a:TEI><TEI><body><p>z</p></body></TEI></c>'
    got = texts.import_tei(spark.createDataFrame([(1, two), (2, None)], "doc_id int, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "InPandas" not in plan
    rows = {(r.doc_id, r.part): (r.label, r.text) for r in got.collect()}
    assert rows == {(1, 0): ("tu", "1\n\n2\n\n3 d"), (1, 1): ("Documento 2", "z"), (2, 0): (None, None)}
