"""The driver's contract, with and without the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).parent.parent
SF = "/root/testdata/sf0.001"
SAMPLE = ["top_lemmas", "para_index", "bigrams", "cooc_topn", "negation_scope", "segment_ngrams", "spread_activation", "expand_seeds", "weave_cells", "find_passages", "layout_nodes", "doc_split", "most_similar", "turn_segments", "csv_communities", "tei_communities", "report_communities", "layout_by_relevance"]


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    theirs = sorted((tuple(r) for r in cursor.fetchall()), key=key)
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert len(ours) == len(theirs) and all(x == y for x, y in zip(ours, theirs, strict=True))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "rank", "lemma", "freq"]


def test_without_the_optional_part(tmp_path):
    shutil.copytree(REPO / "hilandera", tmp_path / "hilandera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'top_lemmas' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
