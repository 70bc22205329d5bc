import hashlib
import random
import zlib

import pytest

from hilandera.llm import periodic_runs
from hilandera.llm.queries import QUERIES

from .conftest import by_id

SF = "/root/testdata/sf0.001"


def every_run(words):
    """(start, length, period) by looking at each period."""
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((i, j - i, q) for (i, j), q in out.items())


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = every_run(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def random_words(rng):
    symbols, words = rng.choice([1, 2, 2, 3, 4]), []
    while len(words) < rng.randint(1, 90):
        kind = rng.random()
        if kind < 0.4 or not words:
            words += [rng.randrange(symbols) for _ in range(rng.randint(1, 4))]
        elif kind < 0.8:
            a = rng.randrange(len(words))
            words += words[a : rng.randint(a + 1, len(words))] * rng.randint(1, 6)
        else:
            words += [rng.randrange(symbols)] * rng.randint(1, 9)
    return words[:200]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(4000):
        words = random_words(rng)
        found = every_run(words)
        assert periodic_runs.runs_of(words) == found, words
        assert periodic_runs.find_runs(words) == found, words
        spaced = [w for x in words for w in (x, *([f"once{rng.random()}"] if rng.random() < 0.05 else []))]
        assert periodic_runs.find_runs(spaced) == every_run(spaced), spaced


def test_factors_are_longest_earlier_ones():
    rng = random.Random(6)
    for _ in range(300):
        words = random_words(rng)[:60]
        at = 0
        for start, end, source in periodic_runs.factors(words):
            assert start == at and end > start
            earlier = lambda n: any(words[j : j + n] == words[start : start + n] for j in range(start))  # noqa: B023, E731
            assert not earlier(end - start + 1) or end == len(words)
            assert source == -1 and end == start + 1 and not earlier(1) or source < start and words[source : source + end - start] == words[start:end]
            at = end
        assert at == len(words)


def test_long_texts_take_linear_time():
    a, b = [0], [0, 1]
    while len(b) < 150_000:
        a, b = b, b + a
    for words, least in ((["a", "b", "c"] * 50_000, 1), (["x"] * 150_000, 1), ([i % 1000 for i in range(150_000)], 1)):
        assert len(periodic_runs.find_runs(words)) == least
    assert periodic_runs.find_runs(b) == []  # Fibonacci words have no fourth powers


def test_operator_on_odd_rows(spark, odd, none):
    more = odd.withColumn("runs", odd.text).withColumn("Collapsed", odd.source)
    out = periodic_runs.with_runs(more).collect()
    assert len(out) == odd.count() and set(periodic_runs.with_runs(more).columns) >= {"runs", "Collapsed", "runs_", "collapsed_"}
    rows = {r.doc_id: r for r in out}
    assert [tuple(r) for r in rows[5].runs_] == [(0, 12000, 3)] and rows[5].collapsed_ == "word and other"
    assert rows[3].runs_ == rows[4].runs_ == [] and rows[3].collapsed_ == "" and rows[8].collapsed_ == "a b"
    assert periodic_runs.with_runs(none).count() == periodic_runs.digest(none).count() == 0


def test_digest_on_odd_rows(spark, odd):
    rows = [(None, "a b " * 9), (None, None), *[(r.doc_id, r.text) for r in odd.collect()]]
    got = sorted(tuple(str(x) for x in r) for r in periodic_runs.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(tuple(str(x) for x in (k, *expected(k, t))) for k, t in rows)


def test_query_equals_brute_force(spark):
    pytest.importorskip("pyarrow")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = by_id(QUERIES["op13_periodic_runs"](spark, SF))
    assert sum(len(x) for x in got.values()) == len(docs)
    for d in docs:
        assert tuple(got[d.doc_id][0])[1:] == expected(d.doc_id, d.text), d.doc_id
