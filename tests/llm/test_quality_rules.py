import random
import re
from collections import Counter

from hilandera.llm import quality_rules as q

from .conftest import ROWS, by_id


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def measured(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_odd_rows(odd, none):
    found = by_id(q.digest(odd))
    for key, text, _ in ROWS:
        assert all(measured(r) == brute(text) for r in found[key])
    assert all(r.base_failed and not r.kept for r in found[3] + found[4])
    assert q.digest(none).count() == 0
    kept = q.apply_policy(odd)
    assert kept.columns == odd.columns and kept.count() == 0


def test_random_texts(spark):
    random.seed(0)
    rows = [(i, "".join(random.choices(["a", "b", "é", " ", "\n", "#", "ab "], k=random.randint(0, 200)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(q.digest(docs))
    for i, t in rows:
        (r,) = found[i]
        n, _, _, _, repeated = brute(t)
        assert measured(r) == brute(t)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
    ledger = q.ledger(docs)
    bits = [r.ledger.fail_bits for r in ledger.collect()]
    mask = q.mask_of(q.POLICIES[q.CURRENT])
    for r in q.ablation(ledger).collect():
        bit = 1 << q.RULES[r.rule]
        assert (r.failed, r.failed_alone) == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits))
        assert r.kept_without == sum(b & mask & ~bit == 0 for b in bits)
    assert q.apply_policy(docs).count() == sum(b & mask == 0 for b in bits)


def test_windows_of_one_hash(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, " ".join(random.Random(i).choices("a b c d".split(), k=60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(map(tuple, q.digest(docs).collect()))
    monkeypatch.setattr(q, "_window_hash", lambda w: F.lit(1).cast("long"))
    assert sorted(map(tuple, q.digest(docs).collect())) == expected


def test_a_filter_computes_nothing_again(odd):
    plan = q.apply_policy(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 1 and "rand(" not in plan
