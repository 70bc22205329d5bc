"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document. The ledger keeps its measurements and one bit
for each failed rule; versioned policies (masks over these bits) and ablations are then bitwise
work on the ledger, without another look at a text.

All of it is computed inside the document's row: no shuffle, whatever the source or the size of
a group of copies. The state of a task is one document's words.

Defined cases: a null text counts as empty (no words: it fails `few_words`); repeated rows are
rated one by one; every input column is kept, and the ledger's columns live in one struct column
whose name does not clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilandera.llm.common import SPACE, WORD, free_name

#: Bit of each rule in fail_bits. Bits never change their meaning; new rules take new bits.
RULES = {
    "few_words": 0,  # fewer than 50 words
    "repeated_words": 1,  # over half of the words in 3-word windows that occur twice or more
    "symbols": 2,  # over 10 symbols for 100 words
    "long_words": 3,  # mean word longer than 30 code points
    "repeated_lines": 4,  # over 90 % of the lines repeat an earlier one
}
#: Policy version -> rules that reject. A version is never edited, only followed by another.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "long_words", "repeated_lines"),
}
CURRENT = 2


def mask_of(rules) -> int:
    return reduce(lambda m, r: m | 1 << RULES[r], rules, 0)


def _window_hash(window: Column) -> Column:
    return F.xxhash64(window)


def _with_repeat_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """docs with out = the words of array column `words` in a 3-word window found twice or more.

    A window becomes one long: the low bits of its hash above, its position below. Sorted, equal
    windows are neighbours (their words are compared once more), and sorted repeat positions p
    cover sum(min(3, next p - p)) words, 3 for the last. Where different windows meet under one hash,
    the text's windows are sorted by their words instead. Each step is a column of its own, so that
    none is computed twice.
    """
    s, p, k = (free_name(docs, x) for x in ("_sorted", "_at", "_bits"))
    n = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.arrays_zip(*(F.slice(words, i, n).alias(f"w{i}") for i in (1, 2, 3)))
    pairs = lambda c: (F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))))
    # positions take _bits bits; shiftleft by a column is SQL's to say
    packed = F.transform(windows, lambda w, i: F.call_function("shiftleft", _window_hash(w), F.col(k)).bitwiseOR(i.cast("long")))
    at = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(k)) - 1).cast("int")
    one_hash = lambda a, b: F.call_function("shiftrightunsigned", a.bitwiseXOR(b), F.col(k)) == 0
    equal = lambda a, b: F.slice(words, at(a) + 1, 3) == F.slice(words, at(b) + 1, 3)
    places = lambda a, b: F.when(one_hash(a, b), F.when(equal(a, b), F.array(at(a), at(b))).otherwise(F.array(F.lit(-1))))
    by_words = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    exact = F.zip_with(*pairs(by_words), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    repeats = lambda c: F.sort_array(F.array_distinct(F.flatten(F.array_compact(c))))
    covered = F.aggregate(F.zip_with(*pairs(F.col(p)), lambda a, b: F.least(b - a, F.lit(3))), F.lit(3), lambda t, x: t + x)
    return (
        docs.withColumn(k, F.length(F.bin(F.size(words).cast("long"))))
        .withColumn(s, F.sort_array(packed))
        .withColumn(p, F.zip_with(*pairs(F.col(s)), places))
        .withColumn(p, repeats(p))
        .withColumn(p, F.when(F.get(p, F.lit(0)) == -1, repeats(exact)).otherwise(F.col(p)))
        .withColumn(out, F.when(F.size(p) == 0, F.lit(0)).otherwise(covered).cast("long"))
        .drop(s, p, k)
    )


def ledger(docs: DataFrame, text: str = "text", out: str = "ledger") -> DataFrame:
    """docs with a struct column `out`: n_words, word_chars, n_symbols, n_dup_lines, n_lines,
    n_repeat_words (long) and fail_bits (long)."""
    t, w, n, lines, m = (free_name(docs, x) for x in ("_t", "_w", "_r", "_lines", "_m"))
    docs = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    docs = docs.withColumn(w, F.array_remove(F.split(F.col(t), SPACE + "+"), ""))
    docs = _with_repeat_words(docs, w, n)
    docs = docs.withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(WORD)))
    measured = docs.withColumn(
        m,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(F.col(t), "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            F.col(n).alias("n_repeat_words"),
        ),
    )
    x = lambda k: F.col(m)[k]
    failed = {
        "few_words": x("n_words") < 50,
        "repeated_words": 100 * x("n_repeat_words") > 50 * x("n_words"),
        "symbols": 100 * x("n_symbols") > 10 * x("n_words"),
        "long_words": x("word_chars") > 30 * x("n_words"),
        "repeated_lines": 100 * x("n_dup_lines") > 90 * x("n_lines"),
    }
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(c, F.lit(1 << RULES[k]).cast("long")).otherwise(F.lit(0).cast("long")) for k, c in failed.items()))
    # one row of an array: a filter on the bits stays above it, else Catalyst would copy all of the
    # above into the filter and compute each mention again
    rows = F.explode(F.array(F.struct(F.col(f"{m}.*"), bits.alias("fail_bits"))))
    return measured.select("*", rows.alias(out)).drop(*({t, w, n, lines, m} - {out}))


def passes(bits: Column, version: int = CURRENT) -> Column:
    """Whether a policy version keeps a document with these fail bits."""
    return bits.bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0


def apply_policy(docs: DataFrame, version: int = CURRENT, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    out = free_name(docs, "ledger")
    return ledger(docs, text, out).filter(passes(F.col(out)["fail_bits"], version)).drop(out)


def ablation(ledger_rows: DataFrame, version: int = CURRENT, column: str = "ledger") -> DataFrame:
    """For each rule of a policy: documents it fails, fails alone, and the documents kept without it.

    Equal fail bits are counted first: at most 2^rules rows are left for the bitwise part.
    """
    mask = mask_of(POLICIES[version])
    bits = F.col(column)["fail_bits"].bitwiseAND(F.lit(mask).cast("long"))
    counts = ledger_rows.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in POLICIES[version])))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    n_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return (
        counts.withColumn("r", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(n_if(has)("failed"), n_if(F.col("bits") == F.col("r.bit"))("failed_alone"), n_if((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit")))("kept_without"))
    )


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: its measurements and the verdicts of the base rules and of the current policy."""
    x = F.col("ledger")
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id",
        x["n_words"].alias("n_words"),
        x["word_chars"].alias("word_chars"),
        x["n_symbols"].alias("n_symbols"),
        x["n_dup_lines"].alias("n_dup_lines"),
        x["n_repeat_words"].alias("n_repeat_words"),
        (~passes(x["fail_bits"], 1)).alias("base_failed"),
        passes(x["fail_bits"]).alias("kept"),
        x["fail_bits"].alias("fail_bits"),
    )
