"""Secret scans over a trigram inverted index, in DataFrame functions only.

Index: for each bucket of documents and each trigram that some rule asks for, the list of document
keys. Query: each rule's expression becomes a Boolean trigram query (trigram_query.py); its
postings are intersected within a bucket, clause by clause, and the clauses united. Verification:
the rule's expression runs over the whole text of the candidates only, and yields spans. Rules
without mandatory trigrams (long hexadecimal runs) scan every text.

Buckets hold some 20,000 documents each, so that no posting list grows with the corpus. Candidate
keys are broadcast up to BROADCAST_ROWS of them and joined by shuffle beyond.

Defined cases: a null text counts as empty; a document without a key cannot be in the index and is
scanned by every rule; rows that share a key are verified one by one; texts of any length are
taken whole (100,000 spans take some seconds); an empty table has no buckets; other columns are kept, and `spans` gets a trailing underscore where the table has one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hilandera.llm.common import cut, free_name
from hilandera.llm.trigram_query import trigram_query

BUCKET_ROWS = 20_000
BROADCAST_ROWS = 500_000
#: Matches whose places are gathered at a time, and code points of a block that texts are cut from.
RUN, BLOCK = 512, 512


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern whose group has `least` characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: In the order in which spans of equal start are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED = (
    # through the end line or, where that is missing, the lines of base64
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=,:\s-]{0,20000}?-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:\s{1,4}[A-Za-z0-9+/=]{16,80}){0,400})"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + ADDED


def _vocabulary(rules) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) or () for t in clause})


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """bucket, trigram, keys: the postings of the trigrams that the rules ask for."""
    n_buckets = max(1, math.ceil(docs.count() / BUCKET_ROWS))
    low = free_name(docs, "_low")
    has = F.array_compact(F.array(*(F.when(F.contains(F.col(low), F.lit(t)), F.lit(t)) for t in _vocabulary(rules))))
    return (
        docs.filter(F.col(key).isNotNull())
        .withColumn(low, F.lower(F.coalesce(F.col(text), F.lit(""))))
        .select(F.col(key).alias("key"), F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int").alias("bucket"), F.explode(has).alias("trigram"))
        .groupBy("bucket", "trigram")
        .agg(F.sort_array(F.collect_set("key")).alias("keys"))
    )


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """key, rules (a bit for each rule that may match): the rules' Boolean queries over the postings."""
    words = _vocabulary(rules)
    lists = index.groupBy("bucket").agg(*(F.max(F.when(F.col("trigram") == t, F.col("keys"))).alias(f"t{i}") for i, t in enumerate(words)))
    kind = dict(index.dtypes)["keys"]
    posting = lambda t: F.coalesce(F.col(f"t{words.index(t)}"), F.array().cast(kind))
    found = []
    for i, r in enumerate(rules):
        if clauses := trigram_query(r.pattern):
            keys = reduce(F.array_union, (reduce(F.array_intersect, map(posting, c)) for c in clauses))
            found.append(F.struct(F.lit(1 << i).cast("long").alias("bit"), keys.alias("keys")))
    each = lists.select(F.explode(F.array(*found)).alias("x")).select("x.bit", F.explode("x.keys").alias("key"))
    return each.groupBy("key").agg(F.bit_or("bit").alias("rules"))


def _folded(items: Column, at: Column, kind: str, step) -> Column:
    """struct(at, out): step(at, item) = (the next at, whether the item gives something, what) over items in
    order, with what it gave. Outputs are gathered RUN at a time, so the work is linear in the items."""
    none = F.array().cast(f"array<{kind}>")

    def one(done: Column, item: Column) -> Column:
        to, gives, what = step(done["at"], item)
        return F.struct(to.alias("at"), F.when(gives, F.concat(done["out"], F.array(what))).otherwise(done["out"]).alias("out"))

    def run(every: Column):
        def through(done: Column, k: Column) -> Column:
            # a finish names the part without the copy of its result that transform makes
            whole = lambda p: F.struct(p["at"].alias("at"), F.concat(done["out"], F.array(p["out"])).alias("out"))
            return F.aggregate(_between(every, k * RUN, (k + 1) * RUN), F.struct(done["at"].alias("at"), none.alias("out")), one, whole)

        return through

    start = F.struct(at.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    runs = lambda every: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(every) / RUN) - 1, F.lit(0)).cast("int"))
    flat = lambda d: F.struct(d["at"].alias("at"), F.flatten(d["out"]).alias("out"))
    return _let(items, lambda every: F.aggregate(runs(every), start, run(every), flat))


def _between(every: Column, start: Column, end: Column) -> Column:
    """The items from place `start` (from 0) to before `end`, without a copy of the others, which slice makes."""
    last = F.least(end, F.size(every)) - 1
    return F.transform(F.filter(F.sequence(start, F.greatest(last, start)), lambda i: i <= last), lambda i: F.get(every, i))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


_SPAN = "struct<start:int,order:int,end:int,kind:string>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of the rule's leftmost matches, in code points: the text's parts between matches and
    the matches themselves, laid end to end."""
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
    )

    def step(at: Column, x: Column):
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return end, F.length(x["value"]) >= max(1, rule.least), F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))

    return _folded(zipped, F.lit(0), _SPAN, step)["out"]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """docs with `spans`: array of (start, order, end, kind), by start and the order of the rules."""
    out, t, bits, k = (free_name(docs, x) for x in ("spans", "_t", "_rules", "_key"))
    found = cut(candidates(cut(build_index(docs, key, text, rules)), rules)).withColumnsRenamed({"key": k, "rules": bits})
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    everything = (1 << len(rules)) - 1
    rated = docs.join(found, docs[key] == found[k], "left").withColumn(bits, F.when(F.col(key).isNull(), F.lit(everything).cast("long")).otherwise(F.coalesce(F.col(bits), F.lit(0).cast("long"))))
    rated = rated.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    parts = []
    for i, r in enumerate(rules):
        spans = _spans(F.col(t), r, i)
        may = F.col(bits).bitwiseAND(F.lit(1 << i).cast("long")) != 0 if trigram_query(r.pattern) else F.col(t).rlike(r.pattern)
        parts.append(F.when(may, spans).otherwise(none))
    return rated.withColumn(out, F.sort_array(F.concat(*parts))).drop(k, bits, t)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones as one) replaced by [SECRET].

    What stays is cut from blocks of BLOCK code points, so no cut walks through the text from its start.
    """

    def step(at: Column, s: Column):
        return F.greatest(at, s["end"]), s["start"] >= at, F.struct(at.alias("from"), s["start"].alias("to"))

    def cut_out(blocks: Column, gap: Column) -> Column:
        first, last = F.floor(gap["from"] / BLOCK).cast("int"), F.floor((gap["to"] - 1) / BLOCK).cast("int")
        head = F.substring(F.get(blocks, first), gap["from"] % BLOCK + 1, F.least(gap["to"] - gap["from"], F.lit(BLOCK)))
        rest = F.concat(F.array_join(_between(blocks, first + 1, last), ""), F.substring(F.get(blocks, last), F.lit(1), gap["to"] - last * BLOCK))
        return F.when(gap["to"] <= gap["from"], "").when(first == last, head).otherwise(F.concat(head, rest))

    def put_together(holes: Column) -> Column:
        gaps = F.concat(holes["out"], F.array(F.struct(holes["at"].alias("from"), F.length(text).alias("to"))))
        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
        return _let(blocks, lambda b: F.array_join(F.transform(gaps, lambda g: cut_out(b, g)), "[SECRET]"))

    holes = _folded(spans, F.lit(0), "struct<from:int,to:int>", step)
    return F.when(F.size(spans) == 0, text).otherwise(_let(holes, put_together))


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: spans of each base kind, the digest of the base spans, all spans."""
    found = scan(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
