"""Token counts of texts of any length: huge texts are encoded in overlapping chunks and spliced.

Texts of CHUNK bytes or less are encoded whole by the library. A longer text is cut into chunks of
CHUNK bytes that reach OVERLAP bytes over each of their ends; chunks are dealt out by text and number,
so one text keeps many tasks busy, and each is encoded with offsets. Two neighbours are spliced at the first
token that both have at the same place: the left chunk counts up to it, the right one from behind it.

Why that is exact. The model merges neighbouring symbols, best piece first, the leftmost of equals, and asks
for nothing but the two symbols. So (a) what lies between two of a text's final boundaries merges as if it
stood alone; and (b) a sequence of tokens is a text's encoding if every two neighbours among them are
the encoding of their own text: take the first merge that crosses a boundary of the sequence; until then both
neighbours have merged as they do alone, and alone they are never merged. A spliced sequence has only
neighbours that some chunk's encoding has: the shared token stands before one and behind the other. A
character outside the vocabulary is a symbol that merges with nothing; its byte tokens count with it.
A chunk's first token is never shared unless the chunk begins with the text: it holds the space put in front.

Where two neighbours share no token, the text is cut again with an overlap (and a chunk) four times as
long, and so on: at last one chunk holds the whole text, so every text ends in an exact count. A text
without such places (one word repeated without spaces can be) thus ends in one task.

For sentencepiece models of kind BPE that leave their text as it is but for spaces and one space put
in front; load() refuses others.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows and null keys are
counted one by one; an empty table gives no rows; other columns are kept, and `n_bytes` and
`n_tokens` get a trailing underscore where the table has such columns.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from hilandera.llm.common import free_name, stored

CHUNK, OVERLAP, WIDER = 1 << 15, 1 << 10, 4
#: Bytes of text that are encoded at a time.
AT_ONCE = 2 << 20
LIMIT = 4096
_TOKENS = pa.list_(pa.int64())
_NUMBERED = [("uid", pa.int64()), ("i", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_())]
_CUT = pa.schema([*_NUMBERED, ("base", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())])
_ENCODED = pa.schema([*_NUMBERED, ("n", pa.int64()), ("head", _TOKENS), ("tail", _TOKENS), ("tail_at", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "a  B ﬁ　 é "
    if "".join(p for p in model.encode(probe, out_type=str)) != "▁" + probe.replace(" ", "▁"):
        raise ValueError("the model changes more of a text than its spaces")
    return model


def chunks(text: bytes, size: int, overlap: int):
    """(number, base, start, stop, bytes from base on) of each chunk [start, stop) of a text, with overlaps;
    no character is parted."""

    def whole(at: int) -> int:
        while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
            at -= 1
        return max(0, min(at, len(text)))

    edges = sorted({whole(at) for at in range(0, len(text), size)} | {len(text)})
    for i, (start, stop) in enumerate(zip(edges, edges[1:], strict=False)):
        base = whole(start - overlap)
        yield i, base, start, stop, text[base : whole(stop + overlap)]


def _cut(batches, size: int, overlap: int):
    for batch in batches:
        for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            rows = []
            for i, base, start, stop, part in chunks(text, size, overlap):
                rows.append({"uid": uid, "i": i, "first": i == 0, "last": stop == len(text), "base": base, "start": start, "stop": stop, "text": part.decode()})
                if len(rows) * size > AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, _CUT)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _CUT)


def encoded(row: dict, model, overlap: int) -> dict:
    """A chunk's number of tokens and those in the overlaps at its ends, at their places in the text."""
    pieces = [(row["base"] + p.begin, row["base"] + p.end, p.id) for p in model.encode(row["text"], return_type="proto").pieces]
    # the first head_n tokens reach no further than the overlap; the last ones begin within the other
    head = [] if row["first"] else [p for p in pieces if p[1] <= row["start"] + overlap]
    if row["base"] and head:
        # the space put in front belongs to a chunk's first token, whose name may then be that of a longer one there
        head[0] = (0, 0, 0)
    tail_at = len(pieces)
    while not row["last"] and tail_at and pieces[tail_at - 1][0] >= row["stop"] - overlap:
        tail_at -= 1
    # a token's place and kind in one number; one without width is one of several bytes of a character and no place
    named = lambda part, none: [start << 24 | kind if stop > start else none for start, stop, kind in part]
    return {"uid": row["uid"], "i": row["i"], "first": row["first"], "last": row["last"], "n": len(pieces), "head": named(head, -1), "tail": named(pieces[tail_at:], -2), "tail_at": tail_at}


def _encode(batches, path: str, overlap: int):
    model = load(path)
    for batch in batches:
        for k in range(batch.num_rows):
            (row,) = batch.slice(k, 1).to_pylist()
            yield pa.RecordBatch.from_pylist([encoded(row, model, overlap)], _ENCODED)


def spliced(parts: DataFrame) -> DataFrame:
    """parts (encoded chunks) with `through`, the tokens that a chunk counts: from behind the token that it
    shares with its left neighbour up to the one that it shares with its right neighbour; null where it
    shares none."""
    left = parts.filter(~F.col("last")).select("uid", F.col("i").alias("at"), "tail", "tail_at")
    right = parts.filter(~F.col("first")).select("uid", (F.col("i") - 1).alias("at"), "head")
    shared = left.join(right, ["uid", "at"]).withColumn("token", F.try_element_at(F.array_intersect("tail", "head"), F.lit(1)))
    place = shared.select(
        "uid",
        "at",
        (F.col("tail_at") + F.array_position("tail", F.col("token"))).alias("upto"),
        F.array_position("head", F.col("token")).alias("behind"),
    ).filter(F.col("upto").isNotNull())
    ends = place.select("uid", F.col("at").alias("i"), "upto")
    begins = place.select("uid", (F.col("at") + 1).alias("i"), "behind")
    upto = F.when(F.col("last"), F.col("n")).otherwise(F.col("upto"))
    behind = F.when(F.col("first"), F.lit(0)).otherwise(F.col("behind"))
    return parts.select("uid", "i", "first", "last", "n").join(ends, ["uid", "i"], "left").join(begins, ["uid", "i"], "left").select("uid", "i", (upto - behind).alias("through"))


def _long_counts(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """uid, n_tokens of texts (uid, text), by rounds of wider overlaps."""
    done, left = None, texts
    while True:
        cut = left.mapInArrow(lambda b, s=chunk, w=overlap: _cut(b, s, w), from_arrow_schema(_CUT)).repartition("uid", "i")
        parts = stored(cut.mapInArrow(lambda b, w=overlap: _encode(b, path, w), from_arrow_schema(_ENCODED)), "token-chunks")
        counts = stored(spliced(parts).groupBy("uid").agg(F.sum("through").alias("n_tokens"), F.every(F.col("through").isNotNull()).alias("whole")), "token-chunks")
        here = counts.filter("whole").drop("whole")
        done = here if done is None else done.unionByName(here)
        if counts.filter("not whole").isEmpty():
            return done
        left = texts.join(counts.filter("not whole").select("uid"), "uid", "left_semi").select("uid", "text")
        chunk, overlap = chunk * WIDER, overlap * WIDER


def _whole_counts(batches, path: str, kept: int, out: str):
    """Texts that the library takes whole, some AT_ONCE bytes at a time."""
    model = load(path)
    for batch in batches:
        texts, at = batch.column(0), 0
        while at < batch.num_rows:
            some, size = [], 0
            while at + len(some) < batch.num_rows and (not some or size < AT_ONCE):
                some.append(texts[at + len(some)].as_py() or "")
                size += len(some[-1])
            counts = pa.array([len(ids) for ids in model.encode(some, num_threads=1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.slice(at, len(some)).columns[1 : 1 + kept], counts], names=[*batch.schema.names[1 : 1 + kept], out])
            at += len(some)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_bytes and n_tokens of `text`."""
    if not 0 < 2 * overlap < chunk:
        raise ValueError("a chunk must be longer than its two overlaps")
    path = path or default_tokenizer()
    size, n = free_name(docs, "n_bytes"), free_name(docs, "n_tokens")
    sized = docs.withColumn(size, F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    short = sized.filter(F.col(size) <= chunk).select(F.col(text).alias("_text"), *(F.col(f"`{c}`") for c in sized.columns))
    kept = len(sized.columns)
    counted = short.mapInArrow(lambda b: _whole_counts(b, path, kept, n), T.StructType([*sized.schema.fields, T.StructField(n, T.LongType())]))
    # the write fixes each long text's number, however often it is read again
    long = sized.filter(F.col(size) > chunk).select(F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in sized.columns)).alias("row"))
    long = stored(long, "long-texts")
    if long.isEmpty():
        return counted
    counts = _long_counts(long.select("uid", "text"), path, chunk, overlap).withColumnRenamed("n_tokens", n)
    return counted.unionByName(long.select("uid", "row").join(counts, "uid").select("row.*", n))


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: its bytes, its tokens, and whether they go beyond LIMIT."""
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
