"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs over all training texts are quantised on a logarithmic scale, and an
n-gram of level q goes into the filter q times, as (n-gram, 1) to (n-gram, q); an entry's bits lie in
one machine word, so a probe reads one word. A scorer probes
(n-gram, 1), (n-gram, 2), ... until a probe fails: the last level that held gives the count back to
within a factor of 1.5 (never too low; too high with the filter's small false-positive rate). Pair
probabilities are interpolated with word probabilities, by a weight that grows with the context's
count; both are under-estimates of the filter's counts, so the probabilities of all words add up to
one at most (but for false positives).

Counting: a task turns its texts into 64-bit n-gram keys, sums equal ones (each word, hot or not, is
one entry of a task's sum) and sends them as sorted arrays to the key's bucket; a bucket builds one
segment of the filter. Segments have 2^k bits, BITS at least for each entry, so the filter grows with
its entries and its false-positive rate does not depend on the size of the corpus.

Scoring: the filter stays a table of segments, which is neither collected nor broadcast. A task puts
its texts in chunks of some CHUNK tokens and stores them as numbers of words; a chunk sends each of
its distinct n-grams once to the segment's bucket and gets one byte, the level, back.

The exact base score needs exact counts: the most frequent words (HOT_WORDS at most) are broadcast;
the others, which are rare, join a table of counts by shuffle, one row for each document and word.

Defined cases: a null or empty text is the end token alone; repeated rows count and are scored one
by one; without training texts N and V are 0 and every token is unknown; other columns are not
returned (key and scores only).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hilandera.llm.common import most_frequent, stored

FOLDS, HELD_OUT = 7, 2
BASE = 1.5
LEVELS = 80
#: Bits set for an entry, and bits for each entry before rounding up to a power of two.
PROBES, BITS = 4, 8
#: Tokens of a chunk of texts whose n-grams are probed together.
CHUNK = 1_000_000
HOT_WORDS = 100_000
CACHE_WORDS = 150_000
#: Pair counts that a task holds before it sends their sums on.
FLUSH = 2_000_000
#: Bytes of text for each bucket.
BUCKET_BYTES = 16 << 20
#: Most weight of a pair's relative frequency, and the context count that earns half of it.
TRUST, PRIOR = 0.5, 2.0
#: The end token, which no word can be.
END = b"\n"
SLICE_ROWS = 512
#: Smallest count of each level 1, 2, ...; level 0 is an unseen n-gram.
LOW = np.array([0.0, *(math.ceil(BASE ** (q - 1) - 1e-9) for q in range(1, LEVELS + 1))])
_U = np.uint64


def fold(key: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def words_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def level(count: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(count) / math.log(BASE) + 1e-9), LEVELS).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def word_keys(h: np.ndarray) -> np.ndarray:
    return _mixed(h + _U(0x9E3779B97F4A7C15))


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _mixed(before * _U(0x9E3779B97F4A7C15) + h)


class WordHash(dict):
    """word -> its 64-bit hash, remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _texts(batches, column: int):
    for b in batches:
        for s in range(0, b.num_rows, SLICE_ROWS):
            part = b.slice(s, SLICE_ROWS)
            yield part, part.column(column).cast(pa.large_binary()).to_pylist()


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), n over the texts, end tokens included."""
    from collections import Counter

    def count(batches):
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for _, texts in _texts(batches, 0):
            for t in texts:
                seen.update(words_of(t))
            if len(seen) > 250_000:
                yield rows()
                seen.clear()
        yield rows()

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _dealt(keys: np.ndarray, counts: np.ndarray, bits: int):
    """Rows (bucket, keys, counts) of sorted distinct keys; the top bits of a key name its bucket."""
    bucket = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.empty(0, np.int64)
    ends = np.r_[at[1:], len(keys)] if len(at) else at
    rows = [{"bucket": int(bucket[a]), "keys": keys[a:b].tobytes(), "counts": counts[a:b].astype("<u4").tobytes()} for a, b in zip(at, ends, strict=True)]
    return pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))


_DEALT = "bucket int, keys binary, counts binary"


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def pair_counts(docs: DataFrame, bits: int, text: str = "text") -> DataFrame:
    """Sums of pair keys by bucket; the end token is the context of a text's first word."""

    def count(batches):
        hashes, held, n = WordHash(), [], 0
        end = _U(hashes[END])
        for _, texts in _texts(batches, 0):
            words = [w for t in texts for w in words_of(t)]
            h = hashes.of(words)
            held.append(pair_keys(np.r_[end, h[:-1]], h))
            n += len(h)
            if n >= FLUSH:
                yield _dealt(*np.unique(np.concatenate(held), return_counts=True), bits)
                held, n = [], 0
        if n:
            yield _dealt(*np.unique(np.concatenate(held), return_counts=True), bits)

    return docs.select(text).mapInArrow(count, _DEALT)


def word_counts_as_keys(counts: DataFrame, bits: int) -> DataFrame:
    def deal(batches):
        import xxhash

        for b in batches:
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in b.column(0).to_pylist()], np.uint64)
            n = np.minimum(b.column(1).to_numpy(), (1 << 32) - 1)
            yield _dealt(*_summed(word_keys(h), n), bits)

    return counts.select("word", "n").mapInArrow(deal, _DEALT)


def _turn(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, mask) of each key at a level: the PROBES bits of an entry lie in one 64-bit word."""
    h = _mixed(keys + _U((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    mask = np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        mask |= _U(1) << ((h >> _U(40 + 6 * i)) & _U(63))
    return h, mask


def segments(dealt: DataFrame) -> DataFrame:
    """bucket, entries, bits: a segment of the filter for each bucket."""

    def build(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in group.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("counts").to_pylist()]).astype(np.int64)
        keys, counts = _summed(keys, counts)
        q = level(counts)
        size = 1 << max(6, int(BITS * q.sum() - 1).bit_length())
        data = np.zeros(size // 64, np.uint64)
        for j in range(int(q.max())):
            at, mask = _turn(keys[q > j], j)
            np.bitwise_or.at(data, (at & _U(len(data) - 1)).astype(np.int64), mask)
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "entries": [int(q.sum())], "bits": [data.tobytes()]})

    return dealt.groupBy("bucket").applyInArrow(build, "bucket int, entries long, bits binary")


@dataclass
class Filter:
    """bits: top bits of a key that name a segment; first, mask: each segment's first word and its
    number of words less one; data: the segments' words, and a zero that stands for empty segments."""

    bits: int
    first: np.ndarray
    mask: np.ndarray
    data: np.ndarray
    entries: int

    @staticmethod
    def of(rows: pa.Table, bits: int) -> Filter:
        words = np.zeros(1 << bits, np.int64)
        parts = [(b.as_py(), x.as_buffer()) for b, x in zip(rows["bucket"], rows["bits"], strict=True)]
        for b, x in parts:
            words[b] = x.size // 8
        first = np.r_[0, np.cumsum(words)[:-1]]
        data = np.zeros(int(words.sum()) + 1, np.uint64)
        for b, x in parts:
            data[first[b] : first[b] + words[b]] = np.frombuffer(x, np.uint64)
        first[words == 0] = len(data) - 1
        return Filter(bits, first, np.maximum(words, 1).astype(np.uint64) - _U(1), data, sum(rows["entries"].to_pylist()))

    @property
    def false_positives(self) -> float:
        """The chance that a word of the filter holds an entry's bits, over all words."""
        return float(((np.bitwise_count(self.data) / 64) ** PROBES).mean())

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        segment = (keys >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        left, first, mask = np.arange(len(keys)), self.first[segment], self.mask[segment]
        for j in range(LEVELS):
            at, bits = _turn(keys, j)
            held = self.data[first + (at & mask).astype(np.int64)] & bits == bits
            left, keys, first, mask = left[held], keys[held], first[held], mask[held]
            if not len(left):
                break
            out[left] = j + 1
        return out


@dataclass
class Model:
    """segments: the filter of words and pairs (a table), bits: top bits of a key that name its segment;
    total: of the smoothed word counts; tokens, distinct: N and V; hot: exact counts of the most
    frequent words; counts: those of all (a table)."""

    segments: DataFrame
    bits: int
    total: float
    tokens: int
    distinct: int
    hot: dict[bytes, int]
    counts: DataFrame
    rare: DataFrame

    @cached_property
    def filter(self) -> Filter:
        """All segments in one process, for a corpus whose filter fits there; scoring does not use it."""
        return Filter.of(self.segments.toArrow(), self.bits)


def train(docs: DataFrame, text: str = "text") -> Model:
    """The model of all the given texts."""
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = (max(1, math.ceil(n_bytes / BUCKET_BYTES)) - 1).bit_length()
    counts = stored(count_words(docs, text), "lm-words")
    low = F.ceil(F.pow(F.lit(BASE), F.floor(F.log("n") / math.log(BASE) + 1e-9)) - 1e-9)
    tokens, distinct, total = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(low + 1)).first()
    table = stored(segments(pair_counts(docs, bits, text).unionByName(word_counts_as_keys(counts, bits))), "lm-filter")
    frequent, rare = most_frequent(counts, "n", HOT_WORDS)
    hot = frequent.select("word", "n").toArrow()
    return Model(table, bits, float(total or 0) + 1, tokens or 0, distinct or 0, dict(zip(hot["word"].to_pylist(), hot["n"].to_pylist(), strict=True)), counts, rare)


def _chunk_row(uid: int, h: np.ndarray, sizes: np.ndarray) -> dict:
    import zstandard

    hashes, ids = np.unique(h, return_inverse=True)
    return {"uid": uid, "sizes": sizes.astype("<i8").tobytes(), "hashes": hashes.astype("<u8").tobytes(), "ids": zstandard.compress(ids.astype("<u4").tobytes(), 1)}


def _chunk(ids: bytes, hashes: bytes):
    """(hashes of the chunk's tokens, numbers of their words, keys of its words and then of its pairs);
    a chunk starts behind an end token."""
    import xxhash
    import zstandard

    hashes, ids = np.frombuffer(hashes, "<u8"), np.frombuffer(zstandard.decompress(ids), "<u4")
    h = hashes[ids]
    before = np.r_[_U(xxhash.xxh3_64_intdigest(END)), h[:-1]]
    return hashes, ids, np.concatenate([word_keys(hashes), pair_keys(before, h)])


def _thin(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte: the high bytes are zeros, which compress."""
    return np.diff(keys, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _thick(data: pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _probes(chunks: DataFrame, bits: int) -> DataFrame:
    """bucket, uid, keys: the distinct keys of each chunk, in order, by segment."""

    def deal(batches):
        for b in batches:
            for row in b.to_pylist():
                keys = np.unique(_chunk(row["ids"], row["hashes"])[2])
                dealt = _dealt(keys, np.empty(len(keys), "<u4"), bits)
                thin = pa.array([_thin(np.frombuffer(x.as_buffer(), "<u8")) for x in dealt.column("keys")], pa.binary())
                yield pa.RecordBatch.from_arrays([dealt.column("bucket"), pa.array([row["uid"]] * dealt.num_rows, pa.int64()), thin], ["bucket", "uid", "keys"])

    return chunks.select("uid", "ids", "hashes").mapInArrow(deal, "bucket int, uid long, keys binary")


def _probed(probes: DataFrame, table: DataFrame) -> DataFrame:
    """uid, bucket, levels (a byte for each key) of the probes."""

    def probe(asked: pa.Table, segment: pa.Table) -> pa.Table:
        data = np.frombuffer(segment.column("bits")[0].as_buffer(), np.uint64) if segment.num_rows else np.zeros(1, np.uint64)
        held = Filter(0, np.zeros(1, np.int64), np.array([len(data) - 1], np.uint64), data, 0)
        # chunk by chunk: what a call holds does not grow with the corpus
        levels = [held.levels(_thick(x.as_buffer())).astype(np.uint8).tobytes() for x in asked.column("keys")]
        return pa.table({"uid": asked.column("uid"), "bucket": asked.column("bucket"), "levels": pa.array(levels, pa.binary())})

    return probes.groupBy("bucket").cogroup(table.select("bucket", "bits").groupBy("bucket")).applyInArrow(probe, "uid long, bucket int, levels binary")


def _log10_probabilities(levels: np.ndarray, total: float, end: int, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each token of a chunk; levels: of its words and then of its pairs."""
    low, pair = LOW[levels[: len(hashes)]], LOW[levels[len(hashes) :]]
    word = low[ids]
    # a context's count is that of the word itself, taken at the upper end of its level
    context = np.r_[low[np.searchsorted(hashes, _U(end))], word[:-1]]
    context = np.maximum(context, np.floor(context * BASE))
    pair = np.minimum(pair, context)
    trust = TRUST * context / (context + PRIOR)
    return np.log10(trust * pair / np.maximum(context, 1) + (1 - trust) * (word + 1) / total)


def _scored(chunks: DataFrame, model: Model) -> DataFrame:
    """uid, score of each text of the chunks."""
    total = model.total

    def each(chunk: pa.Table, probed: pa.Table) -> pa.Table:
        import xxhash

        (row,) = chunk.to_pylist()
        hashes, ids, keys = _chunk(row["ids"], row["hashes"])
        # segments are ranges of keys: their answers, one behind the other, are those of the sorted keys
        answers = np.frombuffer(b"".join(probed.sort_by("bucket").column("levels").to_pylist()), np.uint8)
        levels = answers[np.unique(keys, return_inverse=True)[1]]
        p = _log10_probabilities(levels, total, xxhash.xxh3_64_intdigest(END), hashes, ids)
        sizes = np.frombuffer(row["sizes"], "<i8")
        return pa.table({"uid": row["uid"] + np.arange(len(sizes)), "score": np.add.reduceat(p, np.r_[0, np.cumsum(sizes)[:-1]])})

    # each is stored, so that only one step's shuffle is on disk at a time
    probed = stored(_probed(_probes(chunks, model.bits), model.segments), "lm-levels")
    return stored(chunks.groupBy("uid").cogroup(probed.groupBy("uid")).applyInArrow(each, "uid long, score double"), "lm-sums")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model.hot)
    kind = dict(docs.dtypes)[key]

    def each(batches):
        from pyspark import TaskContext

        hot = shared.value
        hashes, uid = WordHash(), TaskContext.get().partitionId() << 40
        held, lengths, chunk = [], [], uid
        logs = {w: math.log10(n + 1) for w, n in hot.items()}
        for part, texts in _texts(batches, 1):
            each = [words_of(t) for t in texts]
            sizes = np.array([len(w) for w in each])
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            words = [x for w in each for x in w]
            h = hashes.of(words)
            _, at, place = np.unique(h, return_index=True, return_inverse=True)
            names = [words[i] for i in at.tolist()]
            exact = np.array([logs.get(w, np.nan) for w in names])
            cold = np.isnan(exact)[place]
            sums = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023
            # rare words of each text, with how often they occur in it
            text = np.repeat(np.arange(len(each)), sizes)[cold]
            rare, times = np.unique(text * len(names) + place[cold], return_counts=True)
            ends = np.r_[0, np.searchsorted(rare, np.arange(1, len(each) + 1) * len(names))].astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(names, pa.binary()).take(pa.array(rare % len(names))), pa.array(times, pa.int64())], ["word", "n"])
            arrays = [
                pa.array(np.arange(uid, uid + len(each))), part.column(0), pa.array(sizes, pa.int64()), pa.array(sums(np.nan_to_num(exact)[place])),
                pa.array(sums((~cold).astype(np.int64))), pa.ListArray.from_arrays(pa.array(ends), items),
            ]
            uid += len(each)
            held.append(h)
            lengths.append(sizes)
            yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(each), packed)], fields)
            if sum(map(len, held)) >= CHUNK:
                yield packed_row(chunk, held, lengths)
                held, lengths, chunk = [], [], uid
        if held:
            yield packed_row(chunk, held, lengths)

    fields = ["uid", "key", "n_tokens", "base", "known", "rare", "chunk"]
    packed = pa.struct([("uid", pa.int64()), ("sizes", pa.binary()), ("ids", pa.binary()), ("hashes", pa.binary())])
    key_type = to_arrow_type(docs.schema[key].dataType)
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def packed_row(uid, held, lengths):
        row = pa.array([_chunk_row(uid, np.concatenate(held), np.concatenate(lengths))], packed)
        kinds = [pa.int64(), key_type, pa.int64(), pa.float64(), pa.int64(), rare_type]
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), row], fields)

    schema = f"uid long, key {kind}, n_tokens long, base double, known long, rare array<struct<word:binary,n:long>>, chunk struct<uid:long,sizes:binary,ids:binary,hashes:binary>"
    both = stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(each, schema), "lm-scores")
    first = both.filter("uid is not null").drop("chunk")
    scores = _scored(both.filter("uid is null").select("chunk.*"), model)
    cold = first.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    joined = cold.join(model.rare, "word").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    per_token = math.log10(model.tokens + model.distinct + 1)
    return first.drop("rare").join(joined, "uid", "left").join(scores, "uid").select(
        F.col("key").alias(key),
        (fold("key") == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        "score",
    )


def digest(docs: DataFrame) -> DataFrame:
    model = train(docs.filter((fold() != HELD_OUT) | F.col("doc_id").isNull()).select("text"))
    return score(docs, model)
