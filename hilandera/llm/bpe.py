"""BPE encoding and decoding through a distinct-word table.

1. Texts are split into words (a word takes the one space before it; runs of white space follow the
   tokenizer's own rule; special tokens are words), so that the library's ids of a text are the ids of
   its words, one after the other. A task puts its texts in chunks, which hold each distinct word
   once, under a number, and the texts as these numbers by position.
2. The distinct-word table lies in buckets by a word's hash: each chunk sends its words to their
   buckets, packed, and there every distinct word of all documents is encoded exactly once.
3. The ids go back to the chunks that asked, and are joined to the texts by position.
4. Decoding joins ids to pieces (one row for each id of the vocabulary, a bounded table that every
   worker holds; the join's probe is a gather by id) and reads the joined bytes as UTF-8.

Chunks are written to the shared folder before anything is sent, so a lost executor's work is done
again on the same numbers; what they sent is deleted once it is answered. A word goes to its bucket once for each chunk, however often it occurs; a
bucket holds the words of some BUCKET_BYTES of text, so both stay bounded as the corpus grows. A text
is never parted: a chunk holds CHUNK words, or one longer text.

Defined cases: a null or empty text has no ids and decodes to the empty text; special tokens in a
text become their ids, as in the library; repeated rows are encoded alike; an empty table gives no
rows; other columns are kept, and `ids` and `decoded` get a trailing underscore where the table has
such columns.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hilandera.llm.common import delete, free_name, lean_writes, new_folder, stored
from hilandera.llm.word_cache import PLAIN, WordCache, byte_letters, load, packed

#: Words and distinct words of a chunk.
CHUNK, CHUNK_WORDS = 2_000_000, 600_000
#: Bytes of text for each bucket of the word table.
BUCKET_BYTES = 16 << 20
#: Words whose ids are gathered, and ids that are decoded, at a time.
SLICE_IDS = 200_000
SLICE_ROWS = 512
#: Of zstandard, and the numbers of words that take one byte.
LEVEL, SHORT = 9, 224
#: What Unicode calls white space, as the tokenizer's pattern reads \s.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Splitter:
    """A text's words: special tokens, and the units between them."""

    def __init__(self, special):
        self.around = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __call__(self, text: str) -> list[str]:
        if self.around is None or not self.around.search(text):
            return UNIT.findall(text)
        out, start = [], 0
        for m in self.around.finditer(text):
            out += [*UNIT.findall(text[start : m.start()]), m[0]]
            start = m.end()
        return out + UNIT.findall(text[start:])


class WordTable(WordCache):
    """word -> its ids, each word encoded when it is first asked for."""

    def __init__(self, path: str, known: dict[str, bytes] | None = None):
        super().__init__(path, known, 1 << 62)
        self.special = special_tokens(self.tokenizer)
        self.split = Splitter(self.special)

    def ids(self, word: str) -> bytes:
        if word in self.special:
            return packed([self.special[word]])
        plain = PLAIN.fullmatch(word)
        if not plain:
            return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        letters, marks = plain.groups()
        return self[letters] + self[marks] if marks else self.piece(letters)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


def special_tokens(tokenizer) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}


def pieces(path: str) -> list[bytes]:
    """The bytes of each id's piece."""
    vocabulary = load(path).get_vocab(with_added_tokens=True)
    byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = b"".join(byte.get(c) or c.encode() for c in piece)
    return out


class Lists:
    """Lists of one kind laid end to end; gather() joins those at some places."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes.astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items, and where each place's items end."""
        n = self.sizes[places]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[places] - (ends - n), n)], ends


@lru_cache(maxsize=2)
def _pieces(path: str) -> Lists:
    every = pieces(path)
    return Lists(np.frombuffer(b"".join(every), np.uint8), np.array([len(x) for x in every]))


@lru_cache(maxsize=2)
def _special(path: str) -> dict[str, int]:
    return special_tokens(load(path))


@lru_cache(maxsize=2)
def _empty_table(path: str) -> WordTable:
    return WordTable(path)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 in the fewest bytes that hold each, compressed, behind that width."""
    import zstandard

    width = 4 if len(numbers) and numbers.max() >= 1 << 16 else 2 if len(numbers) and numbers.max() >= 1 << 8 else 1
    return bytes([width]) + zstandard.compress(numbers.astype(f"<u{width}").tobytes(), LEVEL)


def _numbers(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data[1:]), f"<u{data[0]}").astype("<u4")


def _squeezed_ranks(ranks: np.ndarray) -> list[bytes]:
    """Numbers of which small ones are frequent: a byte for those below SHORT; of the others the high
    bits in that byte (or, beyond it, in a list of their own) and the two low bytes apart."""
    long = ranks >= SHORT
    rest = ranks[long] - np.uint32(SHORT)
    first, high = ranks.astype(np.uint8), rest >> 16
    first[long] = np.minimum(SHORT + high, 255)
    return [_squeezed(x) for x in (first, rest >> 8 & 255, rest & 255, high[high >= 255 - SHORT])]


def _ranks(parts: list[bytes]) -> np.ndarray:
    first, middle, low, higher = map(_numbers, parts)
    out = first.astype(np.uint32)
    long = out >= SHORT
    high = out[long] - np.uint32(SHORT)
    high[high == 255 - SHORT] = higher
    out[long] = SHORT + (high << 16 | middle << 8 | low)
    return out


class _Numbering(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Texts as numbers of their distinct words, and the columns that go along."""

    def __init__(self):
        self.number, self.places, self.sizes, self.kept, self.n = _Numbering(), [], [], [], 0

    def add(self, texts: list[list[str]], kept: pa.RecordBatch) -> None:
        self.sizes += map(len, texts)
        words = [w for t in texts for w in t]
        self.places.append(np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words)))
        self.kept.append(kept)
        self.n += len(words)

    def rows(self, uid: int, bits: int):
        """The chunk's own row and one for each bucket that it asks."""
        import xxhash
        import zstandard

        # words are numbered anew, the frequent ones first
        places = np.concatenate(self.places)
        order = np.argsort(-np.bincount(places, minlength=len(self.number)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        words = list(self.number)
        words = [words[i] for i in order.tolist()]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.kept[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(self.kept))
        yield {"uid": uid, "places": _squeezed_ranks(rank[places]), "sizes": _squeezed(np.array(self.sizes, np.int64)), "buckets": _squeezed(bucket), "kept": sink.getvalue().to_pybytes()}
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(words) else np.empty(0, np.int64)
        for a, b in zip(at, [*at[1:], len(words)], strict=True):
            some = [words[i] for i in order[a:b].tolist()]
            lengths = _squeezed(np.array([len(w) for w in some]))
            yield {"uid": uid, "bucket": int(bucket[order[a]]), "lengths": lengths, "words": zstandard.compress("".join(some).encode(), LEVEL)}


_CHUNKS = "uid long, places array<binary>, sizes binary, buckets binary, kept binary, bucket long, lengths binary, words binary"
_ARROW_CHUNKS = pa.schema([("uid", pa.int64()), ("places", pa.list_(pa.binary())), ("sizes", pa.binary()), ("buckets", pa.binary()), ("kept", pa.binary()), ("bucket", pa.int64()), ("lengths", pa.binary()), ("words", pa.binary())])


def _chunks(docs: DataFrame, text: str, path: str, bits: int, keep: list[str]) -> DataFrame:
    """The chunks of the texts and, as rows with a bucket, the words that they ask for."""

    def cut(batches):
        from pyspark import TaskContext

        split, uid, held = Splitter(_special(path)), TaskContext.get().partitionId() << 32, Chunk()
        for b in batches:
            for s in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(s, SLICE_ROWS)
                texts = part.column(b.num_columns - 1).to_pylist()
                kept = part.select(list(range(b.num_columns - 1)))
                start = 0
                while start < len(texts):
                    end, some = start, []
                    while end < len(texts) and held.n + sum(map(len, some)) < CHUNK and (not some or len(some) < 64):
                        some.append(split(texts[end] or ""))
                        end += 1
                    held.add(some, kept.slice(start, end - start))
                    start = end
                    if held.n >= CHUNK or len(held.number) >= CHUNK_WORDS:
                        yield pa.RecordBatch.from_pylist(list(held.rows(uid, bits)), _ARROW_CHUNKS)
                        uid, held = uid + 1, Chunk()
        if held.kept:
            yield pa.RecordBatch.from_pylist(list(held.rows(uid, bits)), _ARROW_CHUNKS)

    return docs.select(*keep, F.col(text).alias("\ttext")).mapInArrow(cut, _CHUNKS)


def _asked(row_lengths: bytes, row_words: bytes) -> list[str]:
    import zstandard

    ends = np.cumsum(_numbers(row_lengths)).tolist()
    every = zstandard.decompress(row_words).decode()
    return [every[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def answers(asked, known: WordTable):
    """(sizes, ids) of the words of each question, squeezed; a word of all questions is encoded once."""
    for words in asked:
        ids = [known[w] for w in words]
        yield _squeezed(np.array([len(x) // 4 for x in ids])), _squeezed(np.frombuffer(b"".join(ids), "<u4"))


def _encoded_words(asked: DataFrame, path: str) -> DataFrame:
    """uid, bucket, sizes, ids: a bucket's part of the word table, as each chunk asked for it."""

    def encode(group: pa.Table) -> pa.Table:
        known = _empty_table(path)
        known.clear()
        rows = zip(group.column("lengths").to_pylist(), group.column("words").to_pylist(), strict=True)
        found = list(answers((_asked(*r) for r in rows), known))
        known.clear()
        return pa.table({"uid": group.column("uid"), "bucket": group.column("bucket"), "sizes": pa.array([x for x, _ in found], pa.binary()), "ids": pa.array([x for _, x in found], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(encode, "uid long, bucket long, sizes binary, ids binary")


def _slices(ends: np.ndarray):
    """(start, stop, first, last): lists start to stop, which hold the items first to last, SLICE_IDS at most or
    one longer list; ends: where each list's items end."""
    start = 0
    while start < len(ends):
        first = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, first + SLICE_IDS, "right")))
        yield start, stop, first, int(ends[stop - 1])
        start = stop


def _decoded(ids: np.ndarray, ends: np.ndarray, path: str) -> list[str]:
    """The texts of lists of ids that end at `ends`."""
    out = []
    for start, stop, first, last in _slices(ends):
        data, upto = _pieces(path).gather(ids[first:last])
        data, upto = data.tobytes(), np.r_[0, upto]
        cuts = upto[np.r_[0, ends[start:stop] - first]].tolist()
        out += [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def _texts(words: Lists, places: np.ndarray, sizes: np.ndarray, path: str, decode: bool):
    """(start, stop, columns) of texts in turn: their ids and, if asked for, what these stand for. words: the ids of
    each word; a text takes the next of `sizes` in `places`. Only some texts' ids are numbers at a time."""
    for start, stop, first, last in _slices(np.cumsum(sizes, dtype=np.int64)):
        ids, ends = words.gather(places[first:last])
        ends = np.r_[0, ends][np.cumsum(sizes[start:stop], dtype=np.int64)]
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        found = [pa.array([data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())]
        if decode:
            found.append(pa.array(_decoded(ids, ends, path), pa.string()))
        yield start, stop, found


def _joined(chunks: DataFrame, answered: DataFrame, fields: list, path: str, decode: bool) -> DataFrame:
    names = [f.name for f in fields]

    def each(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        (row,) = chunk.to_pylist()
        places, sizes, bucket = _ranks(row["places"]), _numbers(row["sizes"]), _numbers(row["buckets"])
        answer = answer.sort_by("bucket")
        counts = np.empty(len(bucket), np.uint32)
        order = np.argsort(bucket, kind="stable")
        by_bucket = np.concatenate([np.empty(0, "<u4"), *map(_numbers, answer.column("sizes").to_pylist())])
        flat = np.concatenate([np.empty(0, "<u4"), *map(_numbers, answer.column("ids").to_pylist())]).astype("<u4")
        # words by number: their ids stay in the order of the answers
        words = Lists(flat, by_bucket)
        counts[order] = np.arange(len(order))
        kept = pa.ipc.open_stream(row["kept"]).read_all()
        found = _texts(words, counts[places], sizes, path, decode)
        return pa.concat_tables(pa.Table.from_arrays([*kept.slice(a, b - a).columns, *columns], names=names) for a, b, columns in found)

    return chunks.groupBy("uid").cogroup(answered.groupBy("uid")).applyInArrow(each, T.StructType(fields))


def _encode(docs: DataFrame, text: str, path: str | None, keep: list[str] | None, decode: bool) -> DataFrame:
    path, keep = path or default_tokenizer(), docs.columns if keep is None else keep
    out = [T.StructField(free_name(docs, "ids"), T.BinaryType())]
    if decode:
        out.append(T.StructField(free_name(docs, "decoded"), T.StringType()))
    n_docs, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    bits = (max(1, math.ceil(n_bytes / BUCKET_BYTES)) - 1).bit_length()
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "bpe-chunks")
    with lean_writes(spark):
        _chunks(docs, text, path, bits, keep).withColumn("asks", F.col("bucket").isNotNull()).write.partitionBy("asks").parquet(folder)

    def read(asks: str, columns: str) -> DataFrame:
        # a folder that no row went to is not there
        there = n_docs if asks == "false" else n_bytes
        return spark.read.schema(columns).parquet(f"{folder}/asks={asks}") if there else spark.createDataFrame([], columns)

    answered = stored(_encoded_words(read("true", "uid long, bucket long, lengths binary, words binary"), path), "bpe-words")
    delete(spark, f"{folder}/asks=true")
    chunks = read("false", "uid long, places array<binary>, sizes binary, buckets binary, kept binary")
    return _joined(chunks, answered, [*(docs.schema[c] for c in keep), *out], path, decode)


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with `ids`: the text's token ids as little-endian unsigned 32-bit integers (binary)."""
    return _encode(docs, text, path, keep, False)


def decode_documents(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with `decoded`: the text that the ids stand for, special tokens included."""
    path, out = path or default_tokenizer(), free_name(encoded, "decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def decode(batches):
        for b in batches:
            for s in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(s, SLICE_ROWS)
                lists = [x or b"" for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
                texts = _decoded(np.frombuffer(b"".join(lists), "<u4"), np.cumsum([len(x) // 4 for x in lists]), path)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    return encoded.mapInArrow(decode, schema)


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with `ids` and with `decoded`, which is read from the ids alone."""
    return _encode(docs, text, path, keep, True)


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: the number of its ids, their SHA-256 and that of the decoded text."""
    return round_trip(docs.select("doc_id", "text"), keep=["doc_id"]).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
