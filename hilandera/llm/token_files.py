"""Token ids as bit-packed files.

Texts are range-partitioned and sorted by key; each task encodes its documents, appends the end id
and streams the ids into one file, every id in the fewest bits that hold the vocabulary:

    magic "TIDP", version, bits, block length; then blocks of 65,536 ids, packed from the low bit
    on; then the footer: block offsets, document keys and first positions; then the footer's length.

Any run of ids is read by seeking to its blocks and unpacking them with numpy. A file is written
under a hidden name and renamed when whole. Both names are those of the attempt, so a lost executor's
task can run again; the folder's index (one row a file) is written last, names the files of the attempts
that counted and makes them visible. Files are
opened by URI in the shared folder, whatever file system that is.

Words are encoded with the tokenizers library and remembered in a bounded cache: texts are cut at
ASCII white space, which no token of this vocabulary crosses.

Defined cases: a null or empty text has the end id alone; a null key comes first; rows with equal
keys are ordered by their texts; an empty table gives an index without files; other columns are not
written.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hilandera.llm.common import new_folder
from hilandera.llm.word_cache import PLAIN, WordCache, load, packed

END_ID = 1
BLOCK = 65_536
#: Bytes of text for each file, and the most files that a folder gets (they grow beyond).
FILE_BYTES = 32 << 20
MAX_FILES = 20_000
CACHE_WORDS = 250_000
_HEAD = struct.Struct("<4sBBxxI")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :bits] = each
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


class WordIds(WordCache):
    """Words as bytes without white space."""

    def ids(self, word: bytes) -> bytes:
        lower = word.decode().lower()
        plain = PLAIN.fullmatch(lower)
        if not plain:
            return packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        letters, marks = plain.groups()
        return self[letters.encode()] + self[marks.encode()] if marks else self.piece(letters)

    def encode(self, text: bytes) -> bytes:
        # ASCII letters are lowered here for the cache's sake, but not in a special token's name
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


class Writer:
    """Streams documents into one file."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.at = sink, bits, _HEAD.size
        self.blocks, self.keys, self.starts, self.n, self.held, self.n_held = [], [], [], 0, [], 0
        sink.write(_HEAD.pack(b"TIDP", 1, bits, BLOCK))

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 16 * BLOCK:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        for i in range(0, n, BLOCK):
            self.blocks.append(self.at)
            self.at += self.sink.write(data := pack(ids[i : min(i + BLOCK, n)], self.bits)) or len(data)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        known = np.array([k is not None for k in self.keys], np.uint8)
        parts = [np.array([len(self.blocks), len(self.keys), self.n], "<i8"), np.array(self.blocks, "<i8"), np.array([k or 0 for k in self.keys], "<i8"), np.array([*self.starts, self.n], "<i8"), known]
        footer = b"".join(p.tobytes() for p in parts)
        self.sink.write(footer + struct.pack("<q", len(footer)))


class Reader:
    """Random access to a file's documents and ids."""

    def __init__(self, source):
        self.source, end = source, source.size()
        magic, version, self.bits, self.block = _HEAD.unpack(source.read_at(_HEAD.size, 0))
        if magic != b"TIDP" or version != 1:
            raise ValueError("not a file of token ids")
        (length,) = struct.unpack("<q", source.read_at(8, end - 8))
        footer = source.read_at(length, end - 8 - length)
        n_blocks, n_docs, self.n = np.frombuffer(footer, "<i8", 3).tolist()
        parts = np.split(np.frombuffer(footer, "<i8", n_blocks + 2 * n_docs + 1, 24), [n_blocks, n_blocks + n_docs])
        self.blocks, self.keys, self.starts = parts
        self.known = np.frombuffer(footer, np.uint8, n_docs, length - n_docs)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at positions start to end - 1 of the file."""
        if start >= end:
            return np.empty(0, "<u4")
        out = []
        for b in range(start // self.block, (end - 1) // self.block + 1):
            first, n = b * self.block, min(self.block, self.n - b * self.block)
            out.append(unpack(self.source.read_at((n * self.bits + 7) // 8, int(self.blocks[b])), self.bits, n)[max(0, start - first) : end - first])
        return np.concatenate(out)

    def documents(self, most: int = 16 * BLOCK):
        """(key, start, ids) of each document, some `most` ids at a time."""
        i, n = 0, len(self.keys)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most, "right")) - 1)
            held, base = self.ids(int(self.starts[i]), int(self.starts[j])), int(self.starts[i])
            for k in range(i, j):
                a, b = int(self.starts[k]), int(self.starts[k + 1])
                yield (int(self.keys[k]) if self.known[k] else None), a, held[a - base : b - base]
            i = j


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes docs' ids in ascending order of key into files in `folder` (a URI); returns the
    folder's index: file (in order), docs, ids, start (ids in all files before it)."""
    path = path or default_tokenizer()
    bits = bits_for(max(load(path).get_vocab_size(with_added_tokens=True), end_id + 1))
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_files = min(MAX_FILES, max(1, math.ceil(n_bytes / FILE_BYTES)))
    order = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def write(batches):
        words, end, writer = WordIds(path, limit=CACHE_WORDS), np.array([end_id], "<u4").tobytes(), None
        place, name = _open(folder)
        task = TaskContext.get()
        file = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tid"
        part = f"{name}/.{file}"
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if writer is None:
                    place.create_dir(name, recursive=True)
                    writer = Writer(place.open_output_stream(part), bits)
                writer.add(k, np.frombuffer(words.encode(t or b"") + end, "<u4"))
        if writer is not None:
            writer.close()
            writer.sink.close()
            place.move(part, f"{name}/{file}")
            yield pa.RecordBatch.from_pylist([{"file": file, "docs": len(writer.keys), "ids": writer.n}])

    done = order.repartitionByRange(n_files, "key").sortWithinPartitions("key", "text").mapInArrow(write, "file string, docs long, ids long")
    # one row for each file, at most MAX_FILES
    rows, start, spark = sorted(done.collect()), 0, docs.sparkSession
    listed = []
    for r in rows:
        listed.append((r["file"], r["docs"], r["ids"], start))
        start += r["ids"]
    index = spark.createDataFrame(listed, "file string, docs long, ids long, start long")
    index.coalesce(1).write.parquet(f"{folder}/index")
    return index


def read_token_files(spark, folder: str) -> DataFrame:
    """key, start (ids of all documents before it), ids (binary, little-endian unsigned 32-bit) of each document."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                place, name = _open(f"{folder}/{row['file']}")
                out, size = [], 0
                with place.open_input_file(name) as source:
                    for k, at, ids in Reader(source).documents():
                        out.append({"key": k, "start": row["start"] + at, "ids": ids.tobytes()})
                        size += len(ids)
                        if size > 16 * BLOCK:
                            yield pa.RecordBatch.from_pylist(out, _READ)
                            out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, _READ)

    index = spark.read.parquet(f"{folder}/index")
    n = max(1, index.count())
    return index.repartitionByRange(n, "file").mapInArrow(read, "key long, start long, ids binary")


_READ = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def digest(docs: DataFrame) -> DataFrame:
    """Writes the files and, read back from them, gives one row for each document."""
    folder = new_folder(docs.sparkSession, "token-ids")
    write_token_files(docs, folder)
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return read_token_files(docs.sparkSession, folder).select(F.col("key").alias("doc_id"), "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
