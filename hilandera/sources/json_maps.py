"""JSON objects of any size, read in ranges of bytes by several tasks.

Whether a range begins within a string, and how deep, follows from all bytes before it. A first pass tells for
each range what it makes of either beginning (inside a string or not: where it ends, and by how much
deeper); these are put together in order, a few numbers a range. A second pass then reads each entry of
the outermost object in the range that holds the brace or comma before it, on beyond the range's end where
the entry goes on.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, and by how much a reader goes on for an entry's end.
RANGE_BYTES, MORE = 8 << 20, 1 << 16
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*+"?|[{}\[\],]', re.S)
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*+("?)', re.S)
_DEEPER = {b"{": 1, b"[": 1, b"}": -1, b"]": -1}


def read_bytes(path: str, start: int, end: int) -> bytes:
    """Bytes start to end - 1 of a file that its URI names."""
    from pyarrow import fs

    place, name = fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
    with place.open_input_file(name) as source:
        return source.read_at(max(0, end - start), start)


def _start(path: str, at: int, inside: bool) -> int:
    """at, or the next byte if the one at `at` is escaped."""
    back, reach = 0, 16
    while inside and at:
        before = read_bytes(path, max(0, at - reach), at)
        back = len(before) - len(before.rstrip(b"\\"))
        if back < len(before) or reach >= at:
            break
        reach *= 16
    return at + back % 2


def tokens(data: bytes, inside: bool):
    """(place, token) of strings, brackets and commas; inside: whether data begins within a string."""
    at = 0
    if inside:
        at = _STRING_END.match(data).end()
        yield 0, b'"'
    for m in _TOKEN.finditer(data, at):
        yield m.start(), m[0]


def ends(data: bytes, inside: bool) -> tuple[bool, int]:
    """(whether data ends within a string, how much deeper it ends)."""
    deeper, last = 0, (0, b"")
    for place, token in tokens(data, inside):
        deeper += _DEEPER.get(token, 0)
        last = place, token
    if inside and not last[0]:
        return not _closed(data, 0), deeper
    return last[1][:1] == b'"' and not _closed(data, last[0] + 1), deeper


def _closed(data: bytes, at: int) -> bool:
    """Whether the string whose inside begins at `at` ends in data."""
    return bool(_STRING_END.match(data, at)[1])


def entries(path: str, size: int, start: int, end: int, inside: bool, depth: int):
    """(key, value as JSON) of the outermost object's entries whose brace or comma lies in [start, end)."""
    first = _start(path, start, inside)
    data, at, open_, skip = read_bytes(path, first, end), first, None, inside
    while True:
        level = depth
        for place, token in tokens(data, skip):
            before, level = level, level + _DEEPER.get(token, 0)
            stops = before == 1 and token in (b",", b"}")
            if open_ is not None and stops:
                if text := data[open_ - at : place].strip():
                    (item,) = json.loads(b"{" + text + b"}").items()
                    yield item[0], json.dumps(item[1], ensure_ascii=False)
                open_ = None
            if at + place >= end:
                if open_ is None:
                    return
            elif token == b"{" and before == 0 or token == b"," and before == 1:
                open_ = at + place + 1
        if open_ is None or at + len(data) >= size:
            return
        # the last entry goes on: read it again from its beginning, with more behind it
        more = max(MORE, at + len(data) - open_)
        data, at, skip, depth = read_bytes(path, open_, min(size, at + len(data) + more)), open_, False, 1


def read_map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """k, v (of the type `kind`) of the entries of a JSON object in one file; AnalysisException if it is missing."""
    (file,) = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    name, size = file["path"], file["length"]
    ranges = spark.range(0, size, RANGE_BYTES, numPartitions=max(1, -(-size // RANGE_BYTES))).select(F.col("id").alias("start"), F.least(F.col("id") + RANGE_BYTES, F.lit(size)).alias("end"))

    def both(frames):
        for f in frames:
            for start, end in zip(f["start"], f["end"], strict=True):
                row = {"start": start}
                for inside in (False, True):
                    row[f"in{inside:d}"], row[f"by{inside:d}"] = ends(read_bytes(name, _start(name, start, inside), end), inside)
                yield pd.DataFrame([row])

    begins, inside, depth = {}, False, 0
    for r in sorted(ranges.mapInPandas(both, "start long, in0 boolean, by0 long, in1 boolean, by1 long").collect()):
        begins[r["start"]] = inside, depth
        inside, depth = (r["in1"], depth + r["by1"]) if inside else (r["in0"], depth + r["by0"])

    def read(frames):
        for f in frames:
            for start, end in zip(f["start"], f["end"], strict=True):
                yield pd.DataFrame(list(entries(name, size, start, end, *begins[start])), columns=["k", "v"])

    wrapped = F.from_json(F.concat(F.lit('{"v":'), F.col("v"), F.lit("}")), f"v {kind}")
    return ranges.mapInPandas(read, "k string, v string").select("k", wrapped["v"].alias("v"))
