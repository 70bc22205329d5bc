"""Periodic runs of words, found by Kolpakov and Kucherov's algorithm.

A run is a stretch [start, end) of a text's words whose smallest period is q, that no neighbour
extends keeping q, and that is at least max(6, 4 * q) words long. Texts are rows of Arrow batches;
nothing is shuffled, and no text waits for another.

1. Words that occur fewer than four times in a stretch lie in no run of it, as a run of exponent four
   shows each of its words four times. They part a text into stretches, again and again until
   nothing changes; what is left can be a few words of a long text. This drops no run.
2. A stretch is put into a suffix automaton, which gives its Lempel-Ziv factors: the longest prefix of
   what remains that occurs earlier (it may overlap itself), or one new word.
3. Main's algorithm finds the runs that end in a factor and begin at or before its start. The factor
   before could not be made longer, so such a run reaches less than its period beyond that factor,
   which bounds periods and looks back; four Z functions give how far each period holds.
4. All other runs lie within one factor behind its first word. They are copied from the factor's
   earlier occurrence; a run that goes beyond that occurrence is cut at the factor's end.

Each run has its last word in one factor and is found there once. The work is linear in a stretch's
words, and so is its memory (some 0.5 KB a word while the automaton stands).

Defined cases: a null or empty text has no words and no runs; a null doc_id is kept (as a number it is
the empty string); repeated rows are taken one by one; texts of any length are taken whole; an empty
table gives no rows; other columns are kept, and `runs` and `collapsed` get a trailing underscore
where the table has such columns.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hilandera.llm.common import ARROW_BYTES, free_name

#: A run's least length, in words and in periods.
LEAST, TIMES = 6, 4


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the stretches that can hold runs: LEAST words or more, each of which occurs
    TIMES times or more in its stretch."""
    out, open_ = [], [(0, len(ids))]
    while open_:
        start, end = open_.pop()
        if end - start < LEAST:
            continue
        _, kind, counts = np.unique(ids[start:end], return_inverse=True, return_counts=True)
        often = counts[kind] >= TIMES
        if often.all():
            out.append((start, end))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], often, [False])).astype(np.int8))) + start
        pairs = edges.reshape(-1, 2)
        open_ += map(tuple, pairs[pairs[:, 1] - pairs[:, 0] >= LEAST].tolist())
    return sorted(out)


class SuffixAutomaton:
    """All factors of a sequence; first[state] is where the state's factors first end."""

    def __init__(self, word):
        self.moves, self.link, self.length, self.first = [{}], [-1], [0], [-1]
        moves, link, length, first, last = self.moves, self.link, self.length, self.first, 0
        for i, w in enumerate(word):
            new = len(moves)
            moves.append({})
            length.append(i + 1)
            first.append(i)
            link.append(0)
            p = last
            while p >= 0 and w not in moves[p]:
                moves[p][w] = new
                p = link[p]
            if p >= 0:
                q = moves[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(moves)
                    moves.append(moves[q].copy())
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    while p >= 0 and moves[p].get(w) == q:
                        moves[p][w] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new


def factors(word) -> list[tuple[int, int, int]]:
    """(start, end, where it occurs earlier or -1) of each Lempel-Ziv factor."""
    automaton = SuffixAutomaton(word)
    moves, first, n, out, start = automaton.moves, automaton.first, len(word), [], 0
    while start < n:
        state, end, source = 0, start, -1
        while end < n:
            to = moves[state][word[end]]
            if first[to] >= end:  # its first occurrence is this one
                break
            state, end = to, end + 1
            source = first[state] - (end - start) + 1
        out.append((start, max(end, start + 1), source))
        start = out[-1][1]
    return out


def z_function(s) -> list[int]:
    """How many symbols s and its suffix from i on share at their starts, for each i."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _at_boundary(word, before: int, at: int, end: int) -> dict[tuple[int, int], int]:
    """(start, end) -> period of the runs that begin at `at` or earlier and whose last word lies in the
    factor [at, end); before: where the factor ahead of it begins."""
    u, v = at - before, end - at
    most = (u + v - 1) // (TIMES - 1)
    if most < 1 or not at:
        return {}
    right = word[at : min(end + 1, len(word))]  # one word more tells whether a run goes on
    left = word[max(0, at - 2 * u - v - most) : at]
    back = left[::-1]
    n, m = len(right), len(left)
    from_at = z_function(right)
    to_at = z_function(back)
    # the stretch from at - q on against that from at on, and what lies before at against what lies before at + q
    ahead = z_function(right + [-1] + left + right)
    behind = z_function(back + [-1] + right[::-1] + back)
    found = {}
    for q in range(1, most + 1):
        near = []
        if q < n and right[0] == right[q]:
            near.append((at - min(behind[m + 1 + n - q], m), at + q + from_at[q]))
        if q <= m and right[0] == word[at - q]:
            near.append((at - q - (to_at[q] if q < m else 0), at + min(ahead[n + 1 + m - q], n)))
        for start, stop in near:
            if start <= at < stop <= end and stop - start >= max(LEAST, TIMES * q) and found.get((start, stop), q) >= q:
                found[start, stop] = q
    return found


def runs_of(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of the sequence, by start, then period. Symbols are not negative."""
    starts: list[int] = []
    by_start: dict[int, list[tuple[int, int]]] = {}

    def add(start: int, stop: int, q: int) -> None:
        if start not in by_start:
            by_start[start] = []
            if starts and starts[-1] > start:
                starts.insert(bisect_left(starts, start), start)
            else:
                starts.append(start)
        by_start[start].append((stop, q))

    n, before = len(word), 0
    for at, end, source in factors(word):
        for (start, stop), q in sorted(_at_boundary(word, before, at, end).items()):
            add(start, stop, q)
        before = at
        if source < 0 or end - at < LEAST:
            continue
        k, shift = bisect_left(starts, source + 1), at - source
        while k < len(starts) and starts[k] < source + end - at:
            for stop, q in list(by_start[starts[k]]):
                start, stop = starts[k] + shift, min(stop + shift, end)
                if stop - start >= max(LEAST, TIMES * q) and (stop < end or stop == n or word[stop] != word[stop - q]):
                    add(start, stop, q)
            k += 1
    return sorted((start, stop - start, q) for start, ends in by_start.items() for stop, q in ends)


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a text's words, by start, then period."""
    if len(words) < LEAST:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    return [(a + start, length, q) for a, b in stretches(ids) for start, length, q in runs_of(ids[a:b].tolist())]


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    covers = np.zeros(len(words) + 1, np.int32)
    for start, length, q in runs:
        covers[start + q] += 1
        covers[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(covers[:-1]) == 0).tolist()]


def _batches(batches, change, names):
    """Some ARROW_BYTES of texts at a time."""
    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary())
        keys = batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < ARROW_BYTES):
                size += len(texts[stop].as_buffer() or b"") if texts[stop].is_valid else 0
                stop += 1
            rows = [change(t or b"", k) for t, k in zip(texts.slice(at, stop - at).to_pylist(), keys[at:stop], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.slice(at, stop - at).columns[2:], *(pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), names, strict=True))], names=[*batch.schema.names[2:], *(n for n, _ in names)])
            at = stop


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with runs (start, length, period of each) and collapsed (its words without repeated periods)."""
    runs, collapsed = free_name(docs, "runs"), free_name(docs, "collapsed")
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def change(t: bytes, _):
        words = t.split()
        found = find_runs(words)
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], b" ".join(kept_words(words, found)).decode()

    added = T.StructType.fromDDL(f"`{runs}` array<struct<start: long, length: long, period: long>>, `{collapsed}` string")
    schema = T.StructType([*docs.schema.fields, *added.fields])
    return docs.select(F.col(text).alias("_t"), F.lit(None).cast("long").alias("_k"), *(docs[c] for c in docs.columns)).mapInArrow(lambda b: _batches(b, change, [(runs, pa.list_(item)), (collapsed, pa.string())]), schema)


def planted(words: list, doc_id: int | None) -> list:
    """The words of the query's contract: a tenth of the documents repeats a stretch to its end."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


_DIGEST = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def _summary(text: bytes, doc_id: int | None) -> tuple:
    words = planted(text.split(), doc_id)
    found = find_runs(words)
    best = found[0] if found else None
    for r in found[1:]:
        more = r[1] * best[2] - best[1] * r[2]
        if more > 0 or more == 0 and (r[0], r[2]) < (best[0], best[2]):
            best = r
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = b"".join(b"%d,%d,%d\n" % r for r in found)
    return len(found), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, found))).hexdigest()


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: how many runs, the one of the greatest exponent, and what all of them
    and the collapsed text hash to."""
    rows = docs.select("text", "doc_id", F.col("doc_id").alias("_id"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return rows.mapInArrow(lambda b: _batches(b, _summary, _DIGEST), schema)
