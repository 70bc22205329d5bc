import random
import zlib

import pytest

from hilandera.functions import scans
from hilandera.llm import releases, tree_contraction
from hilandera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def replayed(rows):
    """The contract, turn by turn."""
    named = lambda v: "" if v is None else str(v)
    groups, out = {}, []
    for conv, turn, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, zlib.crc32((text or "").encode()), turn))
    for conv, turns in groups.items():
        done = []
        for p, (_, _, crc, turn) in enumerate(sorted(turns, key=lambda t: t[:3])):
            h = lambda k: zlib.crc32(f"{k}:{named(conv)}:{named(turn)}".encode())  # noqa: B023, E731
            back = h(0) % 5
            parent = done[p - back] if 0 < back <= p else None
            if parent and parent["status"] != "delivered":
                done.append({"status": "blocked", "attempts": 0, "first": None, "last": None, "turn": turn, "crc": crc})
                continue
            at = first = max(7 * p, parent["last"] if parent else 0)
            repaired, n = 7 * p + h(2) % 101, 1
            fails = lambda: h(1) % 101 < 50 and (at < repaired or h(n + 2) % 3 == 0)  # noqa: B023, E731
            while fails() and n < 6:
                at, n = at + 10 * 2 ** (n - 1), n + 1
            done.append({"status": "dead" if fails() else "delivered", "attempts": n, "first": first, "last": at, "turn": turn, "crc": crc})
        free = sorted((d["last"], d["turn"] is not None, d["turn"] or 0, d["crc"], p) for p, d in enumerate(done) if d["status"] == "delivered")
        state = 0
        for k, (*_, crc, p) in enumerate(free, 1):
            state += k * crc
            done[p] |= {"no": k, "state": (state + 2**63) % 2**64 - 2**63}
        out += [(conv, d["turn"], d["status"], d["attempts"], d["first"], d["last"], d.get("no"), d.get("state")) for d in done]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_the_replay(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text").collect()
    assert rows_of(QUERIES["op11_releases"](spark, SF)) == replayed(map(tuple, turns))


def test_one_long_conversation_and_odd_turns(spark, monkeypatch):
    # several levels of blocks within the long conversation; its states go beyond 64 bits
    monkeypatch.setattr(releases, "BLOCK", 32)
    monkeypatch.setattr(scans, "FAN", 8)
    rng = random.Random(4)
    rows = [(9, 3 * i - 500, f"text {rng.randrange(40)}") for i in range(9000)]
    rows += [(None, None, "x"), (None, 3, None), (None, 3, ""), (2, 7, "a"), (2, 7, "a"), (2, 7, "b"), (2, None, "z"), (3, -5, None)]
    turns = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, text string, state string, parent string").repartition(3)
    assert rows_of(releases.digest(turns)) == replayed(rows)
    assert releases.digest(turns.limit(0)).count() == 0


def test_no_turn_is_later_than_its_bound(spark):
    rng = random.Random(8)
    turns, at = [], []
    for p in range(600):
        back = rng.randrange(5)
        parent = p - back if 0 < back <= p else None
        repair = 7 * p + rng.randrange(101) if rng.random() < 0.5 else None
        holds = [rng.random() < 0.6 for _ in range(6)]
        turns.append((p, 0, p, parent, 7 * p, repair, holds))
        start = max(7 * p, at[parent] if parent is not None and at[parent] is not None else 0)
        good = [start + a for a, h in zip(releases.ATTEMPTS, holds, strict=True) if repair is None or h and start + a >= repair]
        blocked = parent is not None and at[parent] is None
        at.append(None if blocked or not good else good[0] if repair is not None else start)
    df = spark.createDataFrame(turns, "id long, first long, p long, parent long, arrival long, repair long, holds array<boolean>")
    latest = {r.id: r.latest for r in releases.bounded(df).collect()}
    assert all(a is None or a <= latest[p] for p, a in enumerate(at))
    assert max(latest[p] - 7 * p for p in latest) < 3000
    done = {r.id: r.last_at if r.status == "delivered" else None for r in releases.deliver(df).collect()}
    assert done == dict(enumerate(at))


def piecewise(rng):
    starts = sorted({0, *(rng.randrange(1, 300) for _ in range(rng.randint(0, 4)))})
    return [(lo, rng.randrange(2), c) if (c := rng.choice([None, *[rng.randrange(80)] * 12])) is not None else (lo, 0, None) for lo in starts]


def value(fn, x):
    if x is None:
        return None
    _, slope, c = [p for p in fn if p[0] <= x][-1]
    return None if c is None else c + slope * x


@pytest.mark.parametrize("shape", ["chain", "star", "mixed"])
def test_trees_equal_a_walk_from_the_root(spark, shape):
    rng = random.Random(shape)
    nodes, at = [], {}
    for i in range(120):
        parent = None if i == 0 or i % 41 == 0 else {"chain": i - 1, "star": i - i % 41, "mixed": rng.randrange(max(0, i - 4), i)}[shape]
        fn = piecewise(rng)
        at[i] = value(fn, 0 if parent is None else at[parent])
        nodes.append((i, parent, fn, None))
    df = spark.createDataFrame(nodes, f"id long, parent long, fn {tree_contraction.PIECES}, latest long")
    assert {r.id: r.at for r in tree_contraction.times(df).collect()} == at
    assert tree_contraction.times(df.limit(0)).count() == 0
