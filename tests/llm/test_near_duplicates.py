import numpy as np
import pytest
import xxhash

from hilandera.llm import components as cc
from hilandera.llm import cover_tree, simhash

from .conftest import ROWS, by_id


def plain_components(n, linked):
    return cc.local_components(n, [np.nonzero(linked)])


def test_components_of_a_table(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(1000, i) for i in range(1001, 1400)]
    found = {r.node: r.root for r in cc.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    a, b = np.array(pairs).T
    label = cc.local_components(1400, [(a, b)])
    assert found == {i: int(label[i]) for p in pairs for i in p if p[0] != p[1]}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints(spark, odd, none):
    found = by_id(simhash.digest(odd))
    for key, text, _ in ROWS:
        assert all(int(r.fingerprint, 16) == brute_fingerprint(text) for r in found[key])
    assert found[2][0].component_id == 1 and {found[k][0].component_id for k in (3, 4, 6)} == {3}
    assert simhash.digest(none).count() == 0 and simhash.one_of_each(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8, 9] and kept.columns == odd.columns


def test_hash_is_the_engines(spark):
    (r,) = spark.sql("select hex(xxhash64('the quick brown'))").collect()
    assert int(r[0], 16) == xxhash.xxh64_intdigest(b"the quick brown", 42)


def clustered():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = [rng.choice(base[:40], 300) ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64) for _ in range(m)]) for m in (1, 2, 3)]
    return np.unique(np.concatenate([base, *near, base[0] ^ rng.integers(0, 4096, 900, dtype=np.uint64)]))


@pytest.mark.parametrize("hot", [50_000, 100])
def test_links_connect_all_within_two_bits(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 128)
    x = clustered()
    links = simhash.links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"))
    found = {r.node: r.root for r in cc.components(links).collect()}
    groups = {}
    for v, k in zip(x.view(np.int64).tolist(), plain_components(len(x), np.bitwise_count(x[:, None] ^ x) <= 2).tolist(), strict=True):
        groups.setdefault(k, []).append(v)
    assert found == {v: min(g) for g in groups.values() if len(g) > 1 for v in g}


@pytest.mark.parametrize(("small", "dense"), [(2048, 4096), (30, 1), (2, 0)])
def test_tree_finds_all_within_two_bits(monkeypatch, small, dense):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "DENSE", dense)
    x = clustered()
    x = x[np.argsort(simhash._rank(x), kind="stable")]
    linked = np.bitwise_count(x[:, None] ^ x) <= 2
    pairs = {(a, b) for i, j in simhash.near_pairs(x, x) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert pairs == set(zip(*(k.tolist() for k in np.nonzero(linked)), strict=True))
    assert (cc.local_components(len(x), simhash.linked(x, np.arange(len(x)))) == plain_components(len(x), linked)).all()


def test_cells_hold_every_link_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 20)
    rng = np.random.default_rng(3)
    x = np.unique(np.uint64(0xABCDE << 44) ^ rng.integers(0, 1 << 14, 600, dtype=np.uint64) ^ (rng.integers(0, 3, 600, dtype=np.uint64) << np.uint64(40)))
    held = by_id(simhash.cells(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")), "fp")
    of = [{tuple(r.cell) for r in held[v]} for v in x.view(np.int64).tolist()]
    assert any(len(c) == 6 for c in set().union(*of))
    for a in range(0, len(x), 7):
        assert all(of[a] & of[b] for b in np.flatnonzero(np.bitwise_count(x ^ x[a]) <= 2).tolist())


def test_hot_keys_are_split(spark, monkeypatch):
    from hilandera.llm import common

    many = spark.createDataFrame([(i % 3 * (i % 2), i) for i in range(300)], "k long, v long")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, w string")
    expected = sorted(map(tuple, many.join(one, "k").select("k", "v", "w").collect()))
    for hot in (1_000_000, 60, 7):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert sorted(map(tuple, common.join_hot(many, one, "k").select("k", "v", "w").collect())) == expected


def vectors(seed, n, m, spread, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    base /= np.linalg.norm(base, axis=1)[:, None]
    return np.concatenate([base, base[rng.integers(0, n, m)] + rng.normal(size=(m, d)) * spread])


@pytest.mark.parametrize(("n", "m", "spread"), [(200, 200, 0.03), (10, 500, 0.05), (3, 600, 0.005), (1, 0, 0.1)])
def test_cell_links(n, m, spread):
    x = vectors(0, n, m, spread)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x, w, k = np.random.default_rng(2).permutation(x), np.random.default_rng(3).integers(1, 4, n + m).astype(float), max(1, (n + m) // 2)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    near[k:, k:] = False
    links, root = cover_tree.cell_links(x[:k], w[:k], x[k:], w[k:])
    assert (links == (near * w).sum(1)).all() and (root == plain_components(len(x), near)).all()


@pytest.mark.parametrize("node_rows", [4096, 100])
def test_cell_links_in_many_dimensions(monkeypatch, node_rows):
    monkeypatch.setattr(cover_tree, "NODE_ROWS", node_rows)
    x = vectors(4, 500, 900, 0.03, 64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x, w = np.random.default_rng(2).permutation(x), np.ones(len(x))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 1000
    for among in (True, False):
        near[700:, 700:] = False
        near[:700, :700] &= among
        links, root = cover_tree.cell_links(x[:700], w[:700], x[700:], w[700:], among=among)
        assert (links == near.sum(1)).all() and (root == plain_components(len(x), near)).all()


def test_vectors_in_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "CELL_ROWS", 200)
    monkeypatch.setattr(cover_tree, "VISITORS", 300)
    x = vectors(6, 900, 900, 0.025, 64).astype(np.float32)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = plain_components(len(u), near)
    found = {r.vec_id: r for r in cover_tree.digest(spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, n string")).collect()}
    assert all((found[i].n_links, found[i].component_id) == (int(near[i].sum()), int(root[i])) for i in range(len(u))) and near.sum() > 1000


@pytest.mark.parametrize(("cell", "visitors"), [(4096, 50_000), (40, 50_000), (40, 30)])
def test_vectors(spark, monkeypatch, cell, visitors):
    monkeypatch.setattr(cover_tree, "CELL_ROWS", cell)
    monkeypatch.setattr(cover_tree, "VISITORS", visitors)
    x = vectors(5, 150, 250, 0.03).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 60, 0), 3 * x[1:2]])
    rows = [(i + 10, v.tolist(), i % 10) for i, v in enumerate(x)]
    odd = [(1, None, 0), (2, [0.0] * 16, 0), (3, [float("nan")] * 16, 0), (4, [None, *[1.0] * 15], 0), (5, [1.0, 2.0], 0), (6, [2.0, 4.0], 0), (7, [], 0)]
    found = {r.vec_id: r for r in cover_tree.digest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = plain_components(len(u), near)
    for i in range(len(u)):
        r = found[i + 10]
        assert (r.n_links, r.component_id, r.kept) == (int(near[i].sum()), int(root[i]) + 10, bool(root[i] == i)), i
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i in (1, 2, 3, 4, 7))
    assert (found[5].n_links, found[6].component_id, found[6].kept) == (1, 5, False)
    assert cover_tree.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_random_vectors_leave_at_their_sketches_and_never_a_link(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "CELL_ROWS", 100)
    monkeypatch.setattr(cover_tree, "SKETCHES", 400)
    kept, stored = [], cover_tree.stored
    monkeypatch.setattr(cover_tree, "stored", lambda df, label, *a: (out := stored(df, label, *a), label == "kept" and kept.append(out))[0])
    x = vectors(8, 2400, 60, 0.02, 64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    found = {r.vec_id: r for r in cover_tree.digest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert near.sum() > 60 and all(found[i].n_links == near[i].sum() for i in range(len(x)))
    # of some 30,000 visits of vectors to cells
    assert sum(k.count() for k in kept) < 400


@pytest.mark.parametrize("d", [3, 64, 300])
def test_sketches_are_no_nearer_than_cosines(d):
    x = vectors(9, 700, 300, 0.3, d)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = cover_tree._sketches(x, cover_tree._directions(x[:20]))
    assert (s.astype(float) @ s.T.astype(float) >= x @ x.T - cover_tree.SLACK / 2).all()
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    cell, cells = np.arange(600) % 3, np.random.default_rng(1).integers(0, 8, 400).astype(np.uint8)
    met, kept = cover_tree.sieve(s[:600], cell.astype(np.uint8), s[600:], cells, 0.9)
    linked = [near[600:, np.flatnonzero(cell == k)].any(1) & (cells >> k & 1 > 0) for k in range(3)]
    assert all((kept[:, k] >= linked[k]).all() for k in range(3)) and not kept[:, 3:].any()
    assert (met >= (near[:600, :600] & (cell[:, None] == cell)).any(1)).all()
