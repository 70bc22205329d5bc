"""Communities and vector clusters against plain loops, on many small documents at once."""

import random

import numpy as np

from hilandera.operators import stats, vectors


def plain_communities(n, weight):
    """Local moves in node order, at most 20 sweeps, each to the first community of the largest gain."""
    total = sum(map(sum, weight))
    if not total:
        return [0] * n
    degree, label = [sum(row) for row in weight], list(range(n))
    for _ in range(20):
        moved = False
        for i in range(n):
            def worth(c, i=i):
                inside = sum(weight[i][j] for j in range(n) if j != i and label[j] == c)
                mass = sum(degree[j] for j in range(n) if j != i and label[j] == c)
                return inside / total - mass * degree[i] / (total * total)

            stay, best, to = worth(label[i]), 0.0, None
            for c in sorted({label[j] for j in range(n) if weight[i][j] > 0} - {label[i]}):
                if worth(c) - stay > best:
                    best, to = worth(c) - stay, c
            if to is not None:
                label[i], moved = to, True
        if not moved:
            break
    names = {}
    return [names.setdefault(c, len(names)) for c in label]


def test_communities_equal_plain_loops(spark):
    rng = random.Random(12)
    top, pairs, want = [], [], {}
    for d in range(60):
        n = rng.randint(1, 12)
        weight = [[0] * n for _ in range(n)]
        for i in range(n):
            for j in range(i):
                if rng.random() < rng.choice([0.1, 0.4, 0.8]):
                    weight[i][j] = weight[j][i] = rng.choice([1, 2, 4, 8])
        top += [(d, f"w{i}", i + 1) for i in range(n)]
        pairs += [(d, f"w{i}", f"w{j}", weight[i][j]) for i in range(n) for j in range(n) if weight[i][j]] + [(d, "w0", "w0", 9), (d, "w0", "other", 5)]
        want |= {(d, f"w{i}"): c for i, c in enumerate(plain_communities(n, weight))}
    got = stats.communities(spark.createDataFrame(top, "doc_id long, lemma string, rank long"), spark.createDataFrame(pairs, "doc_id long, a string, b string, n long"))
    assert {(r.doc_id, r.lemma): r.comm for r in got.collect()} == want


def plain_clusters(vecs, k):
    """Cosine k-means from evenly spaced vectors; vecs: a vector or None for each word by rank."""
    n, known = len(vecs), [i for i, v in enumerate(vecs) if v is not None]
    k = min(k or min(8, max(3, n // 4)), n)
    if len(known) < k:
        return [i % max(1, k) for i in range(n)]
    centres = [np.array(vecs[known[c * len(known) // k]], np.float32) for c in range(k)]
    label = dict.fromkeys(known)
    for _ in range(20):
        new = {}
        for i in known:
            best = -2.0
            for c, centre in enumerate(centres):
                x, y = np.array(vecs[i], float), centre.astype(float)
                norm = np.sqrt((x**2).sum()) * np.sqrt((y**2).sum())
                sim = float(x @ y) / norm if norm else 0.0
                if sim > best + 1e-12:
                    best, new[i] = sim, c
        if new == label:
            break
        label = new
        for c in set(label.values()):
            of = [np.array(vecs[i], np.float32) for i in known if label[i] == c]
            total = np.zeros(len(of[0]), np.float32)
            for v in of:
                total += v
            centres[c] = total / np.float32(len(of))
    return [label.get(i, 0) or 0 for i in range(n)]


def test_clusters_equal_plain_loops(spark):
    rng = random.Random(3)
    table = {f"v{i}": [float(rng.choice([-3, -1, 0, 1, 2, 5])) + rng.random() for _ in range(6)] for i in range(50)} | {"zero": [0.0] * 6}
    words, want = [], {}
    for d in range(40):
        of = rng.sample([*table, *(f"none{i}" for i in range(rng.choice([0, 5, 60])))], rng.randint(1, 30))
        words += [(d, w, i + 1) for i, w in enumerate(of)]
        labels = plain_clusters([np.array(table[w], np.float32).astype(float) if w in table else None for w in of], None)
        want |= {(d, w): c for w, c in zip(of, labels, strict=True)}
    got = vectors.clusters(spark.createDataFrame(words, "doc_id long, word string, rank long"), spark.createDataFrame(list(table.items()), "word string, vec array<float>"))
    assert {(r.doc_id, r.word): r.cluster for r in got.collect()} == want
