"""Links, counts and components against all pairs in doubles."""

import math

import numpy as np
from pyspark.sql import functions as F

from isoloom.llm import embeddings


def brute(rows, threshold):
    links = {i: set() for i, _, _ in rows}
    for a, x, la in rows:
        for b, y, lb in rows:
            if a != b and la is not None and la == lb and x is not None and y is not None and len(x) == len(y):
                x_, y_ = (np.array([np.nan if c is None else c for c in z], float) for z in (x, y))
                if np.isfinite(x_).all() and np.isfinite(y_).all() and x_.any() and y_.any():
                    x_, y_ = x_ / abs(x_).max(), y_ / abs(y_).max()
                    if x_ @ y_ / math.sqrt((x_ @ x_) * (y_ @ y_)) >= threshold:
                        links[a].add(b)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1, None):
        centres = rng.normal(size=(6, 24))
        for _ in range(70):
            v = centres[rng.integers(6)] + rng.normal(size=24) * rng.choice([0.02, 0.2, 0.27, 0.3])
            rows.append((k := k + 1, [float(np.float32(c)) for c in v], label))
    rows += [(1001, None, 0), (1002, [0.0] * 24, 0), (1003, [float("nan")] * 24, 0), (1004, [None] + [1.0] * 23, 0), (1005, [], 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [float("inf")] * 24, 1)]
    rows += [(2000 + n, [a, b], 2) for n, (a, b) in enumerate([(1e200, 1e200), (1e200, 1.0001e200), (1.0, 1.0), (1e-200, 1e-200), (5e-324, 5e-324), (1e308, -1e308), (1e-320, 0.0), (1e308, 0.0), (1e308, 1e300)])]
    frame = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id long, embedding array<double>, label int, q string, scale double")
    want = brute(rows, 0.93)
    for block in (16, 4096):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame, block=block).collect()}
        assert got == want


def test_pairs_at_the_threshold_are_settled_in_doubles(spark):
    angle = math.acos(0.93)
    turns = [k * angle * (1 + d) for k in range(40) for d in (0, 1e-12, -1e-12, 1e-4, -1e-4)]
    rows = [(k, [math.cos(t) * 3.0**k, math.sin(t) * 3.0**k], "a") for k, t in enumerate(turns)]
    left, right = (np.array([r[1] for r in rows]) for _ in range(2))
    units = embeddings.quantise(embeddings.halved(left) / np.sqrt((embeddings.halved(left) ** 2).sum(axis=1))[:, None])
    linked, unsettled = embeddings.settle(units, units, 0.93)
    cosine = np.cos(np.subtract.outer(turns, turns))
    assert unsettled.any() and (cosine[linked] >= 0.93).all() and not (cosine[~(linked | unsettled)] >= 0.93 + 1e-12).any()
    x = embeddings.halved(left)
    norm = np.sqrt((x * x).sum(axis=1))
    want = {(a, b) for a in range(len(x)) for b in range(len(x)) if a != b and (x[a] * x[b]).sum() / (norm[a] * norm[b]) >= 0.93}
    for block in (7, 4096):
        got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), block=block).collect()
        assert {r.vec_id: r.n_links for r in got} == {a: sum(u == a for u, _ in want) for a in range(len(x))}


def test_bound_holds():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(200, 17)) ** 3
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    q, s, e = embeddings.quantise(u)
    approx = (q.astype(int) @ q.T.astype(int)) / s[:, None] / s[None, :]
    assert (np.abs(u @ u.T - approx) <= e[:, None] + (1 + e[:, None]) * e[None, :]).all()


def test_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (None, [1.0, 0.0], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, schema)).select(F.coalesce("vec_id", F.lit(-1)), "n_links", "component_id", "kept").collect()
    assert sorted(tuple(r)[:2] for r in got) == [(-1, 0), (1, 1), (1, 1), (2, 1)]


def test_very_long_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 40_000))
    rows = [(k, (base[k % 6] + (k // 6) * 0.2 * rng.normal(size=40_000)).tolist(), k % 2) for k in range(18)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(docs).collect()}
    assert got == brute(rows, 0.93) and any(n for n, _, _ in got.values())
