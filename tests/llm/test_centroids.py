"""Centroid clustering against a comparison of everything."""

import hashlib
import math

import numpy as np


def plain(rows, k=40, rounds=5, dim=64, scale=256, salt=2):
    """id -> (cluster, distance), and the centroids, in whole numbers of any size."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            out.append((i, v, *min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for _, v, _, c in found if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, c, d) for i, _, d, c in assign()), key=str), centroids


def given(seed, n=300, dim=64):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(7, dim))
    return [(i, (heads[i % 7] + rng.normal(0, 0.2, dim)).astype(np.float32).tolist()) for i in range(n)]


def odd(dim=64):
    rows = given(3, 90)
    rows += [(200, None), (201, []), (202, [1.0] * (dim - 1)), (203, [None] + [1.0] * (dim - 1)), (204, [float("nan")] + [0.0] * (dim - 1))]
    rows += [(205, [float("inf")] * dim), (206, [0.0] * dim), (207, [0.0] * dim), rows[4], rows[4], (None, rows[5][1]), (None, [-0.001] * dim)]
    return rows


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], f"vec_id long, embedding array<{kind}>, cluster string, id int, table double")


def check(spark, rows, **options):
    from barloom.llm.centroids import cluster, described

    found, centroids = cluster(frame(spark, rows), **options)
    got = described(found, centroids).collect()
    want, middle = plain(rows, options.get("k", 40), options.get("rounds", 5))
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    assert centroids.tolist() == middle
    parts = {}
    for _, c, d in want:
        parts[c] = parts.get(c, 0) + d
    assert all(r["cluster_inertia"] == parts[r["cluster"]] and r["inertia"] == sum(parts.values()) for r in got)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, middle[r["cluster"]])).encode()).hexdigest() for r in got)


def test_clusters_equal_plain(spark):
    check(spark, given(1))
    check(spark, given(2), k=7, rounds=3, pivots=3)


def test_odd_vectors(spark):
    check(spark, odd())


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(60)]
    check(spark, rows, k=10, rounds=2)


def test_fewer_vectors_than_centroids_and_none(spark):
    from barloom.llm.centroids import cluster, described

    check(spark, given(4, 5))
    found, centroids = cluster(frame(spark, [(1, None)]))
    out = described(found, centroids)
    assert out.count() == 0 and len(centroids) == 0
    assert out.columns == ["cluster", "vec_id", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_that_do_not_fit_are_left_out(spark):
    from barloom.llm.centroids import cluster

    rows = [*given(5, 50), (900, [1e30] + [0.0] * 63), (901, [200_000.0] * 64)]
    found, _ = cluster(frame(spark, rows, "double"))
    assert {r["vec_id"] for r in found.collect()} == {*range(50), 901}


def test_bounds_prune_without_changing_the_nearest():
    from barloom.llm.centroids import choose_pivots, nearest, squared

    rng = np.random.default_rng(9)
    heads = rng.integers(-400, 400, (40, 64))
    vectors = heads[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 64))
    pivots = choose_pivots(heads, 20)
    label, best, computed = nearest(vectors, np.sqrt(squared(vectors, pivots)), heads, np.sqrt(squared(heads, pivots)))
    every = squared(vectors, heads)
    assert (label == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert computed < 0.2 * every.size
