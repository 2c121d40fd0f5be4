"""Centroid clustering of integer vectors with a LAESA pivot table.

The distance of every vector to a few fixed pivots is computed once and stored beside the vector. In each
round the distances of the centroids to the pivots are known on the driver, and by the triangle inequality
the largest difference over the pivots bounds the distance of a vector to a centroid from below. A vector
takes the exact integer distance to the centroid with the smallest bound, and then only to those whose
bound does not exceed it. Distances are exact, so the result is that of comparing everything.

A round is one pass over the stored table: each task adds up its vectors by centroid, and only one row for
each centroid and task leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import settle

#: Scaled components lie within plus or minus this: squared distances of up to 256 of them fit 64 bits.
LIMIT = 1 << 26
#: More than the rounding error of a bound, which is a difference of roots below 2 ** 31.
_SLACK = 2.0**-18
#: Vectors compared at a time.
_ROWS = 4096


def usable(vector: Column, dim: int, scale: int) -> Column:
    """Whether a vector has ``dim`` components, all finite and small enough to scale."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LIMIT / scale))
    return F.coalesce((F.size(vector) == dim) & fits, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def squared(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all others, a column at a time."""
    out = np.empty((len(vectors), len(others)), dtype=np.int64)
    for j, other in enumerate(others):
        gap = vectors - other
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def choose_pivots(seeds: np.ndarray, count: int) -> np.ndarray:
    """Pivots among the seeds, each the one with the largest sum of distances to those before it."""
    if not len(seeds):
        return seeds
    chosen, total = [0], np.sqrt(squared(seeds, seeds[:1])[:, 0].astype(float))
    while len(chosen) < min(count, len(seeds)):
        total[chosen] = -1
        chosen.append(int(total.argmax()))
        total += np.sqrt(squared(seeds, seeds[chosen[-1:]])[:, 0].astype(float))
    return seeds[chosen]


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector, the squared distance to it, and how many distances were computed.

    ``table`` holds roots of the vectors' distances to the pivots, ``known`` those of the centroids. Of
    equally near centroids the first is taken.
    """
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, p, None] - known[None, :, p]), out=bound)
    first = bound.argmin(axis=1)
    gap = vectors - centroids[first]
    best, label = np.einsum("ij,ij->i", gap, gap), first
    alive = bound - _SLACK <= np.sqrt(best.astype(float))[:, None]
    alive[np.arange(len(vectors)), first] = False
    computed = len(vectors)
    for c in np.flatnonzero(alive.any(axis=0)).tolist():
        # A distance found meanwhile can rule out more.
        rows = np.flatnonzero(alive[:, c] & (bound[:, c] - _SLACK <= np.sqrt(best.astype(float))))
        if not len(rows):
            continue
        gap = vectors[rows] - centroids[c]
        found = np.einsum("ij,ij->i", gap, gap)
        computed += len(rows)
        better = (found < best[rows]) | ((found == best[rows]) & (c < label[rows]))
        best[rows[better]], label[rows[better]] = found[better], c
    return label, best, computed


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a batch with their labels and distances, some rows at a time."""
    vectors = _matrix(batch.column("vector"), centroids.shape[1])
    table = np.sqrt(_matrix(batch.column("table"), known.shape[1]).astype(float))
    parts = [nearest(vectors[i : i + _ROWS], table[i : i + _ROWS], centroids, known)[:2] for i in range(0, len(vectors), _ROWS)]
    return vectors, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _sums(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and component sums of the vectors of each centroid: one row per centroid reaches the driver."""
    known = np.sqrt(squared(centroids, pivots).astype(float))
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors, label, _ = _assigned(batch, centroids, known)
                counts += np.bincount(label, minlength=k)
                order = np.argsort(label, kind="stable")
                here, starts = np.unique(label[order], return_index=True)
                sums[here] += np.add.reduceat(vectors[order], starts, axis=0)
        some = np.flatnonzero(counts)
        columns = [pa.array(some), pa.array(counts[some]), *(pa.array(sums[some, j]) for j in range(dim))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", *(f"s{j}" for j in range(dim))])

    names = [f"s{j}" for j in range(dim)]
    parts = stored.select("vector", "table").mapInArrow(run, ", ".join(f"{c} long" for c in ("cluster", "n", *names)))
    rows = parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in ("n", *names))).collect()
    counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
    for r in rows:
        counts[r["cluster"]] = r["n"]
        sums[r["cluster"]] = [r[c] for c in names]
    return counts, sums


def seed_rows(kept: DataFrame, count: int, salt: int) -> np.ndarray:
    """The ``count`` vectors with the smallest hashes of their ids: a bounded top list, ties by the vector."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(F.col("id").isNull().alias("none"), key.alias("key"), "vector").orderBy("none", "key", "vector").limit(count).collect()
    return np.array([r["vector"] for r in rows], dtype=np.int64)


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dim: int = 64,
    scale: int = 256,
    pivots: int = 20,
    salt: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """``id_col, cluster, distance`` of every kept vector, and the final centroids (``k`` rows at most).

    Kept are vectors of ``dim`` components that are neither null nor non-finite; each becomes the integer
    ``floor(scale * x)``. A component beyond 2^26 after scaling counts as not finite, as distances would
    not fit 64 bits. Centroids start as the vectors with the smallest hashes of ``salt:id``, null ids last,
    equal ids by their components. Each round replaces a centroid by the floor of the mean of its vectors;
    one without vectors stays. Ties go to the smaller number. Repeated rows are vectors of their own; fewer
    than ``k`` vectors give as many centroids; an empty table gives no rows and no centroids; other columns
    are ignored.
    """
    raw = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    kept = raw.filter(usable(F.col("vector"), dim, scale)).select("id", whole.alias("vector"))
    centroids = seed_rows(kept, k, salt)
    kind = kept.schema["id"].dataType.simpleString()
    if not len(centroids):
        return kept.limit(0).select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    chosen = choose_pivots(centroids, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = squared(_matrix(batch.column("vector"), dim), chosen)
            offsets = pa.array(np.arange(0, table.size + 1, len(chosen)), pa.int32())
            column = pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), column], ["id", "vector", "table"])

    stored = settle(kept.mapInArrow(measure, f"id {kind}, vector array<int>, table array<long>"), "pivots")
    for _ in range(rounds):
        counts, sums = _sums(stored, centroids, chosen)
        some = counts > 0
        centroids = centroids.copy()
        centroids[some] = sums[some] // counts[some, None]  # floor, also below zero
    known = np.sqrt(squared(centroids, chosen).astype(float))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, label, best = _assigned(batch, centroids, known)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(label.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    found = settle(stored.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "clusters")
    return found.withColumnRenamed("id", id_col), centroids


def described(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; sums beyond 64 bits are null."""
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("part")
    parts = {r["cluster"]: int(r["part"]) for r in found.groupBy("cluster").agg(total).collect()}  # one row per centroid
    fits = lambda x: x if x < 1 << 63 else None
    inertia = fits(sum(parts.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(i, fits(part), inertia, digest(centroids[i])) for i, part in sorted(parts.items())]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return found.join(F.broadcast(found.sparkSession.createDataFrame(rows, schema)), "cluster")
