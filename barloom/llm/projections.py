"""Embedding near-duplicates by counting collisions in sorted one-dimensional projections.

A table is a cell of sign bits (so that a sorted run stays short however many vectors there are) in which
vectors are sorted by one random projection. Two vectors collide in a table if they share the cell and
each lies in the window centred on the other. Pairs with enough collisions over all tables are verified
by their cosine in double precision. The number of tables is calibrated so that a pair right at the
threshold reaches the count with the wanted probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import group_starts, lowest_labels, whole_groups
from barloom.llm.components import connected_components
from barloom.session import settle

#: Vectors of one block of a hot cell; a task compares at most two blocks at once.
BLOCK = 1024
#: Pairs compared at a time.
_PAIRS = 50_000


class Tables:
    """Random projections and their calibration for vectors of one length."""

    def __init__(self, rows: int, cosine: float, recall: float, collisions: int, crowd: int, seed: int):
        self.cosine, self.collisions, self.seed = cosine, collisions, seed
        self.bits = max(1, math.ceil(math.log2(max(2, rows / crowd))))
        distance = math.sqrt(2 - 2 * cosine)
        self.window = 2 * distance
        near = (1 - math.acos(cosine) / math.pi) ** self.bits * math.erf(self.window / distance / math.sqrt(2))
        self.count = collisions
        while sum(math.comb(self.count, k) * near**k * (1 - near) ** (self.count - k) for k in range(collisions)) > 1 - recall:
            self.count += 1

    def places(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and projection of each vector in each table."""
        rng = np.random.default_rng((self.seed, unit.shape[1]))
        signs = rng.standard_normal((unit.shape[1], self.count * self.bits))
        lines = rng.standard_normal((unit.shape[1], self.count))
        set_ = (unit @ signs > 0).reshape(len(unit), self.count, self.bits)
        return set_ @ (1 << np.arange(self.bits, dtype=np.int64)), unit @ lines


def usable(vector: Column) -> Column:
    """Whether a cosine with this vector is defined."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    matrix = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # squares stay finite
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _links(rows: pa.Table, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked vectors of the groups: (node, its smallest reachable node here, rows linked to it)."""
    order = np.lexsort([rows.column(c).to_numpy() for c in ("line", "pair", "cell", "index", "dim")])
    rows = rows.take(pa.array(order))
    dim, index, cell, pair, line, own, cid, copies = (
        rows.column(c).to_numpy() for c in ("dim", "index", "cell", "pair", "line", "own", "cid", "copies")
    )
    starts = group_starts(dim, index, cell, pair)
    ends = np.append(starts[1:], len(cid))
    stop = np.repeat(ends, ends - starts)
    mixed = np.repeat(np.array([len(np.unique(own[a:b])) > 1 for a, b in zip(starts, ends, strict=True)], bool), ends - starts)
    links, found_a, found_b = np.zeros(len(cid), np.int64), [], []
    for d in np.unique(dim).tolist():
        these = np.flatnonzero(dim == d)
        first = these[0]
        unit = _units(rows.column("vector").take(pa.array(these)), d)
        cells, lines = tables.places(unit)
        step, here = 1, these[these + 1 < stop[these]]
        while len(here):
            close = line[here + step] - line[here] <= tables.window
            here = here[close]  # sorted: what is too far now stays too far
            cross = here[~mixed[here] | (own[here] != own[here + step])]
            for at in range(0, len(cross), _PAIRS):
                a = cross[at : at + _PAIRS]
                i, j = a - first, a + step - first
                hit = (cells[i] == cells[j]) & (np.abs(lines[i] - lines[j]) <= tables.window)
                # Each pair is judged once, in the first table where it collides.
                enough = (hit.argmax(axis=1) == index[a]) & (hit.sum(axis=1) >= tables.collisions)
                i, j, a = i[enough], j[enough], a[enough]
                linked = np.einsum("ij,ij->i", unit[i], unit[j]) >= tables.cosine
                a = a[linked]
                np.add.at(links, a, copies[a + step])
                np.add.at(links, a + step, copies[a])
                found_a.append(a)
                found_b.append(a + step)
            step += 1
            here = here[here + step < stop[here]]
    if not found_a:
        return cid[:0], cid[:0], cid[:0]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    nodes, inverse = np.unique(cid, return_inverse=True)
    label = lowest_labels(inverse[a], inverse[b], len(nodes))
    total = np.bincount(inverse, weights=links, minlength=len(nodes)).astype(np.int64)
    some = np.flatnonzero(total)
    return nodes[some], nodes[label[some]], total[some]


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.95,
    recall: float = 0.99,
    collisions: int = 2,
    crowd: int = 32,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row.

    Equal vectors are one node with a number of copies, so copies never become pairs. ``crowd`` is the mean
    number of vectors in a cell; a cell with more than ``block`` is cut into blocks and each pair of blocks
    is a group of its own. Links inside a group are counted, and only a spanning forest of them leaves it.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and only
    vectors of one length link. A null id names a component only if all ids of it are null. An empty table
    gives no rows; other columns are ignored.
    """
    slim = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("vector"))
    good = slim.filter(usable(F.col("vector")))
    classes = good.groupBy("vector").agg(F.min("_id").alias("first"), F.count("*").alias("copies"))
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    tables = Tables(classes.count(), cosine, recall, collisions, crowd, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                cells, lines = tables.places(_units(part.column("vector"), d))
                n = part.num_rows
                for t in range(tables.count):
                    columns = [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(cells[:, t])]
                    columns += [pa.array(lines[:, t]), part.column("cid"), part.column("copies"), part.column("vector")]
                    yield pa.RecordBatch.from_arrays(columns, ["dim", "index", "cell", "line", "cid", "copies", "vector"])

    item = classes.schema["vector"].dataType.simpleString()
    schema = f"dim int, index int, cell long, line double, cid long, copies long, vector {item}"
    placed = classes.select("cid", "copies", "vector").mapInArrow(place, schema)
    cell = ["dim", "index", "cell"]
    # The sizes of crowded cells are few: a cell holds ``crowd`` vectors on average.
    crowded = placed.select(*cell).groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > block)
    placed = placed.join(crowded, cell, "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block)).cast("int"))
    placed = placed.withColumn("own", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    keys = [*cell, "pair"]
    placed = placed.withColumn("pair", pair).select(*keys, "line", "own", "cid", "copies", "vector")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, keys):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _links(rows, tables)], ["u", "v", "n"])

    links = placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(link, "u long, v long, n long")
    links = settle(links, "vector-links")
    counts = links.groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("linked"))
    parts = connected_components(links, "vector-parts").withColumnRenamed("node", "cid")
    joined = classes.join(parts, "cid", "left").join(counts, "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    names = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    known = joined.join(names, "root").select(
        F.col("vector").alias("_vector"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        "component_id",
        F.lit(True).alias("_known"),
    )
    # Joined on a hash first: equal arrays have equal hashes, and the vectors decide.
    slim = slim.withColumn("_hash", F.when(usable(F.col("vector")), F.xxhash64("vector")))
    known = known.withColumn("_same", F.xxhash64("_vector"))
    out = slim.join(known, (F.col("_hash") == F.col("_same")) & (F.col("vector") == F.col("_vector")), "left")
    component = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
