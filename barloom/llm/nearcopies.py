"""Near copies at a Jaccard similarity of word shingles, found over wide SimHash fingerprints.

At a similarity of 0.8 two fingerprints of 128 bits differ in some 19 bits, far more than an index over
equal segments can bridge. Candidates therefore meet in cells: a table takes a few random bits of the
fingerprint, and as many tables are used as a pair right at the threshold needs to share a cell with the wanted
probability; the bits of a cell grow with the logarithm of the rows, so cells stay small. In a cell the
pigeonring chain prunes pairs (some chain of consecutive segments around the ring whose every prefix stays
within its proportional budget), the Hamming distance decides who is nearest, and the exact similarity of the
shingle sets decides what is a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import group_starts, lowest_labels, text_of, texts, whole_groups
from barloom.llm.components import connected_components
from barloom.session import settle

BITS, SEGMENTS, CHAIN = 128, 16, 4
#: Members of one block of a crowded cell.
BLOCK = 1024
#: Pairs, and shingles of their sets, that a tile of pairs holds on average.
TILE, TILE_SHINGLES = 8192, 1 << 22


def shingles(text: str, width: int = 5) -> set[bytes]:
    """Distinct ``width``-word shingles (the whole sequence if there are fewer words); words as in SimHash."""
    words = text.encode("utf-8", "replace").lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def wide_fingerprint(items: set[bytes]) -> bytes:
    """128-bit SimHash of a set."""
    if not items:
        return bytes(BITS // 8)
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join(map(digest, items)), dtype=np.uint8).reshape(-1, BITS // 8)
    # A bit column of a block of hashes at a time keeps memory bounded for very long texts.
    ones = sum(np.unpackbits(hashes[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), 65536))
    return np.packbits(2 * ones > len(hashes)).tobytes()


class Cells:
    """Which bits each table takes, and how far a pair may be apart."""

    def __init__(self, rows: int, similarity: float, recall: float, crowd: int, seed: int):
        angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
        self.bits = max(4, math.ceil(math.log2(max(2, rows / crowd))))
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - angle) ** self.bits))
        self.distance = math.ceil(BITS * angle + 3 * math.sqrt(BITS * angle * (1 - angle)))
        rng = np.random.default_rng(seed)
        self.chosen = np.stack([rng.permutation(BITS)[: self.bits] for _ in range(self.tables)])

    def of(self, prints: np.ndarray) -> np.ndarray:
        """Cell of each fingerprint (bytes in rows) in each table."""
        bits = np.unpackbits(prints, axis=1)
        return (bits[:, self.chosen].astype(np.int64) << np.arange(self.bits)).sum(axis=2)


def chained(segments: np.ndarray, distance: int) -> np.ndarray:
    """Whether some chain of ``CHAIN`` segments keeps every prefix within its share of ``distance``; one row per pair."""
    budget = np.arange(1, CHAIN + 1) * distance
    ok = np.zeros(len(segments), dtype=bool)
    ring = np.concatenate((segments, segments[:, : CHAIN - 1]), axis=1).astype(np.int16)
    for start in range(SEGMENTS):
        total, alive = np.zeros(len(segments), dtype=np.int16), np.ones(len(segments), dtype=bool)
        for k in range(CHAIN):
            total = total + ring[:, start + k]
            alive &= total * SEGMENTS <= budget[k]
        ok |= alive
    return ok


def _prints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Fingerprints as bytes in rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)


def _in_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows by table, cell, pair of blocks and node, with the first row of each pair of blocks and the end of each row's."""
    rows = rows.take(pa.array(np.lexsort([rows.column(c).to_numpy() for c in ("nid", "pair", "cell", "table")])))
    starts = group_starts(*(rows.column(c).to_numpy() for c in ("table", "cell", "pair")))
    ends = np.append(starts[1:], rows.num_rows)
    return rows, starts, np.repeat(ends, ends - starts)


def _close(rows: pa.Table, prints: np.ndarray, stop: np.ndarray, kept, distance: int, similarity: float) -> Iterator[tuple]:
    """Candidates ``(a, b, bits apart)`` inside groups that end at ``stop``, those ``kept(a, b)`` only, a step between rows at a time."""
    size = rows.column("size").to_numpy()
    step, here = 1, np.arange(len(size))
    here = here[here + 1 < stop]
    while len(here):
        there = here + step
        fits = np.minimum(size[here], size[there]) >= similarity * np.maximum(size[here], size[there])
        fits &= kept(here, there)
        a, b = here[fits], there[fits]
        gap = np.bitwise_count(prints[a] ^ prints[b])  # SEGMENTS columns of 8 bits
        near = chained(gap, distance)
        a, b, apart = a[near], b[near], gap[near].sum(axis=1, dtype=np.int64)
        close = apart <= distance
        yield a[close], b[close], apart[close]
        step += 1
        here = here[here + step < stop[here]]


def _matches(rows: pa.Table, distance: int, similarity: float) -> pa.RecordBatch:
    """Candidates ``(u, v)`` of each cell: all of them if they are no more than its rows, else the nearest of
    every row, and a row with the cell and no pair that says so."""
    rows, starts, stop = _in_order(rows)
    table, cell, own, nid = (rows.column(c).to_numpy() for c in ("table", "cell", "own", "nid"))
    ends = np.append(starts[1:], len(nid))
    mixed = np.repeat(np.array([own[a] != own[b - 1] or (own[a:b] != own[a]).any() for a, b in zip(starts, ends, strict=True)], bool), ends - starts)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    nearest, best = np.full(len(nid), -1), np.full(len(nid), BITS + 1)
    # Pairs of a group are held until they are more than its rows, so memory follows the rows.
    held, seen, room = [], np.zeros(len(starts), np.int64), ends - starts
    for a, b, apart in _close(rows, _prints(rows.column("fp")), stop, lambda a, b: ~mixed[a] | (own[a] != own[b]), distance, similarity):
        for one, other in ((a, b), (b, a)):
            better = apart < best[one]
            best[one[better]], nearest[one[better]] = apart[better], other[better]
        seen += np.bincount(group[a], minlength=len(starts))
        fits = seen[group[a]] <= room[group[a]]
        held.append((a[fits], b[fits]))
    over = seen > room
    a, b = (np.concatenate([x[i] for x in held] or [np.zeros(0, np.int64)]) for i in (0, 1))
    one = np.flatnonzero((nearest >= 0) & over[group])
    a, b = np.append(a[~over[group[a]]], one), np.append(b[~over[group[a]]], nearest[one])
    open_ = starts[over]
    pairs = [np.minimum(nid[a], nid[b]), np.maximum(nid[a], nid[b])]
    left = pa.nulls(len(open_), pa.int64())
    columns = [pa.concat_arrays([pa.array(x), left]) for x in pairs]
    columns += [pa.concat_arrays([pa.nulls(len(a), pa.from_numpy_dtype(x.dtype)), pa.array(x[open_])]) for x in (table, cell)]
    return pa.RecordBatch.from_arrays(columns, ["u", "v", "table", "cell"])


def _between(rows: pa.Table, cells: Cells, similarity: float) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows in order, and the candidates ``(a, b)`` among them whose ends lie in different groups, each in the first cell that its ends share."""
    rows, starts, stop = _in_order(rows)
    table, own, root = (rows.column(c).to_numpy() for c in ("table", "own", "root"))
    ends = np.append(starts[1:], rows.num_rows)
    mixed = np.repeat(np.array([(own[a:b] != own[a]).any() for a, b in zip(starts, ends, strict=True)], bool), ends - starts)
    prints = _prints(rows.column("fp"))
    kept = lambda a, b: (root[a] != root[b]) & (~mixed[a] | (own[a] != own[b]))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b, _ in _close(rows, prints, stop, kept, cells.distance, similarity):
        first = (cells.of(prints[a]) == cells.of(prints[b])).argmax(axis=1) == table[a]
        found.append((a[first], b[first]))
    return rows, *(np.concatenate([x[i] for x in found]) for i in (0, 1))


def _similar(a: np.ndarray, b: np.ndarray, flat: pa.Array, similarity: float) -> np.ndarray:
    """Whether the shingle sets at ``a[i]`` and ``b[i]`` of ``flat`` are similar enough, exactly."""
    order = np.argsort(a, kind="stable")
    a, b, size = a[order], b[order], flat.value_lengths().to_numpy()
    values, code = np.unique(flat.flatten().to_numpy(), return_inverse=True)
    at = np.append(0, np.cumsum(size))
    common, marked = np.zeros(len(a), np.int64), np.zeros(len(values), bool)
    starts = group_starts(a)
    for i, j in zip(starts, np.append(starts[1:], len(a)), strict=True):
        mine = code[at[a[i]] : at[a[i] + 1]]
        marked[mine] = True
        for c in range(i, j, 256):
            some = b[c : min(c + 256, j)]
            held = np.concatenate([marked[code[at[k] : at[k + 1]]] for k in some])
            common[c : c + len(some)] = np.add.reduceat(held, np.append(0, np.cumsum(size[some])[:-1]), dtype=np.int64)
        marked[mine] = False
    near = np.zeros(len(a), bool)
    near[order] = common >= similarity * (size[a] + size[b] - common)
    return near


#: Spark takes what a Python function or an explode gives for as many rows as it is given, and would broadcast tables
#: many times the size that it allows. Joins of such tables, and of what is made of them, are never broadcast.
SORTED = "merge"


def _placed(nodes: DataFrame, cells: Cells) -> DataFrame:
    """``(table, cell)`` of every node in every table, beside its own columns; a row per table, so to be joined :data:`SORTED`."""
    names = nodes.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = cells.of(_prints(batch.column("fp")))
            for t in range(cells.tables):
                columns = [pa.array(np.full(len(found), t, np.int32)), pa.array(found[:, t])]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in names)], ["table", "cell", *names])

    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(place, f"table int, cell long, {given}")


PAIR = ["table", "cell", "pair"]


def _candidates(nodes: DataFrame, cells: Cells, similarity: float, block: int) -> DataFrame:
    """Candidate pairs ``(u, v)`` of ``nodes (nid, fp, size)``; rows without a pair name a cell (``table``, ``cell``) that has more.

    A crowded cell is cut into blocks by the hash of its members. Every block meets the first one, which
    offers a candidate to any member of a dense group, so the work in a cell follows its size. Such a cell has more, too.
    """
    placed = _placed(nodes.select("nid", "fp", "size"), cells)
    counts = placed.groupBy("table", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    busy = placed.hint(SORTED).join(counts, ["table", "cell"])
    busy = busy.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")).withColumn("own", F.expr("cast(pmod(xxhash64(nid), blocks) as int)"))
    # A row of the first block goes to all pairs with that block, any other row to its own pair with it.
    first = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    busy = busy.withColumn("other", F.explode(first))
    pair = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    busy = busy.withColumn("pair", pair).select(*PAIR, "own", "nid", "fp", "size", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, PAIR):
            yield _matches(rows, cells.distance, similarity)
            cut = rows.filter(pc.greater(rows.column("blocks"), 1)).group_by(["table", "cell"]).aggregate([])
            none = pa.nulls(cut.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(cut.column(c).combine_chunks() for c in ("table", "cell"))], ["u", "v", "table", "cell"])

    return busy.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(run, "u long, v long, table int, cell long").distinct()


def _links_between(nodes: DataFrame, open_cells: DataFrame, sets_of, cells: Cells, similarity: float, block: int) -> DataFrame:
    """Links ``(u, v)`` between roots: those that all candidate pairs of ``nodes (nid, fp, size, root)`` in the open cells make.

    A cell of one root needs nothing. Elsewhere a root of more rows than a block has blocks of its own, which do
    not meet each other, and the other roots share blocks; all other pairs of blocks meet. Pairs never leave a
    task: first the rows that have a candidate in another root are found, then they come with their shingle sets,
    are compared, and each root is linked to the smallest one that it reaches in its task. ``sets_of`` gives the sets of nodes ``(nid)``.
    """
    placed = _placed(nodes.select("nid", "fp", "size", "root"), cells).hint(SORTED).join(open_cells, ["table", "cell"])
    roots = placed.groupBy("table", "cell", "root").agg(F.count("*").alias("n"))
    large = F.col("n") > block
    sums = roots.groupBy("table", "cell").agg(F.count("*").alias("roots"), F.sum(F.when(~large, F.col("n"))).alias("rest")).filter("roots > 1")
    shares = roots.hint(SORTED).join(sums, ["table", "cell"]).select(
        "table", "cell", "root", F.when(large, F.col("root")).alias("_one"), F.ceil(F.when(large, F.col("n")).otherwise(F.col("rest")) / F.lit(block)).cast("int").alias("_parts")
    )
    part = F.when(F.col("_one").isNull(), F.expr("pmod(xxhash64(root), _parts)")).otherwise(F.expr("pmod(xxhash64(nid), _parts)"))
    own = placed.hint(SORTED).join(shares, ["table", "cell", "root"]).withColumn("own", F.xxhash64(F.coalesce("_one", F.lit(-1)), part))
    blocks = own.select("table", "cell", "own", "_one").distinct().groupBy("table", "cell").agg(F.collect_list(F.struct("own", "_one")).alias("_all"))
    met = own.hint(SORTED).join(blocks, ["table", "cell"])
    met = met.withColumn("_all", F.filter("_all", lambda x: F.col("_one").isNull() | x["_one"].isNull() | (x["_one"] != F.col("_one"))))
    met = met.withColumn("_other", F.explode("_all")).withColumn("pair", F.xxhash64(F.least("own", "_other.own"), F.greatest("own", "_other.own")))
    met = met.select(*PAIR, "own", "nid", "fp", "size", "root")

    names = [*PAIR, "own", "nid", "fp", "size", "root"]

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, PAIR):
            rows, a, b = _between(rows, cells, similarity)
            yield from rows.take(pa.array(np.union1d(a, b))).select(names).combine_chunks().to_batches()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, PAIR):
            rows, a, b = _between(rows, cells, similarity)
            near = _similar(a, b, rows.column("shingles").combine_chunks(), similarity)
            roots, code = np.unique(rows.column("root").to_numpy(), return_inverse=True)
            label = lowest_labels(code[a[near]], code[b[near]], len(roots))
            moved = np.flatnonzero(label != np.arange(len(roots)))
            yield pa.RecordBatch.from_arrays([pa.array(roots[moved]), pa.array(roots[label[moved]])], ["u", "v"])

    given = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in names)
    some = settle(met.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(involved, given), "wide-open")
    held = some.hint(SORTED).join(sets_of(some.select("nid")), "nid").select(*names, "shingles")
    return held.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(linked, "u long, v long").distinct()


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(nid, shingles)``, shingles as sorted distinct 64-bit hashes, of ``docs (nid, _text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [sorted({xxhash.xxh3_64_intdigest(s) - (1 << 63) for s in shingles(t, width)}) for t in texts(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.array(hashes, pa.list_(pa.int64()))], ["nid", "shingles"])

    return docs.mapInArrow(run, "nid long, shingles array<long>")


def _tile_links(pairs: pa.Table, sets: pa.Table, similarity: float) -> pa.Table:
    """Pairs of one tile whose shingle sets are similar enough."""
    u, v, nid = pairs.column("u").to_numpy(), pairs.column("v").to_numpy(), sets.column("nid").to_numpy()
    by = np.argsort(nid)
    near = _similar(*(by[np.searchsorted(nid[by], x)] for x in (u, v)), sets.column("shingles").combine_chunks(), similarity)
    return pa.table({"u": u[near], "v": v[near]})


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose shingle sets are similar enough, exactly.

    Pairs are cut into tiles by the hashes of both ends. A tile holds each of its sets once, so a group in which
    many pairs are candidates moves its sets a few times and not once a pair.
    """
    mean = sets.agg(F.avg(F.size("shingles"))).first()[0] or 0.0
    sides = max(1, math.ceil(math.sqrt(pairs.count() * max(1 / TILE, 2 * mean / TILE_SHINGLES))))
    side = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
    tiled = pairs.withColumn("tile", side("u") * sides + side("v"))
    ends = tiled.select("tile", F.col("u").alias("nid")).union(tiled.select("tile", "v")).distinct()
    held = ends.hint(SORTED).join(sets, "nid").select(F.col("tile").alias("place"), "nid", "shingles")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        return _tile_links(left, right, similarity)

    return tiled.groupBy("tile").cogroup(held.groupBy("place")).applyInArrow(run, "u long, v long")


def near_copy_groups(
    keyed: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.99, crowd: int = 32, seed: int = 3, block: int = BLOCK
) -> DataFrame:
    """``(key, component)`` of every row of ``keyed (key, text)``: the smallest key of its group of near copies.

    Texts of equal shingle sets are one node. First the candidates of every cell are compared exactly, in a cell with more
    of them than rows each node with its nearest only; the number of pairs follows the rows. Then, in the cells
    that had more, all other candidates whose ends no link has joined so far. So every candidate is compared unless
    its ends are in one group already. Texts without words are alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, width) for t in texts(batch, "_text")]
            prints = pa.array([wide_fingerprint(s) for s in found], pa.binary())
            digests = pa.array([xxhash.xxh3_128_digest(b"\n".join(sorted(s))) for s in found], pa.binary())
            sizes = pa.array([len(s) for s in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), prints, digests, sizes], ["key", "fp", "same", "size"])

    kind = keyed.schema["key"].dataType.simpleString()
    slim = keyed.select("key", F.col("text").cast("string").alias("_text"))
    prints = settle(slim.mapInArrow(run, f"key {kind}, fp binary, same binary, size int"), "wide-prints")
    nodes = prints.groupBy("same").agg(F.min("key").alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"))
    nodes = settle(nodes.withColumn("nid", F.monotonically_increasing_id()), "wide-nodes")
    cells = Cells(nodes.count(), similarity, recall, crowd, seed)
    given = nodes.filter("size > 0")
    found = settle(_candidates(given, cells, similarity, block), "wide-pairs")
    pairs, open_cells = found.filter("u is not null").select("u", "v"), found.filter("u is null").select("table", "cell")

    def sets_of(wanted: DataFrame) -> DataFrame:
        ends = wanted.distinct().hint(SORTED).join(nodes.select("nid", F.col("first").alias("key")), "nid")
        return settle(_shingle_sets(slim.join(ends, "key").dropDuplicates(["nid"]).select("nid", "_text"), width), "wide-sets")

    def rooted(links: DataFrame) -> DataFrame:
        parts = connected_components(links, "wide-parts").withColumnRenamed("node", "nid")
        return nodes.hint(SORTED).join(parts, "nid", "left").withColumn("root", F.coalesce("component", "nid")).drop("component")

    links = settle(_verified(pairs, sets_of(pairs.select(F.col("u").alias("nid")).union(pairs.select("v"))), similarity), "wide-links")
    joined = rooted(links)
    if not open_cells.isEmpty():
        joined = settle(joined, "wide-roots")
        more = settle(_links_between(joined.filter("size > 0"), open_cells, sets_of, cells, similarity, block), "wide-links")
        joined = rooted(links.union(more)) if not more.isEmpty() else joined
    names = joined.groupBy("root").agg(F.min("first").alias("component"))
    return prints.hint(SORTED).join(joined.select("same", "root").hint(SORTED).join(names, "root").select("same", "component"), "same").select("key", "component")


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, **options) -> DataFrame:
    """``docs`` with one row of each group of near copies, columns unchanged.

    The row with the smallest ``doc_id`` stays (nulls last, ties by the text's hash; of rows equal in
    both, one stays). Texts without any word are alike to each other only. An empty table gives no rows.
    """
    ids: Column = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("hash"))
    keyed = docs.select(F.struct("*").alias("row"), ids.alias("key"))
    groups = near_copy_groups(keyed.select("key", F.col("row.text").alias("text")), width, similarity, **options)
    kept = groups.filter("key = component").select("key").distinct()
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
