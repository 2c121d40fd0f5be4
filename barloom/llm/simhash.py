"""SimHash near-duplicates with pigeonring filtering.

Pigeonring principle (Qin and Xiao, VLDB 2018): arrange the segments of two fingerprints in a ring. If
they differ in at most t bits over m segments, some segment starts a chain such that every prefix of l
segments differs in at most l * t / m bits. The one-segment prefix must then be equal, which with six
segments and four bits means at least two equal segments (the four bits touch four segments at most).
Two equal segments are the index key, the chain condition prunes candidates, and the full Hamming
distance decides; no pair within the distance is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import group_starts, lowest_labels, text_of, texts, whole_groups
from barloom.llm.components import connected_components
from barloom.session import settle

#: Members of one block of a hot bucket; a task compares at most two blocks at once.
BLOCK = 1024


def fingerprint(text: str, width: int = 4) -> int:
    """SimHash of the ``width``-word shingles, repeats included; zero for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    spans = zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans]), dtype=np.uint8).reshape(-1, 8)
    ones = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp)``, fp as signed 64-bit number; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in texts(batch, "_text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(found.view(np.int64))], [id_col, "fp"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _layout(segments: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment of a 64-bit fingerprint."""
    sizes = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return [(int(sum(sizes[:i])), s) for i, s in enumerate(sizes)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_filter(a: np.ndarray, b: np.ndarray, distance: int, segments: int) -> np.ndarray:
    """Whether some chain around the ring stays within its proportional budget at every length."""
    xor = a ^ b
    parts = [np.bitwise_count((xor >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int16) for s, n in _layout(segments)]
    ok = np.zeros(len(a), dtype=bool)
    for start in range(segments):
        total = np.zeros(len(a), dtype=np.int16)
        alive = np.ones(len(a), dtype=bool)
        for length in range(1, segments + 1):
            total += parts[(start + length - 1) % segments]
            alive &= total * segments <= length * distance
        ok |= alive
    return ok


def _links_within(rows: pa.Table, distance: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the members of each bucket, reduced to one per member that reaches a smaller one."""
    order = np.lexsort([rows.column(c).to_numpy() for c in ("fp", "pair", "bucket", "index")])
    index, bucket, pair, fp = (rows.column(c).to_numpy()[order] for c in ("index", "bucket", "pair", "fp"))
    starts = group_starts(index, bucket, pair)
    sizes = np.diff(np.append(starts, len(fp)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(fp)) - 1  # members of the group after this one
    key, fp = np.arange(len(fp)), fp.view(np.uint64)
    found_a, found_b = [], []
    step, here = 1, key[left >= 1]
    while len(here):
        a, b = fp[here], fp[here + step]
        near = chain_filter(a, b, distance, segments)
        near[near] = np.bitwise_count(a[near] ^ b[near]) <= distance
        found_a.append(here[near])
        found_b.append(here[near] + step)
        step += 1
        here = here[left[here] >= step]
    if not found_a:
        return fp[:0].view(np.int64), fp[:0].view(np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    nodes, inverse = np.unique(fp.view(np.int64), return_inverse=True)
    label = lowest_labels(inverse[a], inverse[b], len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def near_links(prints: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Links ``(u, v)`` that connect exactly the fingerprints chained by at most ``distance`` differing bits.

    ``prints`` has distinct ``fp``. A bucket with more than ``block`` members is cut into blocks, and each
    pair of blocks is a group of its own, so no task holds a hot bucket. Only links of a spanning forest
    leave a group, never all its pairs.
    """
    segments = distance + 2
    layout = _layout(segments)
    masks = [sum(((1 << layout[i][1]) - 1) << layout[i][0] for i in chosen) for chosen in combinations(range(segments), 2)]
    keyed = prints.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("index", "bucket"),
    )
    counts = keyed.groupBy("index", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    busy = keyed.join(counts, ["index", "bucket"])
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.expr("cast(pmod(xxhash64(fp), blocks) as int)")
    busy = busy.withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    busy = busy.withColumn("other", other).select(
        "index",
        "bucket",
        (F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")).alias("pair"),
        "fp",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["index", "bucket", "pair"]):
            u, v = _links_within(rows, distance, segments)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    keys = ["index", "bucket", "pair"]
    return busy.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def simhash_groups(
    docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """``(id_col, fp, component)`` for every row: its fingerprint and the smallest id it reaches by links.

    Equal fingerprints are one node, so copies never become pairs. Rows without words have fingerprint
    zero and link like any other; a null id never names a component unless all ids of it are null; an
    empty table gives no rows; other columns are ignored.
    """
    prints = settle(fingerprints(docs, width, id_col, text_col), "simhash")
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    links = near_links(nodes.select("fp"), distance, block)
    found = connected_components(links, "simhash-links").withColumnRenamed("node", "fp")
    joined = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    named = joined.groupBy("root").agg(F.min("first").alias("component"))
    lookup = joined.select("fp", "root").join(named, "root").select("fp", "component")
    return prints.join(lookup, "fp").select(id_col, "fp", "component")


def drop_near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, columns unchanged.

    The row with the smallest ``doc_id`` stays (nulls last, ties by the text's hash; of rows equal in
    both, one stays). Texts without any word are alike to each other only.
    """
    # The row travels as one column, so that no name of it can clash.
    ids = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("hash"))
    keyed = docs.select(F.struct("*").alias("row"), ids.alias("key"))
    groups = simhash_groups(keyed.select("key", F.col("row.text").alias("text")), distance, width, "key")
    kept = groups.filter("key = component").select("key").distinct()
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
