"""Fill-in-the-middle rearrangement of whole texts, with cuts found in a Fenwick tree over text blocks.

A text stays UTF-8 bytes and is divided into blocks of a fixed number of bytes. A Fenwick tree over the
blocks holds two counts of each: units that end in it and code points that begin in it. The place of the
k-th unit's end is found by binary lifting down the tree, which gives its block and both counts before the
block; the boundary is then located inside that one block. A cut costs the logarithm of the number of
blocks plus one block, however long the text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of

#: Bytes of a text block.
BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Blank characters; a unit is a run of others with the blanks before it, or the blanks that end a text.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Blocks:
    """Fenwick tree of units and code points over the blocks of one text."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.block = block
        data = np.frombuffer(text, dtype=np.uint8)
        blank = _BLANK[data]
        # A unit ends after its last byte: where a blank follows, and at the end of the text.
        self.last = ~blank
        self.last[:-1] &= blank[1:]
        self.last[-1:] = True
        self.head = (data & 0xC0) != 0x80  # first bytes of code points
        starts = np.arange(0, len(data), block)
        self.size = len(starts)
        self.tree = np.zeros((self.size + 1, 2), dtype=np.int64)
        if self.size:
            self.tree[1:, 0] = np.add.reduceat(self.last, starts, dtype=np.int64)
            self.tree[1:, 1] = np.add.reduceat(self.head, starts, dtype=np.int64)
        self.units, self.points = self.tree.sum(axis=0).tolist()
        # Level by level, each node hands its sum to its parent, which is node + lowest set bit.
        step = 1
        while step <= self.size:
            nodes = np.arange(step, self.size + 1 - step, 2 * step)
            self.tree[nodes + step] += self.tree[nodes]
            step *= 2

    def cut(self, unit: int) -> tuple[int, int]:
        """Bytes and code points up to the end of the ``unit``-th unit; zero units end at zero."""
        if unit <= 0:
            return 0, 0
        place, left, points = 0, unit, 0
        step = 1 << (self.size.bit_length() - 1)
        while step:
            node = place + step
            if node <= self.size and self.tree[node, 0] < left:
                place = node
                left -= int(self.tree[node, 0])
                points += int(self.tree[node, 1])
            step >>= 1
        at = place * self.block
        end = at + int(np.flatnonzero(self.last[at : at + self.block])[left - 1]) + 1
        return end, points + int(np.count_nonzero(self.head[at:end]))


def draws(key: str, seed: int) -> list[int]:
    """Four 32-bit numbers of a row's key."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: bytes, key: str, rate: int, spm: int, seed: int) -> tuple[int, str, int | None, int | None, bytes]:
    """``(units, form, prefix code points, middle code points, output)`` of one text."""
    blocks = Blocks(text)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return blocks.units, "plain", None, None, text
    first, second = sorted((h1 % (blocks.units + 1), h2 % (blocks.units + 1)))
    a, points = blocks.cut(first)
    b, more = blocks.cut(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        out = b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle))
        return blocks.units, "spm", points, more - points, out
    out = b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle))
    return blocks.units, "psm", points, more - points, out


def fill_in_middle(
    docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output`` for every row.

    ``rate`` of a hundred rows are cut at two places between units and rearranged, ``spm`` of a hundred
    of those with the suffix first (``spm``), the others with the prefix first (``psm``); the rest stay
    ``plain``, as do texts that hold one of the marks, and empty ones. Draws depend on ``seed`` and the id
    alone, so rows of one id are cut alike if their texts are equal, as often as they come; a null id
    draws as an empty one. A null text is empty; an empty table gives no rows; other columns are ignored.
    No row leaves its task, and a task holds one small batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            texts = batch.column("_text").cast(pa.binary())
            rows = [rearranged(t.as_py(), k, rate, spm, seed) for t, k in zip(texts, keys, strict=True)]
            n, form, prefix, middle, out = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            columns = [batch.column("_id"), pa.array(n, pa.int64()), pa.array(form, pa.string())]
            columns += [pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), text_of(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    found = slim.mapInArrow(run, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The original text, from the output and its form alone; each mark occurs once in a rearranged text."""

    def between(opening: str, closing: str | None) -> Column:
        part = output if closing is None else F.split_part(output, F.lit(closing), F.lit(1))
        return F.split_part(part, F.lit(opening), F.lit(2))

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
