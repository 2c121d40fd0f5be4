"""Best-fit packing of token pieces into sequences, improved by swaps between underfull bins.

Pieces of one length are interchangeable, so the plan is made on the histogram of lengths (at most
``limit`` entries, whatever the corpus): equal bins are one class with a multiplicity. Best-fit
decreasing runs on whole classes, then a local search exchanges pieces between underfull classes. Spark
tokenizes, cuts, counts, ranks the pieces inside each length and looks up each rank's place.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import texts
from barloom.session import settle

#: Letters and marks that compose, lower-case and split one by one; texts with others take the slow way.
_OTHER = re.compile("[^\t-\r -~¡-±´-¸º»¿-įı-ɏ‐-‧€]")
#: For those texts, the tokenizer's own word pattern in terms of Python's classes.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Words whose ids a worker remembers before it starts anew.
_REMEMBERED = 500_000
_CODERS: dict[str, Callable[[list[str]], list[bytes]]] = {}


def _byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in visible else next(hidden)) for b in range(256))


def coder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of texts as little-endian unsigned 32-bit bytes, without special tokens added.

    For a lower-casing byte-level word vocabulary. A text of plain letters is split into words here and
    each word is encoded once; any other text, or one that spells a special token, goes through the
    tokenizer whole.
    """
    if path in _CODERS:
        return _CODERS[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    pieces, letters = tokenizer.model.tokenize, _byte_letters()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    known: dict[str, bytes] = {}

    def word(w: str) -> bytes:
        spelled = w if w.isascii() else w.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in pieces(spelled)]).tobytes()

    def whole(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def run(batch: list[str]) -> list[bytes]:
        out = []
        for text in batch:
            if _OTHER.search(text) or any(s in text for s in special):
                out.append(whole(text))
                continue
            if len(known) > _REMEMBERED:
                known.clear()
            words = _WORDS.findall(text.lower())
            try:
                out.append(b"".join([known[w] for w in words]))
            except KeyError:
                known.update((w, word(w)) for w in set(words).difference(known))
                out.append(b"".join([known[w] for w in words]))
        return out

    _CODERS[path] = run
    return run


def cut_pieces(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32)``: each text's ids and a closing 0, cut only beyond ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(coder(tokenizer)(texts(batch, "_text"))):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    place.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip((piece, start, length, crc), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(place, pa.int64())), *columns], names)

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


Bin = tuple[tuple[int, int], ...]  # (length, how often), longest first


def _filled(b: Bin) -> int:
    return sum(s * k for s, k in b)


def _changed(b: Bin, out: list[int], into: list[int]) -> Bin:
    items = Counter(dict(b))
    items.subtract(out)
    items.update(into)
    return tuple(sorted(((s, k) for s, k in items.items() if k), reverse=True))


def best_fit(histogram: dict[int, int], limit: int) -> Counter:
    """Best-fit decreasing: bins with their multiplicity. All pieces of one length are placed together."""
    room: dict[int, list[list]] = defaultdict(list)  # free space -> [bin, multiplicity]
    spaces: list[int] = []

    def put(b: Bin, n: int, free: int) -> None:
        if n:
            if not room[free]:
                insort(spaces, free)
            room[free].append([b, n])

    for size in sorted(histogram, reverse=True):
        count = histogram[size]
        while count:
            at = bisect_left(spaces, size)
            if at == len(spaces):
                each = limit // size
                put(((size, each),), count // each, limit - each * size)
                put(((size, count % each),) if count % each else (), int(count % each > 0), limit - count % each * size)
                break
            free = spaces[at]
            b, n = room[free].pop()
            if not room[free]:
                spaces.pop(at)
            each = free // size
            full = min(n, count // each)
            rest = count - full * each if full < n else 0
            put((*b, (size, each)), full, free - each * size)
            if rest:
                put((*b, (size, rest)), 1, free - rest * size)
            put(b, n - full - (rest > 0), free)
            count -= full * each + rest
    bins: Counter = Counter()
    for classes in room.values():
        for b, n in classes:
            bins[b] += n
    return bins


def _step(low: Bin, others: dict[Bin, int], limit: int) -> tuple[Bin, list[int], list[int]] | None:
    """The best exchange that makes a fuller bin fuller: (other bin, pieces it gets, pieces it gives).

    A move needs no piece back; else one piece for a shorter one, else two for one. Among exchanges of one
    kind the one that leaves the other bin least space wins.
    """
    sizes = [s for s, _ in low]
    pairs = sorted({s + t for i, (s, k) in enumerate(low) for t in [x for x, _ in low[i + 1 :]] + [s] * (k > 1)})
    split = {s + t: [s, t] for i, (s, k) in enumerate(low) for t in [x for x, _ in low[i + 1 :]] + [s] * (k > 1)}
    best: tuple | None = None
    for b in others:
        free = limit - _filled(b)
        for s in sizes:
            if s <= free and (best is None or (0, free - s) < best[0]):
                best = ((0, free - s), b, [s], [])
        if best and best[0][0] == 0:
            continue
        for y, _ in b:
            for s in sizes:
                if 0 < s - y <= free and (best is None or (1, free - s + y) < best[0]):
                    best = ((1, free - s + y), b, [s], [y])
            at = bisect_left(pairs, y + free + 1) - 1
            if at >= 0 and 0 < pairs[at] - y <= free and (best is None or (2, free - pairs[at] + y) < best[0]):
                best = ((2, free - pairs[at] + y), b, split[pairs[at]], [y])
    return best and best[1:]


def swap_search(bins: Counter, limit: int, effort: int = 2000) -> Counter:
    """Exchange pieces from the emptiest bins into fuller ones until bins empty.

    Every exchange takes from the emptiest class and makes a fuller bin fuller, so the sum of squared
    fills rises. The search stops at the number of bins that the total length needs, when nothing can
    be exchanged, or after ``effort`` trials with whole classes.
    """
    total = sum(_filled(b) * n for b, n in bins.items())
    fewest = -(-total // limit)
    open_ = {b: n for b, n in bins.items() if _filled(b) < limit}
    full = Counter({b: n for b, n in bins.items() if _filled(b) == limit})
    stuck: Counter = Counter()

    def add(b: Bin, n: int) -> None:
        if b and n:
            if _filled(b) == limit:
                full[b] += n
            else:
                open_[b] = open_.get(b, 0) + n

    for _ in range(effort):
        if not open_ or full.total() + stuck.total() + sum(open_.values()) <= fewest:
            break
        low = min(open_, key=lambda b: (_filled(b), b))
        count = open_.pop(low)
        if count > 1:  # bins alike can also exchange among themselves: one half gives, the other gets
            open_[low] = count // 2
            count -= count // 2
        step = _step(low, open_, limit)
        if step is None:
            stuck[low] += count + open_.pop(low, 0)
            continue
        other, gets, gives = step
        for b, n in stuck.items():  # what was stuck may fit now
            open_[b] = open_.get(b, 0) + n
        stuck.clear()
        both = min(count, open_[other])
        open_[other] -= both
        if not open_[other]:
            del open_[other]
        add(low, count - both)
        add(_changed(low, gets, gives), both)
        add(_changed(other, gives, gets), both)
    return full + stuck + Counter(open_)


class Places:
    """Where the r-th piece of each length goes."""

    def __init__(self, bins: Counter):
        slots = defaultdict(list)
        base = 0
        for b, n in sorted(bins.items(), reverse=True):
            at = 0
            for size, times in b:
                for _ in range(times):
                    slots[size].append((n, base, at))
                    at += size
            base += n
        self.upto = {s: np.cumsum([x[0] for x in v]) for s, v in slots.items()}
        self.base = {s: np.array([x[1] for x in v]) for s, v in slots.items()}
        self.offset = {s: np.array([x[2] for x in v]) for s, v in slots.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for size in np.unique(length).tolist():
            rows = np.flatnonzero(length == size)
            upto, r = self.upto[size], rank[rows]
            k = np.searchsorted(upto, r, side="right")
            before = np.concatenate(([0], upto))[k]
            sequence[rows] = self.base[size][k] + r - before
            offset[rows] = self.offset[size][k]
        return sequence, offset


def pack(
    docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", salts: int = 32
) -> DataFrame:
    """Pack all texts into sequences of at most ``limit`` tokens.

    Returns per piece ``id_col, piece, start, length, ids_crc32, sequence_id, offset``. A null text is an
    empty one and gives the closing 0 alone; repeated rows are packed as often as they come; null ids are
    kept; an empty table gives no rows; other columns are ignored.
    """
    pieces = settle(cut_pieces(docs, tokenizer, limit, id_col, text_col), "pieces")
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)))
    # At most limit x salts rows, so the sums before each part and their broadcast are bounded.
    parts = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = settle(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "lengths")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = Places(swap_search(best_fit(histogram, limit), limit))
    inside = Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
    ranked = ranked.join(F.broadcast(parts.drop("_n")), ["length", "_salt"])
    ranked = ranked.select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.find(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            columns = [*batch.columns[:5], *map(pa.array, found)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
