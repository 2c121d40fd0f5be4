"""Exact removal of repeated byte strings, with two-stage suffix sorting on what can repeat.

Every string of ``span`` bytes holds the leftmost least of its ``gram``-byte hashes, its anchor, which
depends on the string alone. Equal strings therefore meet under the anchor's hash. Only anchors that occur
twice anywhere are followed up: the bytes around them (one run of starts and ``span`` bytes on) are sent
to the bucket of the hash, equal contexts are collapsed, and the suffixes of the distinct ones are sorted.

Suffix sorting is in two stages (Itoh and Tanaka, 1999): suffixes smaller than their successor are sorted
directly; the others are induced from the order of their successors, scanning the buckets of first bytes
upwards. Neighbours in suffix order that share ``span`` bytes are the repeated strings.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import group_starts, text_of

#: Bytes of text looked at together; a longer text is looked at alone.
_SLAB = 500_000
#: Bytes whose suffixes are sorted together.
_SORTED = 500_000
_LAST = np.iinfo(np.int64).max
_NONE = np.zeros((0, 4), dtype=np.int64)
#: Bytes before a context's own that say how far its anchor is from its start.
_HEAD = 2


def _packed(array: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(array).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind)


# --- suffix sorting ---------------------------------------------------------------------------------


def _words(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as numbers that compare like the bytes; zeros beyond the end."""
    view = np.ndarray(shape=(len(x) - 7,), dtype=">u8", buffer=x, strides=(1,))
    return view[np.minimum(at, len(x) - 8)].astype(np.uint64)


def suffix_order(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes of ``x``; suffixes equal in ``depth`` bytes at least may share a rank.

    ``x`` ends in eight zero bytes, which are not ranked.
    """
    n = len(x) - 8
    head = x[: n + 1].astype(np.int16)
    step = np.sign(head[1:] - head[:-1])  # of each place to the next
    known = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(known[::-1])[::-1]
    small = step[following] > 0  # smaller than the successor; runs take the side of what ends them
    small[n - 1] = False
    direct = np.flatnonzero(small)
    # First stage: sort the small suffixes directly, eight bytes at a time, ties only.
    key = _words(x, direct)
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    new = np.ones(len(direct), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    for at in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        group = np.cumsum(new)[rows]
        word = _words(x, np.minimum(direct[rows] + at, n))
        inner = np.lexsort((word, group))
        direct[rows] = direct[rows][inner]
        word = word[inner]
        new[rows[1:]] |= (word[1:] != word[:-1]) & (np.diff(rows) == 1)
    rank_in = np.cumsum(new) - 1  # among the small ones, ties alike
    # Second stage: buckets of first bytes upwards; in each, the large suffixes, then the small ones.
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[n] = 0  # the end is smaller than everything
    top = 1
    out = []
    first = x[:n]
    large = np.flatnonzero(~small)
    large = large[np.argsort(first[large], kind="stable")]
    edges = np.searchsorted(first[large], np.arange(257))
    small_edges = np.searchsorted(first[direct], np.arange(257))
    for byte in range(256):
        todo = large[edges[byte] : edges[byte + 1]]
        while len(todo):  # once, and again for each further byte of a run
            ready = rank[todo + 1] >= 0
            now, todo = todo[ready], todo[~ready]
            after = rank[now + 1]
            by = np.argsort(after, kind="stable")
            now, after = now[by], after[by]
            fresh = np.ones(len(now), dtype=np.int64)
            fresh[1:] = after[1:] != after[:-1]
            rank[now] = top + np.cumsum(fresh) - 1
            top += int(fresh.sum())
            out.append(now)
        low, high = small_edges[byte], small_edges[byte + 1]
        if high > low:
            own = rank_in[low:high] - rank_in[low]
            rank[direct[low:high]] = top + own
            top += int(own[-1]) + 1
            out.append(direct[low:high])
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), rank[:n]


def equal_strings(x: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """A number for each start; starts share it if and only if their next ``span`` bytes are equal."""
    _, rank = suffix_order(x, span)
    by = np.argsort(rank[starts], kind="stable")
    place, ranks = starts[by], rank[starts][by]
    same = np.zeros(len(starts), dtype=bool)
    # Adjacent common prefixes: neighbours of different rank are compared until they differ.
    same[1:] = True
    open_ = np.flatnonzero(same)
    open_ = open_[ranks[open_] != ranks[open_ - 1]]
    for at in range(0, span, 8):
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(8 * max(0, at + 8 - span))
        differ = ((_words(x, place[open_] + at) ^ _words(x, place[open_ - 1] + at)) & mask) != 0
        same[open_[differ]] = False
        open_ = open_[~differ]
    number = np.empty(len(starts), dtype=np.int64)
    number[by] = np.cumsum(~same)
    return number


# --- anchors ----------------------------------------------------------------------------------------


def _extreme(v: np.ndarray, width: int, pick) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours from each place on; the tail keeps what there is."""
    out, have = v, 1
    while have < width:
        by = min(have, width - have)
        longer = out.copy()
        pick(out[:-by], out[by:], out=longer[:-by])
        out, have = longer, have + by
    return out


def anchor_runs(x: np.ndarray, last: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: (anchor's hash, first start, number of starts, start to anchor).

    ``last`` holds for each text (exclusive end) how far its starts go; ``x`` has eight spare zero bytes.
    """
    n = len(x) - 8
    valid = np.zeros(n, dtype=bool)
    begin = 0
    for end in last.tolist():
        if end - begin >= span:
            valid[begin : end - span + 1] = True
        begin = end
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    word = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=x, strides=(1,))
    h = np.zeros(n, dtype=np.uint64)
    m = n - gram + 1
    for k, at in enumerate([*range(0, gram - 7, 8)]):
        h[:m] += word[at : at + m] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
    for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB), (30, 1)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    value = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)  # zero marks starts that are none
    width = span - gram + 1
    least = _extreme(value, width, np.minimum)
    starts = np.flatnonzero(valid)
    goal = least[starts]
    # The leftmost place of the least: an anchor is a place that some window chose.
    chosen = np.where(valid, least, 0)
    back = _extreme(chosen[::-1], width, np.maximum)[::-1]
    anchors = np.flatnonzero(back == value)
    counts = np.zeros(n + 1, dtype=np.int64)
    counts[anchors + 1] = 1
    at = np.cumsum(counts)[starts]
    place = np.empty(len(starts), dtype=np.int64)
    todo = np.arange(len(starts))
    while len(todo):
        here = anchors[np.minimum(at[todo], len(anchors) - 1)]
        hit = value[here] == goal[todo]
        place[todo[hit]] = here[hit]
        todo = todo[~hit]
        at[todo] += 1
    cut = group_starts(place, np.concatenate(([0], np.cumsum(np.diff(starts) > 1))))
    length = np.diff(np.append(cut, len(starts)))
    # Anchors have small upper halves by choice; the lower halves are even and go first.
    key = h[place[cut]]
    return (key << np.uint64(32)) | (key >> np.uint64(32)), starts[cut], length, place[cut] - starts[cut]


def _slabs(bodies: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes with eight spare zeros, exclusive end of each text) of slabs of whole texts."""
    first = 0
    while first < len(bodies):
        upto, total = first, 0
        while upto < len(bodies) and (upto == first or total + len(bodies[upto]) <= _SLAB):
            total += len(bodies[upto])
            upto += 1
        ends = np.cumsum([len(b) for b in bodies[first:upto]])
        yield first, np.frombuffer(b"".join(bodies[first:upto]) + b"\0" * 8, dtype=np.uint8), ends
        first = upto


# --- the distributed job ----------------------------------------------------------------------------

_MESSAGE = "bucket int, part int, n long, starts binary, sizes binary, ids binary, ties binary, bytes long, body binary, known long, known_ids binary, known_ties binary, known_from binary, known_upto binary"


def repeated_spans(
    docs: DataFrame, span: int = 100, gram: int = 32, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, crowd: int = _SORTED
) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    A byte goes if a string of ``span`` bytes that covers it also starts earlier: in a text of smaller id
    (null ids last, under one id by the text's hash) or before in the same text. Rows equal in id and text
    are one document and come out alike, as often as they come. A null text is empty; texts shorter than
    ``span`` stay whole; an empty table gives no rows; other columns are ignored.

    Texts are dealt once to twice ``parts`` groups (the number of shuffle partitions if not given), and all three
    passes over them read that exchange. ``crowd`` bytes of contexts of one anchor are taken apart by distance. What moves besides is one hash per anchor, one bit back, and the
    distinct contexts of repeated anchors.
    """
    spark = docs.sparkSession
    many = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))  # buckets
    parts = 2 * many
    width = span - gram + 1
    text = text_of(text_col)
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("body"))
    dealt = dealt.withColumn("part", F.expr(f"cast(pmod(xxhash64(id, tie), {parts}) as int)"))

    def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        t = t.combine_chunks()
        ids = t.column("id").fill_null(_LAST).to_numpy()
        return ids, t.column("tie").to_numpy(), t.column("body").to_pylist()

    def buckets(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)).astype(np.int64)

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        found = [anchor_runs(x, ends, span, gram)[0] for _, x, ends in _slabs(read(t)[2])]
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        cut = np.searchsorted(buckets(keys), np.arange(many + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cut)).tolist():
            one = slice(cut[b], cut[b + 1])
            own = np.packbits(counts[one] > 1)
            rows.append((b, key[0].as_py(), int(cut[b + 1] - cut[b]), _packed(keys[one]), own.tobytes()))
        return _rows(rows, pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("own", pa.binary())]))

    def answer(t: pa.Table) -> pa.Table:
        asked = t.to_pylist()
        lists = [_unpacked(r["keys"], r["n"], "<u8") for r in asked]
        own = [np.unpackbits(np.frombuffer(r["own"], np.uint8), count=r["n"]).astype(bool) for r in asked]
        every, counts = np.unique(np.concatenate(lists), return_counts=True)
        often = counts > 1
        for keys, twice in zip(lists, own, strict=True):
            often[np.searchsorted(every, keys[twice])] = True
        rows = [
            (r["bucket"], r["part"], r["n"], np.packbits(often[np.searchsorted(every, keys)]).tobytes())
            for r, keys in zip(asked, lists, strict=True)
        ]
        return _rows(rows, pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("often", pa.binary())]))

    def send(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        ids, ties, bodies = read(t)
        runs = [(first, x, ends, *anchor_runs(x, ends, span, gram)) for first, x, ends in _slabs(bodies)]
        every = np.unique(np.concatenate([r[3] for r in runs])) if runs else np.zeros(0, np.uint64)
        flags = np.zeros(len(every), dtype=bool)
        cut = np.searchsorted(buckets(every), np.arange(many + 1))
        for r in replies.to_pylist():
            flags[cut[r["bucket"]] : cut[r["bucket"]] + r["n"]] = np.unpackbits(np.frombuffer(r["often"], np.uint8), count=r["n"])
        held: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        known = array("q")
        for first, x, ends, keys, starts, lengths, offsets in runs:
            often = np.flatnonzero(flags[np.searchsorted(every, keys)])
            raw = x.tobytes()
            doc = np.searchsorted(ends, starts[often], side="right")
            at = starts[often] - np.concatenate(([0], ends))[doc]
            whole = zip(
                keys[often].tolist(), starts[often].tolist(), (starts + lengths - 1 + span)[often].tolist(), offsets[often].tolist(),
                ids[first + doc].tolist(), ties[first + doc].tolist(), at.tolist(), strict=True,
            )
            for k, a, b, offset, doc_id, tie, start in whole:
                _meet(held, known, (k, offset.to_bytes(2, "little") + raw[a:b]), (doc_id, tie, start))
        del runs
        by: dict[int, list] = {}
        where = buckets(np.fromiter((k for k, _ in held), np.uint64, len(held))).tolist()
        for b in reversed(where):
            by.setdefault(b, []).append(held.popitem())
        part = key[0].as_py()
        rows = [_message(b, part, by.pop(b), _NONE) for b in sorted(by)]
        if known:
            rows.append(_message(part % many, part, [], np.array(known).reshape(-1, 4)))
        return _rows(rows, _schema(_MESSAGE))

    def settle_bucket(t: pa.Table) -> pa.Table:
        held: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        late, done = array("q"), []
        of: dict[tuple[int, int], int] = {}
        for batch in t.to_batches(max_chunksize=16):
            for r in batch.to_pylist():
                entries, own = _read_message(r)
                done.append((r["part"], own))
                for k, v in entries:
                    of[v[:2]] = r["part"]
                    _meet(held, late, k, v)
        found = np.concatenate([np.array(late, dtype=np.int64).reshape(-1, 4), *_repeated(held, span, crowd)])
        part = np.array([of[i, tie] for i, tie in zip(found[:, 0].tolist(), found[:, 1].tolist(), strict=True)], dtype=np.int64)
        done += [(p, found[part == p]) for p in np.unique(part).tolist()]
        return _rows([_message(-1, p, [], rows) for p, rows in done if len(rows)], _schema(_MESSAGE))

    def finish(_: tuple, t: pa.Table, gone: pa.Table) -> pa.Table:
        ids, ties, bodies = read(t)
        cover: dict[tuple[int, int], list] = {}
        for r in gone.to_pylist():
            for doc_id, tie, a, b in _read_message(r)[1].tolist():
                cover.setdefault((doc_id, tie), []).append((a, b))
        rows = []
        for doc_id, tie, body in zip(ids.tolist(), ties.tolist(), bodies, strict=True):
            removed = spans = at = 0
            kept = hashlib.sha256()
            upto = -1
            for a, b in sorted(cover.get((doc_id, tie), [])):
                if a > upto:
                    spans += 1
                    kept.update(body[at:a])
                    removed += b - a
                    at = upto = b
                elif b > upto:
                    removed += b - upto
                    at = upto = b
            kept.update(body[at:])
            rows.append((None if doc_id == _LAST else doc_id, len(body), removed, spans, kept.hexdigest()))
        kinds = [(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        return _rows(rows, pa.schema(kinds))

    assert width > 0 and gram % 8 == 0
    group = dealt.groupBy("part")
    asked = group.applyInArrow(ask, "bucket int, part int, n long, keys binary, own binary")
    replies = asked.groupBy("bucket").applyInArrow(answer, "bucket int, part int, n long, often binary")
    sent = dealt.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(send, _MESSAGE)
    gone = sent.groupBy("bucket").applyInArrow(settle_bucket, _MESSAGE)
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return dealt.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(finish, schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in text.split(", "))])


def _meet(held: dict, known: array, context: tuple[int, bytes], at: tuple[int, int, int]) -> None:
    """Keep the earliest place of a context; the bytes of every other place are known to be repeats."""
    size = len(context[1]) - _HEAD
    before = held.get(context)
    if before is None or at < before:
        held[context] = at
    if before is not None and before != at:
        doc_id, tie, start = max(before, at)
        known.extend((doc_id, tie, start, start + size))


def _message(bucket: int, part: int, entries: list, known: np.ndarray) -> tuple:
    ids, ties, starts = (np.array([v[i] for _, v in entries], dtype=np.int64) for i in range(3))
    sizes = np.array([len(k[1]) for k, _ in entries], dtype=np.int64)
    body = b"".join(k[0].to_bytes(8, "little") + k[1] for k, _ in entries)
    packed = pa.compress(body, codec="zstd", asbytes=True)
    return (
        bucket, part, len(entries), _packed(starts), _packed(sizes), _packed(ids), _packed(ties), len(body), packed,
        len(known), *(_packed(known[:, i]) for i in range(4)),
    )


def _read_message(r: dict) -> tuple[list, np.ndarray]:
    n, body = r["n"], pa.decompress(r["body"], r["bytes"], codec="zstd", asbytes=True) if r["n"] else b""
    starts, sizes, ids, ties = (_unpacked(r[c], n, "<i8").tolist() if n else [] for c in ("starts", "sizes", "ids", "ties"))
    entries, at = [], 0
    for size, *place in zip(sizes, ids, ties, starts, strict=True):
        key = int.from_bytes(body[at : at + 8], "little")
        entries.append(((key, body[at + 8 : at + 8 + size]), tuple(place)))
        at += 8 + size
    names = ("known_ids", "known_ties", "known_from", "known_upto")
    return entries, np.stack([_unpacked(r[c], r["known"], "<i8") for c in names], axis=1) if r["known"] else _NONE


def _repeated(held: dict, span: int, crowd: int) -> Iterator[np.ndarray]:
    """Byte ranges of strings that start earlier in another distinct context under the same anchor hash."""
    by: dict[int, list] = {}
    while held:  # taken over one by one, so nothing is held twice
        (key, body), place = held.popitem()
        by.setdefault(key, []).append((key, body, place))
    batch: list[tuple] = []
    total = 0
    for group in by.values():
        size = sum(len(body) for _, body, _ in group)
        if len(group) > 1 and size > crowd:
            yield _crowded_repeats(group, span)
        elif len(group) > 1:
            batch += group
            total += size
            if total >= _SORTED:
                yield from _sorted_repeats(batch, span)
                batch, total = [], 0
    if batch:
        yield from _sorted_repeats(batch, span)


def _sorted_repeats(batch: list[tuple], span: int) -> Iterator[np.ndarray]:
    x = np.frombuffer(b"".join(body[_HEAD:] for _, body, _ in batch) + b"\0" * 8, dtype=np.uint8)
    sizes = np.array([len(body) - _HEAD for _, body, _ in batch])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = sizes - span + 1
    where = np.repeat(begins - (np.cumsum(counts) - counts), counts)
    where += np.arange(len(where))
    # Strings that differ from all others in a mix of some of their bytes need no sorting.
    mix = np.repeat(np.array([key for key, _, _ in batch], dtype=np.uint64), counts)
    for low in range(0, len(mix), _SORTED):
        some = mix[low : low + _SORTED]
        for at in (0, span // 2 - 4, span - 8):
            some ^= _words(x, where[low : low + _SORTED] + at)
            some *= np.uint64(0x9E3779B97F4A7C15)
            some ^= some >> np.uint64(29)
    heads = group_starts(ordered := np.sort(mix))
    twice = ordered[heads[np.diff(np.append(heads, len(ordered))) > 1]]
    del ordered, heads
    if not len(twice):
        return
    found = [low + np.flatnonzero(np.isin(mix[low : low + _SORTED], twice)) for low in range(0, len(mix), _SORTED)]
    alike = np.concatenate(found)
    where = where[alike]
    ids, ties, starts = (np.array([p[i] for _, _, p in batch]) for i in range(3))
    of = np.searchsorted(begins, where, side="right") - 1
    yield _late_strings(x, where, ids[of], ties[of], starts[of] + where - begins[of], span)


def _crowded_repeats(group: list[tuple], span: int) -> np.ndarray:
    """:func:`_sorted_repeats` for very many contexts of one anchor, as at the edges of a common passage.

    Equal strings are equally far from the anchor, so distances are taken one by one: equal strings are
    collapsed after comparing all their bytes, and suffixes are sorted only where a mix misleads.
    """
    x = np.frombuffer(b"".join(body[_HEAD:] for _, body, _ in group) + b"\0" * 8, dtype=np.uint8)
    sizes = np.array([len(body) - _HEAD for _, body, _ in group])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    offsets = np.array([int.from_bytes(body[:_HEAD], "little") for _, body, _ in group])
    ids, ties, starts = (np.array([p[i] for _, _, p in group]) for i in range(3))
    group.clear()
    counts = sizes - span + 1
    late = np.zeros((len(sizes), int(counts.max()) + 1), dtype=np.int8)
    rest = []
    for distance in range(int(offsets.max()) + 1):
        inside = offsets - distance
        rows = np.flatnonzero((inside >= 0) & (inside < counts))
        where = begins[rows] + inside[rows]
        mix = np.zeros(len(rows), dtype=np.uint64)
        for at in (0, span // 2 - 4, span - 8):
            mix = (mix ^ _words(x, where + at)) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
        order = np.lexsort((starts[rows] + inside[rows], ties[rows], ids[rows], mix))
        rows, where, mix = rows[order], where[order], mix[order]
        heads = group_starts(mix)
        first = np.repeat(heads, np.diff(np.append(heads, len(mix))))
        same = np.ones(len(rows), dtype=bool)
        for at in [*range(0, span - 8, 8), span - 8]:
            same &= _words(x, where + at) == _words(x, where[first] + at)
        odd = np.isin(first, first[~same])
        if odd.any():
            of = rows[odd]
            rest.append(_late_strings(x, where[odd], ids[of], ties[of], starts[of] + inside[of], span))
        place = np.stack((ids[rows], ties[rows], starts[rows] + inside[rows]))
        behind = ~odd & (place != place[:, first]).any(axis=0)
        late[rows[behind], inside[rows[behind]]] = 1
    edge = np.diff(late, axis=1, prepend=0)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return np.concatenate((np.stack((ids[row], ties[row], starts[row] + begin, starts[row] + end - 1 + span), axis=1), *rest))


def _late_strings(x: np.ndarray, where: np.ndarray, ids: np.ndarray, ties: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Rows (id, tie, from, upto) covered by the strings at ``where`` that an earlier place holds too."""
    if not len(where):
        return np.zeros((0, 4), np.int64)
    order = np.argsort(where)
    where, ids, ties, at = where[order], ids[order], ties[order], at[order]
    # Only the covered bytes are sorted: runs of starts close to each other stay in one piece.
    runs = np.flatnonzero(np.concatenate(([True], np.diff(where) > span)))
    first, last = where[runs], where[np.append(runs[1:], len(where)) - 1] + span
    shift = first - np.concatenate(([0], np.cumsum(last - first)[:-1]))
    need = np.repeat(shift, last - first) + np.arange((last - first).sum())
    moved = where - np.repeat(shift, np.diff(np.append(runs, len(where))))
    number = equal_strings(np.concatenate((x[need], np.zeros(8, np.uint8))), moved, span)
    order = np.lexsort((at, ties, ids, number))
    number, ids, ties, at = number[order], ids[order], ties[order], at[order]
    heads = group_starts(number)
    first = np.repeat(heads, np.diff(np.append(heads, len(number))))
    late = (ids != ids[first]) | (ties != ties[first]) | (at != at[first])
    ids, ties, at = ids[late], ties[late], at[late]
    order = np.lexsort((at, ties, ids))
    ids, ties, at = ids[order], ties[order], at[order]
    heads = group_starts(ids, ties, at - np.arange(len(at)))
    ends = np.append(heads[1:], len(at)) - 1
    return np.stack((ids[heads], ties[heads], at[heads], at[ends] + span), axis=1) if len(at) else np.zeros((0, 4), np.int64)
