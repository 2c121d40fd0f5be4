"""Quality rules and language-specific perplexity bands from a modified Kneser-Ney model.

The model is over UTF-8 bytes, of order five (Chen and Goodman, 1999: interpolated, three discounts an
order): a five-byte gram is a 40-bit number, so the grams of a language are sorted arrays of numbers that
collide with nothing and need no cut-off. Texts are dealt to parts once; each part sends its distinct grams
and counts to the bucket of the two middle bytes that orders three to five share, the bucket merges them
and answers each part with two log-probabilities a gram: one in its language by all counts, and one by the counts
of the other parts in all languages, which the bands look at: no text explains itself, and a clean text may mix
languages. Lower orders need one small table a language and one for all.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import group_starts, text_of
from barloom.session import settle

ORDER = 5
#: Fixed by the rules: symbols, and the limits of the base verdict.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: Width of a band below and above the median in robust standard deviations of the held-out bits per byte, and at
#: least so many bits each way, for a language whose texts are mostly equal.
BELOW, ABOVE, LEAST_BAND = 7.0, 8.0, 0.05
#: A byte counts at most so many held-out bits, so that keys and numbers in a clean text weigh little.
MOST_BITS = 3.0
_SLAB = 2_000_000
#: Held-out bits travel as 16-bit numbers of so many steps a bit.
_STEPS = 1024
#: Stands for all languages together; real ones start with a plus sign, or are a minus sign for null.
_ALL = "*"
_BLANK = [9, 10, 11, 12, 13, 32]


def grams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text number) of every byte of the texts; each text starts after line ends."""
    pad = b"\n" * (ORDER - 1)
    x = np.frombuffer(b"".join(pad + b for b in bodies), dtype=np.uint8)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    key = np.zeros(max(0, len(x) - ORDER + 1), dtype=np.uint64)
    for k in range(ORDER):
        key = (key << np.uint64(8)) | x[k : len(x) - ORDER + 1 + k]
    ends = np.cumsum(sizes + ORDER - 1)
    # A gram belongs to the text of its last byte; grams that end in padding belong to none.
    last = np.arange(len(key)) + ORDER - 1
    owner = np.repeat(np.arange(len(bodies)), sizes + ORDER - 1)[ORDER - 1 :]
    real = last - np.repeat(ends - sizes, sizes + ORDER - 1)[ORDER - 1 :] >= 0
    return key[real], owner[real]


def _slabs(bodies: list[bytes]):
    first = 0
    while first < len(bodies):
        upto, total = first, 0
        while upto < len(bodies) and (upto == first or total + len(bodies[upto]) <= _SLAB):
            total += len(bodies[upto])
            upto += 1
        yield first, bodies[first:upto]
        first = upto


def _merged(lists: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of sorted lists, with the sums of their counts."""
    keys, n = np.concatenate(lists), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    heads = group_starts(keys)
    return keys[heads], np.add.reduceat(n, heads) if len(heads) else n


def counted(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(grams(part)[0], return_counts=True) for _, part in _slabs(bodies)]
    return _merged([k for k, _ in found], [c for _, c in found])


def _zip(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unzip(blob: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind)


def _zip_sorted(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _unzip_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unzip(blob, 8 * n, "u1").reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


# --- modified Kneser-Ney ----------------------------------------------------------------------------


def counts_of_counts(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts of one, two, and three or more, from the numbers of counts one to four."""
    if (n <= 0).any():
        return np.array([0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)])
    return np.clip(d, 0.05, [0.95, 1.9, 2.85])


def _interpolated(context: np.ndarray, n: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probability of each gram from its count, its context (equal neighbours) and its lower-order probability."""
    heads = group_starts(context)
    size = np.diff(np.append(heads, len(n)))
    taken = d[np.minimum(n, 3) - 1]
    total = np.add.reduceat(n, heads)
    free = np.add.reduceat(taken, heads) / total
    return (n - taken) / np.repeat(total, size) + np.repeat(free, size) * lower


def _continued(keys: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams without their first byte and how many first bytes each has; ``drop`` bytes remain."""
    return np.unique(keys & np.uint64((1 << (8 * drop)) - 1), return_counts=True)


def lower_tables(pairs: np.ndarray) -> np.ndarray:
    """P(byte | byte before) for all 65536 pairs from the numbers of distinct bytes before each pair."""
    pairs = pairs.reshape(256, 256).astype(np.int64)
    single = (pairs > 0).sum(axis=0)
    d = np.concatenate(([0.0], discounts(counts_of_counts(single[single > 0]))))
    taken = d[np.minimum(single, 3)]
    p1 = (single - taken) / single.sum() + taken.sum() / single.sum() / 256
    d = np.concatenate(([0.0], discounts(counts_of_counts(pairs[pairs > 0]))))
    taken = d[np.minimum(pairs, 3)]
    total = np.maximum(1, pairs.sum(axis=1, keepdims=True))
    return ((pairs - taken) / total + taken.sum(axis=1, keepdims=True) / total * p1).ravel()


def pairs_of(keys: np.ndarray) -> np.ndarray:
    """The distinct last two bytes of the grams."""
    return np.unique(keys & np.uint64(0xFFFF)).astype(np.int64)


def _less(n: np.ndarray, less: np.ndarray, group: np.ndarray, total: np.ndarray, taken: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """:func:`_interpolated` for some grams after ``less`` of each count is gone; all grams that lose any are here."""
    d = np.concatenate(([0.0], d))
    rest = n - less
    own = d[np.minimum(rest, 3)]
    at, back = np.unique(group, return_inverse=True)
    lost = np.bincount(back, weights=less, minlength=len(at))[back]
    free = taken[group] - np.bincount(back, weights=d[np.minimum(n, 3)] - own, minlength=len(at))[back]
    left = total[group] - lost
    # A context that no other part has leaves all to the lower order.
    known = left > 0.5
    left = np.where(known, left, 1.0)
    return np.where(known, (rest - own) / left + np.maximum(free, 0.0) / left * lower, lower)


class Bucket:
    """The grams of one bucket with their counts in all parts; ``pairs`` as :func:`lower_tables`."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, tables: list[np.ndarray], pairs: np.ndarray) -> None:
        self.keys, self.tables = keys, tables
        self.k4, c4 = _continued(keys, 4)
        self.k3, c3 = _continued(self.k4, 3)
        self.p2 = pairs[(self.k3 & np.uint64(0xFFFF)).astype(np.int64)]
        self.to4 = np.searchsorted(self.k4, keys & np.uint64(0xFFFFFFFF))
        self.to3 = np.searchsorted(self.k3, self.k4 & np.uint64(0xFFFFFF))
        self.levels = []
        for k, c, d in ((keys, n, tables[0]), (self.k4, c4, tables[1]), (self.k3, c3, tables[2])):
            heads = group_starts(k >> np.uint64(8))
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(k))))
            self.levels.append((c, group, np.add.reduceat(c, heads), np.add.reduceat(d[np.minimum(c, 3) - 1], heads)))

    def held_out(self, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the distinct grams at places ``at`` without ``own`` of each one's count.

        Time is in proportion to ``at``. A gram that is gone no longer counts as a continuation in the order
        below, down to order three; orders two and one keep the numbers of neighbours in all parts.
        """
        n5, g5, t5, f5 = self.levels[0]
        n4, g4, t4, f4 = self.levels[1]
        n3, g3, t3, f3 = self.levels[2]
        at4, from5 = np.unique(self.to4[at], return_inverse=True)
        gone4 = np.bincount(from5, weights=n5[at] == own, minlength=len(at4)).astype(np.int64)
        at3, from4 = np.unique(self.to3[at4], return_inverse=True)
        gone3 = np.bincount(from4, weights=n4[at4] == gone4, minlength=len(at3)).astype(np.int64)
        p3 = _less(n3[at3], gone3, g3[at3], t3, f3, self.tables[2], self.p2[at3])
        p4 = _less(n4[at4], gone4, g4[at4], t4, f4, self.tables[1], p3[from4])
        return -np.log2(_less(n5[at], own, g5[at], t5, f5, self.tables[0], p4[from5]))


def bits(keys: np.ndarray, n: np.ndarray, tables: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """-log2 of the probability of each gram of a bucket; ``tables`` are the discounts of orders 5, 4, 3."""
    k4, c4 = _continued(keys, 4)
    k3, c3 = _continued(k4, 3)
    p3 = _interpolated(k3 >> np.uint64(8), c3, tables[2], pairs[(k3 & np.uint64(0xFFFF)).astype(np.int64)])
    p4 = _interpolated(k4 >> np.uint64(8), c4, tables[1], p3[np.searchsorted(k3, k4 & np.uint64(0xFFFFFF))])
    p5 = _interpolated(keys >> np.uint64(8), n, tables[0], p4[np.searchsorted(k4, keys & np.uint64(0xFFFFFFFF))])
    return -np.log2(p5)


# --- rules ------------------------------------------------------------------------------------------


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and whether the base rules reject."""
    body = text.encode("utf-8", "replace")
    words = body.split()
    blanks = sum(map(body.count, map(lambda b: bytes([b]), _BLANK)))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += bool(line.encode("utf-8", "replace").split())
        seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
    return len(words), len(text) - blanks, symbols, duplicates, repeated, failed


# --- the distributed job ----------------------------------------------------------------------------

_ASK = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _spark(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the third and fourth byte, which the grams of orders three to five around them share."""
    middle = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((middle * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int | None = None) -> DataFrame:
    """``id, tie`` (the text's hash), ``lang``, the base counts, ``base_failed``, ``bits`` (per byte, null for an empty text) and ``held``.

    ``bits`` is by the counts of all texts of the language, ``held`` by those of all languages in all parts but
    the text's own, with at most ``MOST_BITS`` a byte.
    """
    spark = docs.sparkSession
    # Each part is scored by the others.
    parts = max(2, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = text_of(text_col)
    lang = F.coalesce(F.concat(F.lit("+"), F.col(lang_col).cast("string")), F.lit("-"))
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), lang.alias("lang"), text.alias("body"), F.xxhash64(text).alias("tie"))
    dealt = dealt.withColumn("part", F.expr(f"cast(pmod(xxhash64(id, tie), {parts}) as int)"))

    def by_lang(t: pa.Table) -> dict[str, np.ndarray]:
        langs = np.array(t.column("lang").to_pylist(), dtype=object)
        return {v: np.flatnonzero(langs == v) for v in sorted(set(langs))}

    def bodies(t: pa.Table) -> list[str]:
        return t.column("body").to_pylist()

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        rows, every = [], [b.encode("utf-8", "replace") for b in bodies(t)]
        for name, at in by_lang(t).items():
            keys, n = counted([every[i] for i in at.tolist()])
            where = _buckets(keys, parts)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(parts + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = order[cut[b] : cut[b + 1]]
                rows.append((name, b, key[0].as_py(), len(own), _zip_sorted(keys[own]), _zip(n[own].astype("<i8"))))
        return _table(rows, _ASK)

    model_schema = pa.schema([*list(_ASK)[:2], *list(_ASK)[3:], ("coc", pa.binary()), ("pairs", pa.binary()), ("some", pa.binary())])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        own: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for r in t.to_pylist():
            own.setdefault(r["lang"], []).append((_unzip_sorted(r["keys"], r["n"]), _unzip(r["counts"], r["n"], "<i8")))
        models = {name: _merged([k for k, _ in found], [n for _, n in found]) for name, found in own.items()}
        # The model of all languages is put together from theirs again where it is needed.
        every = _merged([k for k, _ in models.values()], [n for _, n in models.values()])
        rows = []
        for name, (keys, n) in [*models.items(), (_ALL, every)]:
            k4, c4 = _continued(keys, 4)
            k3, c3 = _continued(k4, 3)
            pairs = np.bincount((k3 & np.uint64(0xFFFF)).astype(np.int64), minlength=65536)
            coc = np.concatenate([counts_of_counts(c) for c in (n, c4, c3)])
            some = pairs_of(keys).astype("<u2").tobytes()
            if name == _ALL:
                keys, n = keys[:0], n[:0]
            rows.append((name, key[0].as_py(), len(keys), _zip_sorted(keys), _zip(n), _zip(coc), _zip(pairs), some))
        return _table(rows, model_schema)

    lower_schema = pa.schema([("lang", pa.string()), ("discounts", pa.binary()), ("lower", pa.binary())])

    def lower(key: tuple, t: pa.Table) -> pa.Table:
        coc, pairs = np.zeros(12, np.int64), np.zeros(65536, np.int64)
        for r in t.to_pylist():
            coc += _unzip(r["coc"], 12, "<i8")
            pairs += _unzip(r["pairs"], 65536, "<i8")
        d = np.concatenate([discounts(coc[i : i + 4]) for i in (0, 4, 8)])
        return _table([(key[0].as_py(), _zip(d), _zip(lower_tables(pairs)))], lower_schema)

    done_schema = pa.schema([*list(_ASK)[:2], *list(_ASK)[3:], ("discounts", pa.binary()), ("some", pa.binary()), ("lower", pa.binary())])

    def finish(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                # A bucket needs only its own pairs of the lower table.
                lows = _unzip(r["lower"], 65536, "<f8")[np.frombuffer(r["some"], "<u2")]
                rows.append((r["lang"], r["bucket"], r["n"], r["keys"], r["counts"], r["discounts"], r["some"], _zip(lows)))
            yield from _table(rows, done_schema).to_batches()

    reply_schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("bits", pa.binary()), ("held", pa.binary())])

    def reply(key: tuple, asked: pa.Table, model: pa.Table) -> pa.Table:
        models, merged = {}, {}
        for m in model.to_pylist():
            d, pairs, some = _unzip(m["discounts"], 9, "<f8"), np.zeros(65536), np.frombuffer(m["some"], "<u2")
            pairs[some] = _unzip(m["lower"], len(some), "<f8")
            models[m["lang"]] = [d[:3], d[3:6], d[6:]], pairs
            merged[m["lang"]] = _unzip_sorted(m["keys"], m["n"]), _unzip(m["counts"], m["n"], "<i8")
        every = _merged([k for k, _ in merged.values()], [n for _, n in merged.values()])
        bucket = Bucket(*every, *models[_ALL])
        full = {name: bits(*merged[name], *models[name]).astype("<f4") for name in merged if name != _ALL}
        by_part: dict[int, list[tuple[dict, np.ndarray]]] = {}
        for r in asked.to_pylist():
            by_part.setdefault(r["part"], []).append((r, _unzip_sorted(r["keys"], r["n"])))
        rows = []
        for part, asks in by_part.items():
            own, n = _merged([k for _, k in asks], [_unzip(r["counts"], r["n"], "<i8") for r, _ in asks])
            held = np.minimum(bucket.held_out(np.searchsorted(every[0], own), n), MOST_BITS)
            held = np.rint(held * _STEPS).astype("<u2")
            for r, keys in asks:
                found = full[r["lang"]][np.searchsorted(merged[r["lang"]][0], keys)]
                rows.append((r["lang"], r["bucket"], part, r["n"], _zip(found), _zip(held[np.searchsorted(own, keys)])))
        return _table(rows, reply_schema)

    kinds = [("id", pa.int64()), ("tie", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in _BASE), ("base_failed", pa.bool_()), ("bits", pa.float64()), ("held", pa.float64())]
    score_schema = pa.schema(kinds)

    def score(_: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        every = bodies(t)
        raw = [b.encode("utf-8", "replace") for b in every]
        answers: dict[str, list[dict]] = {}
        for r in replies.to_pylist():
            answers.setdefault(r["lang"], []).append(r)
        total, total_held = np.zeros(len(every)), np.zeros(len(every))
        for name, at in by_lang(t).items():
            own = [raw[i] for i in at.tolist()]
            parts_of = [_sorted_grams(part) for _, part in _slabs(own)]
            keys = _merged([p[0] for p in parts_of], [p[0] for p in parts_of])[0]
            where = _buckets(keys, parts)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(parts + 1))
            cost, held = np.zeros(len(keys)), np.zeros(len(keys))
            for r in answers.get(name, []):
                asked_for = order[cut[r["bucket"]] : cut[r["bucket"] + 1]]
                cost[asked_for] = _unzip(r["bits"], r["n"], "<f4")
                held[asked_for] = _unzip(r["held"], r["n"], "<u2") / _STEPS
            for (first, part), (distinct, inverse, owner) in zip(_slabs(own), parts_of, strict=True):
                place = np.searchsorted(keys, distinct)
                total[at[first : first + len(part)]] = np.bincount(owner, weights=cost[place][inverse], minlength=len(part))
                total_held[at[first : first + len(part)]] = np.bincount(owner, weights=held[place][inverse], minlength=len(part))
        means = [[s / len(b) if b else None for s, b in zip(t.tolist(), raw, strict=True)] for t in (total, total_held)]
        counts = list(zip(*map(base_counts, every), strict=True)) or [()] * 6
        columns = [t.column("id"), t.column("tie"), t.column("lang"), *counts, *means]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, score_schema, strict=True)], schema=score_schema)

    asked = dealt.groupBy("part").applyInArrow(ask, _spark(_ASK))
    model = asked.groupBy("bucket").applyInArrow(merge, _spark(model_schema))
    lowers = model.select("lang", "coc", "pairs").groupBy("lang").applyInArrow(lower, _spark(lower_schema))
    done = model.drop("coc", "pairs").join(lowers, "lang").mapInArrow(finish, _spark(done_schema))
    replies = asked.groupBy("bucket").cogroup(done.groupBy("bucket")).applyInArrow(reply, _spark(reply_schema))
    return dealt.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(score, _spark(score_schema))


def _sorted_grams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams, place of each sorted gram among them, its text): one sort of gram and text together."""
    key, owner = grams(bodies)
    both = np.sort((key << np.uint64(24)) | owner.astype(np.uint64))
    key, owner = both >> np.uint64(24), (both & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return key[new], (np.cumsum(new) - 1).astype(np.int32), owner


def judged(
    docs: DataFrame,
    below: float = BELOW,
    above: float = ABOVE,
    least: float = LEAST_BAND,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    parts: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, language, base counts, ``base_failed``, ``perplexity``, band, ``kept`` and ``held_out``.

    ``perplexity`` is by all texts of the language, ``held_out`` by the texts of all languages in other parts.
    A language's band goes from the median of held-out bits per byte of its texts that pass the base rules
    ``below`` and ``above`` robust standard deviations (the interquartile range over 1.349) down and up, at
    least ``least`` bits; both ends belong to it. All counts and statistics cover all rows; a language without a passing
    text has no band. Null languages are one language of their own, a null text has no words and fails the
    base rules, repeated rows count as often as they come, an empty table gives no rows, other columns are
    ignored.
    """
    out = verdicts(docs, below, above, id_col, text_col, lang_col, parts, least)
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("lang") != "-", F.expr("substring(lang, 2)")).alias(lang_col),
        *_BASE,
        "base_failed",
        F.pow(F.lit(2.0), "bits").alias("perplexity"),
        F.pow(F.lit(2.0), "low").alias("lower"),
        F.pow(F.lit(2.0), "high").alias("upper"),
        "kept",
        F.pow(F.lit(2.0), "held").alias("held_out"),
    )


def verdicts(docs: DataFrame, below: float, above: float, id_col: str, text_col: str, lang_col: str, parts: int | None, least: float) -> DataFrame:
    """Rows of :func:`scored` with ``low``, ``high`` and ``kept``."""
    rows = settle(scored(docs, id_col, text_col, lang_col, parts), "quality")
    # One aggregation with partial sketches; nothing is dealt by language before it is summed.
    quarters = F.percentile_approx("held", [0.25, 0.5, 0.75], 10_000).alias("q")
    spread = rows.filter("not base_failed").groupBy("lang").agg(quarters).filter("q is not null")
    middle, sigma = F.col("q")[1], (F.col("q")[2] - F.col("q")[0]) / 1.349
    half = lambda wide: F.greatest(sigma * wide, F.lit(float(least)))
    bands = spread.select("lang", (middle - half(below)).alias("low"), (middle + half(above)).alias("high"))
    out = rows.join(bands, "lang", "left")
    inside = F.coalesce(F.col("held").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def drop_rejected(docs: DataFrame, below: float = BELOW, above: float = ABOVE, least: float = LEAST_BAND) -> DataFrame:
    """``docs`` (with ``doc_id, text, lang``) without the rows that :func:`judged` rejects, columns unchanged."""
    found = verdicts(docs, below, above, "doc_id", "text", "lang", None, least)
    # One language and text has one verdict, whatever rows hold it.
    rejected = found.filter(~F.col("kept")).select(F.struct("id", "tie", "lang").alias("key")).distinct()
    lang = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("-"))
    key = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("tie"), lang.alias("lang"))
    # The row travels as one column, so that no name of it can clash.
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return keyed.join(rejected, keyed["key"].eqNullSafe(rejected["key"]), "left_anti").select("row.*")
