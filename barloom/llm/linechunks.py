"""Line dedup over content-defined chunks of lines, in DataFrame functions only.

A line's hash is the first 28 bits of its MD5. A polynomial rolling hash over the last ``window`` line
hashes ends a chunk after a line when it is divisible by ``divisor``, so boundaries depend on the lines
alone and fall back into step after an insertion. So that a shared passage has the same boundaries between
unlike neighbours, a chunk also ends where the number of times that two adjacent lines occur together
over all documents is lower than beside it (see :func:`edges`), and no boundary by the rolling hash leaves a
line alone beside such an edge or right after another boundary. Chunks of two or more lines that
hold a word are compared over all documents; every occurrence but the first is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of

_BASE, _PRIME = 1_000_003, 2_147_483_647
#: A text has a word if something in it is neither blank nor one of tab to carriage return.
HAS_WORD = r"[^\x20\x09-\x0D]"


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each text."""
    return F.transform(F.array(value), use)[0]


def pairs(text: Column) -> Column:
    """Array of one hash per two adjacent lines."""
    both = lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda one, i: F.xxhash64(one, F.get(x, i + 1)))
    return _bound(F.split(text, "\n", -1), both)


def edges(hits: Column) -> Column:
    """Sorted cuts of a text whose repeated pairs are ``hits``, an array of ``(at, n)`` by place.

    Pair ``at`` (from 1) is lines ``at`` and ``at + 1``, found ``n`` times; all other pairs, and the text's
    two ends, count once. A cut lies inside a pair that counts no more than the pairs on either side and
    less than one of them; of two adjacent repeated ones only the first is cut. A cut after line ``at`` is
    ``2 * at``, one more if the next pair is repeated.
    """

    def around(x: Column, k: Column) -> Column:
        beside = lambda step: F.when(
            F.get(hits, k + step)["at"] == x["at"] + step, F.get(hits, k + step)["n"]
        ).otherwise(F.lit(1).cast("long"))
        return F.struct(
            x["at"].alias("at"), x["n"].alias("n"), beside(-2).alias("second"), beside(-1).alias("left"),
            beside(1).alias("right"), F.coalesce(F.get(hits, k + 1)["at"] == x["at"] + 2, F.lit(False)).alias("near"),
        )

    def cuts(x: Column) -> Column:
        low = (x["n"] <= x["left"]) & (x["n"] <= x["right"]) & ((x["n"] < x["left"]) | (x["n"] < x["right"]))
        low = low & ~((x["n"] == x["left"]) & (x["left"] < x["second"]))
        return F.array_compact(
            F.array(
                F.when(x["left"] == 1, x["at"] * 2 - 1),
                F.when(low, x["at"] * 2 + 1),
                F.when((x["right"] == 1) & ~x["near"], x["at"] * 2 + 2),
            )
        )

    return F.flatten(F.transform(F.transform(hits, around), cuts))


def chunks(text: Column, hits: Column, window: int, divisor: int) -> Column:
    """Array of ``(lines, shared)``: the chunks of ``text``, all lines in order; are its line pairs repeated?

    ``hits`` are the text's repeated pairs as :func:`edges` takes them. Work is linear in the lines but for one sort.
    """

    def rolling(hashes: Column, i: Column) -> Column:
        value = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            value = F.pmod(value * F.lit(_BASE) + F.get(hashes, i - back), F.lit(_PRIME))
        return value

    def chosen(x: Column) -> Column:
        n = F.size(x["lines"])
        places = F.concat(F.transform(x["edges"], lambda e: F.shiftright(e, 1)), F.array(n))
        barred = F.flatten(F.transform(places, lambda e: F.array(e - 1, e, e + 1)))
        drawn = F.filter(F.sequence(F.lit(1), n), lambda i: F.coalesce(rolling(x["hashes"], i - 1), F.lit(1)) % divisor == 0)
        return F.struct(x["lines"].alias("lines"), x["edges"].alias("edges"), F.array_except(drawn, barred).alias("drawn"))

    def ends(x: Column) -> Column:
        n = F.size(x["lines"])
        apart = F.array_except(x["drawn"], F.transform(x["drawn"], lambda i: i + 1))
        return F.struct(x["lines"].alias("lines"), x["edges"].alias("edges"), apart.alias("drawn"), n.alias("n"))

    def ordered(x: Column) -> Column:
        at = F.transform(hits, lambda h: h["at"])
        inside = F.transform(F.array_intersect(x["drawn"], at), lambda i: i * 2 + 1)
        outside = F.transform(F.array_except(x["drawn"], at), lambda i: i * 2)
        hard = F.filter(x["edges"], lambda e: (e > 1) & (e < x["n"] * 2))
        first = F.filter(F.slice(x["edges"], 1, 1), lambda e: e == 1)
        # The first entry is where the text starts.
        start = F.array(F.size(first))
        return F.struct(
            x["lines"].alias("lines"), F.concat(start, F.array_sort(F.concat(hard, inside, outside, F.array(x["n"] * 2)))).alias("ends")
        )

    def cut(x: Column) -> Column:
        def part(e: Column, k: Column) -> Column:
            before = F.get(x["ends"], k)
            start = F.shiftright(before, 1)
            return F.struct(
                F.slice(x["lines"], start + 1, F.shiftright(e, 1) - start).alias("lines"), (before % 2 == 1).alias("shared")
            )

        return F.transform(F.slice(x["ends"], F.lit(2), F.size(x["ends"]) - 1), part)

    hashed = _bound(
        F.split(text, "\n", -1),
        lambda x: F.struct(x.alias("lines"), F.transform(x, line_hash).alias("hashes"), edges(hits).alias("edges")),
    )
    return _bound(_bound(_bound(_bound(hashed, chosen), ends), ordered), cut)


def drop_repeated_chunks(
    docs: DataFrame, window: int = 2, divisor: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``_chunks`` and ``_dropped`` added and repeated chunks taken out of the text.

    A chunk's first occurrence is the one in the smallest id (nulls last; under one id by the text's hash,
    then by place). ``_chunks`` counts a text's chunks, ``_dropped`` lists the removed ones by number from
    0. Rows equal in id and text are one document and come out alike, as often as they come. A null text
    stays null, an empty one has one chunk without a word, which is never removed; a text that loses all
    its chunks becomes empty. Other columns are kept, but for any named ``_chunks`` or ``_dropped``; an empty
    table gives no rows.
    """
    text = text_of(text_col)
    key = F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text, F.lit(1)).alias("hash")
    )
    # The row travels as one column, so that no name of it can clash; in an array, so that both joins below
    # need the same columns and Spark shuffles the texts once for the two.
    keyed = docs.select(F.array(F.struct("*")).alias("_row"), key.alias("_key"))
    row = F.get("_row", F.lit(0))
    body = F.transform("_row", lambda r: F.coalesce(r[text_col].cast("string"), F.lit("")))[0]
    slim = docs.select(key.alias("_key"), F.posexplode(pairs(text)).alias("at", "pair"))
    shared = _repeated_pairs(slim)
    parts = chunks(body, F.col("_hits"), window, divisor)
    pieces = keyed.join(shared, "_key").select("_key", F.posexplode(parts).alias("place", "part"))
    # A chunk is repeated only if its line pairs are.
    pieces = pieces.filter("part.shared and size(part.lines) > 1").withColumn("body", F.concat_ws("\n", "part.lines"))
    pieces = pieces.filter(F.col("body").rlike(HAS_WORD)).withColumn("sign", F.xxhash64("body"))
    # Signs are counted without their texts; only texts of repeated signs are shuffled for comparison.
    signs = pieces.select("_key", "place", "sign").groupBy("sign").agg(F.count("*").alias("n")).filter("n > 1")
    held = pieces.select("_key", "place", "sign", "body").join(signs.select("sign"), "sign", "left_semi")
    at = F.struct("_key", "place")
    first = held.groupBy("sign", "body").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = held.join(first, ["sign", "body"]).filter(at != F.col("first")).select("_key", "place")
    dropped = later.groupBy("_key").agg(F.array_sort(F.collect_set("place")).alias("_dropped"))
    marked = keyed.join(shared, "_key", "left").join(dropped, "_key", "left")
    some = F.coalesce("_hits", F.array().cast("array<struct<at:int,n:bigint>>"))
    marked = marked.withColumn("_hits", some).withColumn("_parts", parts)
    places = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_dropped"))
    left = F.concat_ws("\n", F.flatten(F.transform(places, lambda k: F.get("_parts", k)["lines"])))
    new = F.when(F.col("_dropped").isNull(), row[text_col]).otherwise(left)
    columns = [new.alias(c) if c == text_col else row[c].alias(c) for c in docs.columns if c not in ("_chunks", "_dropped")]
    none = F.array().cast("array<int>")
    return marked.select(*columns, F.size("_parts").alias("_chunks"), F.coalesce("_dropped", none).alias("_dropped"))


def _repeated_pairs(found: DataFrame) -> DataFrame:
    """``_key, _hits``: per text its pairs ``(at, n)`` that occur more than once, of rows ``(_key, at, pair)``."""
    several = found.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1")
    hits = F.struct((F.col("at") + 1).alias("at"), "n")
    return found.join(several, "pair").groupBy("_key").agg(F.array_sort(F.collect_set(hits)).alias("_hits"))
