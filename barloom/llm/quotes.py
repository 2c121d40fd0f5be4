"""Chat formatting by quotation linking: replies are found by what they quote.

A message's lines carry a quote level (the number of ``>`` marks). Paragraphs and lines, normalised and
hashed, link a quoted passage to the latest earlier message of the conversation that wrote it itself.
Messages then follow in reply order, each under the one it answers, with quotes taken out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import texts
from barloom.session import settle

_MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
_SAYS = re.compile(r".*\b(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$", re.IGNORECASE)
TEMPLATE = "<|{role}|>\n{text}\n"


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of each line; a line that announces a quote counts as quoted."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        out.append((m.group(1).count(">"), line[m.end() :]) if m else (0, line))
    for i, (level, line) in enumerate(out[:-1]):
        after = next((x for x in out[i + 1 : i + 3] if x[1].strip() or x[0]), (0, ""))
        if after[0] > level and _SAYS.match(line):
            out[i] = (after[0], "")
    return out


def normal(passage: str) -> str:
    return " ".join(passage.lower().split())


def units(lines: list[tuple[int, str]]) -> list[tuple[int, str, int]]:
    """(level, hash, characters) of each paragraph and, where it has several, each of its lines."""
    out: list[tuple[int, str, int]] = []
    part: list[str] = []
    level = 0

    def close() -> None:
        whole = normal("\n".join(part))
        for passage in [whole, *(map(normal, part) if len(part) > 1 else ())]:
            if passage:
                out.append((level, xxhash.xxh128_hexdigest(passage.encode("utf-8", "replace")), len(passage)))
        part.clear()

    for now, line in lines:
        if part and (now != level or not line.strip()):
            close()
        level = now
        if line.strip():
            part.append(line)
    if part:
        close()
    return out


def own_text(lines: list[tuple[int, str]]) -> str:
    kept = "\n".join(line for level, line in lines if level == 0)
    return re.sub(r"\n{3,}", "\n\n", kept).strip("\n")


_UNIT = pa.struct([("level", pa.int32()), ("hash", pa.string()), ("chars", pa.int64())])


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with their own text and the units they write or quote, under a row number of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [levels(t) for t in texts(batch, "text")]
            # Only messages that quote differ from what they were given.
            own = [own_text(s) if any(k for k, _ in s) else t for s, t in zip(split, batch.column("text").to_pylist(), strict=True)]
            found = [[{"level": k, "hash": h, "chars": n} for k, h, n in units(s)] for s in split]
            quotes = [len({u["level"] for u in f if u["level"]}) and sum(u["level"] > 0 for u in f) for f in found]
            columns = [*batch.columns, pa.array(own, pa.string()), pa.array(found, pa.list_(_UNIT)), pa.array(quotes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "own", "units", "n_quotes"])

    # A message without a conversation is one of its own.
    alone = F.concat(F.lit("-"), F.md5(F.concat_ws("|", F.col("turn").cast("string"), "role", "text")))
    conv = F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), alone)
    slim = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"), conv.alias("conv"))
    slim = slim.withColumn("row", F.monotonically_increasing_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    unit = "array<struct<level:int,hash:string,chars:bigint>>"
    return slim.mapInArrow(run, f"{kinds}, own string, units {unit}, n_quotes long")


def reply_order(messages: DataFrame) -> DataFrame:
    """One row per message of ``(conv_id, turn, role, text)`` in reply order.

    Returns ``conv_id, turn, role, text`` (without quotes), ``position`` in the conversation from 0,
    ``reply_to`` (the answered message's place by turn, from 0), ``depth`` of replies above, ``n_quotes``,
    ``n_linked`` and ``rendered``. The answered message is the one that wrote most characters of what is
    quoted at the lowest linked level, ties to the latest; a message without a linked quote starts at the
    top, in turn order. Messages of one turn are ordered by content, repeated rows stay, null turns come
    first, a null text stays null, a message of quotes alone gets an empty text, an empty table gives no
    rows, other columns are ignored.
    """
    table = settle(parsed(messages), "messages")
    # Numbering carries no texts.
    by_turn = Window.partitionBy("conv").orderBy("turn", "tie", "row")
    places = table.select("row", "conv", "turn", F.xxhash64("role", "text").alias("tie"))
    places = settle(places.select("row", "conv", (F.row_number().over(by_turn) - 1).alias("place")), "places")
    units = table.filter("size(units) > 0").join(places.select("row", "place"), "row")
    units = units.select("row", "conv", "place", F.explode("units").alias("u")).select("row", "conv", "place", "u.*")
    # Only hashes that somebody quotes can link; the latest own use before a quote is its original.
    quoted = units.filter("level > 0").select("conv", "hash").distinct()
    live = units.join(quoted, ["conv", "hash"], "left_semi")
    before = Window.partitionBy("conv", "hash").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    origin = F.last(F.when(F.col("level") == 0, F.col("place")), ignorenulls=True).over(before)
    linked = live.withColumn("origin", origin).filter("level > 0 and origin is not null")
    votes = linked.groupBy("row", "conv", "place", "level", "origin").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    best = F.max_by("origin", F.struct(-F.col("level"), "chars", "origin"))
    parents = settle(votes.groupBy("row", "conv", "place").agg(best.alias("parent"), F.sum("n").alias("n_linked")), "parents")
    # Paths from the top by pointer doubling: the number of rounds is the logarithm of the longest chain.
    own = F.format_string("%010d", "place")
    nodes = places.join(parents.select("row", "parent"), "row", "left")
    paths = settle(nodes.select("row", "conv", "place", F.col("parent").alias("up"), own.alias("path"), F.lit(0).alias("depth"))
                   .withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)), "paths")
    while not paths.filter("up is not null").isEmpty():
        above = paths.select("conv", F.col("place").alias("up"), F.col("up").alias("far"), F.col("path").alias("head"), F.col("depth").alias("more"))
        joined = paths.join(above, ["conv", "up"], "left")
        step = F.col("head").isNotNull()
        paths = joined.select(
            "row",
            "conv",
            "place",
            F.when(step, F.col("far")).alias("up"),
            F.when(step, F.concat_ws("/", "head", "path")).otherwise(F.col("path")).alias("path"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        )
        paths = settle(paths, "paths")
    by_path = Window.partitionBy("conv").orderBy("path")
    order = paths.select("row", "depth", (F.row_number().over(by_path) - 1).cast("long").alias("position"))
    links = parents.select("row", F.col("parent").cast("long").alias("reply_to"), "n_linked")
    out = table.drop("units", "text").join(order, "row").join(links, "row", "left")
    shown = F.replace(F.replace(F.lit(TEMPLATE), F.lit("{role}"), F.coalesce("role", F.lit(""))), F.lit("{text}"), F.coalesce("own", F.lit("")))
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.col("own").alias("text"),
        "position",
        "reply_to",
        F.col("depth").cast("long").alias("depth"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        shown.alias("rendered"),
    )
