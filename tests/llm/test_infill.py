"""Fill-in-the-middle against a plain version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text, rate=50, spm=80, seed=42):
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(5)
    pieces = ["a", "Wort", "é", "😀", " ", "  ", "\n", "\t", "\x0b", " ", " ", "<", "<P", ">", "S>"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(150)]
    texts += ["", " ", "\n\n ", "x" * 5000, " " * 5000, "é" * 3000 + " b", "has <P> in it", "<M>", "wort " * 60_000, ("ab😀 \n" * 700) + "  "]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1024])
def test_cuts_at_every_unit(block):
    from barloom.llm.infill import Blocks

    for _, text in rows():
        if len(text) > 4000 or (block < 64 and len(text) > 300):
            continue
        blocks = Blocks(text.encode(), block)
        units = UNIT.findall(text)
        assert (blocks.units, blocks.points) == (len(units), len(text))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert blocks.cut(k) == (len(head.encode()), len(head))


def test_rows_equal_plain(spark):
    from barloom.llm.infill import fill_in_middle, restored

    given = rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in given], "doc_id long, text string, output string, n int")
    for rate, spm, seed in ((50, 80, 42), (100, 30, 7)):
        got = fill_in_middle(docs, rate, spm, seed).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        want = {i: plain(i, t, rate, spm, seed) for i, t in given}
        assert {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got} == want
        assert {r["doc_id"]: r["back"] for r in got} == dict(given)
        assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_null_ids_null_texts_repeats_and_no_rows(spark):
    from barloom.llm.infill import fill_in_middle

    schema = "doc_id long, text string"
    got = fill_in_middle(spark.createDataFrame([(None, "a b"), (None, None), (3, "c d e"), (3, "c d e"), (4, None)], schema)).collect()
    assert len(got) == 5 and all(r["form"] == "plain" for r in got if not r["output"])
    assert len({tuple(r) for r in got if r["doc_id"] == 3}) == 1
    assert {r["output"] for r in got if r["doc_id"] is None} == {plain("", "a b")[4], ""}
    empty = fill_in_middle(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    named = fill_in_middle(spark.createDataFrame([("k", "a b c")], "key string, body string"), id_col="key", text_col="body").first()
    assert (named["n"], named["form"], named["output"]) == (3, *plain("k", "a b c")[1::3])
