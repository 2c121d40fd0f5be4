"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest


def brute(docs, span):
    """docs: (id, text) in order; (n_bytes, n_removed, n_spans, sha256) of each."""
    seen, out = set(), {}
    for key in sorted({k for k in docs}, key=lambda k: (k[0] is None, k[0] or 0, k[2])):
        body = (key[1] or "").encode()
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - span + 1):
            s = body[i : i + span]
            if s in seen:
                gone[i : i + span] = True
            seen.add(s)
        kept = bytes(np.frombuffer(body, np.uint8)[~gone])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[key] = (len(body), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_equals_sorting(seed):
    from barloom.llm.suffixes import equal_strings, suffix_order

    rng = random.Random(seed)
    body = bytes(rng.choices(b"ab\0" if seed % 2 else b"abcdefgh", k=400)) + b"aaaa" * 20 + bytes(rng.choices(b"ab", k=30)) * 3
    x = np.frombuffer(body + b"\0" * 8, np.uint8)
    order, rank = suffix_order(x, 10_000)
    want = sorted(range(len(body)), key=lambda i: body[i:])
    assert order.tolist() == want and len(set(rank.tolist())) == len(body)
    starts = np.arange(len(body) - 20 + 1)
    number = equal_strings(x, starts, 20).tolist()
    strings = [body[i : i + 20] for i in starts]
    assert len(set(zip(strings, number))) == len(set(strings)) == len(set(number))


def test_removal_equals_brute_force(spark):
    from pyspark.sql import functions as F

    from barloom.llm.suffixes import repeated_spans

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeéß😀 ", k=rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice([*passages, passages[0][: rng.randint(90, 120)], ""]))
        texts.append("\n".join(parts))
    texts += [texts[3], texts[4][7:], None, "", "x" * 99, "x" * 100, "x" * 101, "ab" * 700, "x" * 5000, "b" + "ab" * 300, "\0" * 150, "\0" * 120]
    rows = [(i, t, "l", 1) for i, t in enumerate(texts)]
    rows += [(None, texts[5], "l", 2), (2, texts[2], "l", 3), (2, texts[9], "l", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, tie int")
    hashes = [r[0] for r in docs.select(F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    for span, gram, crowd in ((100, 32, 10**6), (20, 8, 10**6), (100, 32, 0), (20, 8, 0)):
        want = brute([(i, t, h) for (i, t, *_), h in zip(rows, hashes, strict=True)], span)
        got = repeated_spans(docs, span, gram, parts=5, crowd=crowd).collect()
        key = lambda r: tuple(str(v) for v in r)
        assert sorted(map(tuple, got), key=key) == sorted(((k[0], *want[k]) for k in ((r[0], r[1], h) for r, h in zip(rows, hashes, strict=True))), key=key)
    assert repeated_spans(docs.limit(0)).count() == 0


def test_query(spark):
    from barloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = brute([(r["doc_id"], r["text"], 0) for r in docs], 100)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op8_suffixes"](spark, folder).collect()}
    assert got == {k[0]: v for k, v in want.items()}
