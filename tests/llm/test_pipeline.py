"""The pipeline's stages, each against a plain check of its own input."""

import pytest

import corpus_pipeline
from barloom.llm.common import table
from barloom.session import fresh_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        path = fresh_path(spark, "step")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, given, docs))
    return out


def test_stages_keep_columns_and_take_effect(steps):
    for name, given, got in steps[:-1]:
        assert got.columns == given.columns, name
    sizes = [given.count() for _, given, _ in steps]
    assert all(a >= b for a, b in zip(sizes, sizes[1:])) and sizes[-1] < sizes[0]


def test_quality_keeps_what_the_query_keeps(spark, steps):
    from barloom.llm.queries import QUERIES

    want = {r["doc_id"] for r in QUERIES["op6_perplexity"](spark, FOLDER).filter("kept").collect()}
    assert {r["doc_id"] for r in steps[0][2].collect()} == want


def test_line_dedup_leaves_no_repeated_chunk_out_of_order(steps):
    from plain import drop_chunks

    given = {r["doc_id"]: r["text"] for r in steps[1][1].collect()}
    want = {k: v for k, v in drop_chunks(given).items() if v.split()}
    assert {r["doc_id"]: r["text"] for r in steps[1][2].collect()} == want


def test_near_copies_go_and_nothing_else_does(steps):
    """Every document that goes has a near or equal text among the given ones; no two near texts stay."""
    from plain import near_pairs, sets

    given = {r["doc_id"]: r["text"] for r in steps[2][1].collect()}
    kept = {r["doc_id"] for r in steps[2][2].collect()}
    pairs, known = near_pairs(given), sets(given)
    paired = {k for p in pairs for k in p}
    first = {}
    for k in sorted(given):
        first.setdefault(known[k], k)
    assert all(k in paired or first[known[k]] != k for k in set(given) - kept)
    assert not any(a in kept and b in kept for a, b in pairs)
    assert len({known[k] for k in kept}) == len(kept)


def test_packing_holds_every_document_once(steps):
    given = {r["doc_id"] for r in steps[4][1].collect()}
    pieces = steps[4][2].collect()
    assert {r["doc_id"] for r in pieces} == given
    ends = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_run_equals_the_stages(spark, steps):
    assert corpus_pipeline.run(spark, FOLDER).drop("sequence_id", "offset").exceptAll(
        steps[-1][2].drop("sequence_id", "offset")
    ).isEmpty()


def test_documents_with_nulls_and_no_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "w " * 60_000, "en", None, 1), (3, None, "de", "b", 0)]
    rows += [(10 + i, " ".join(f"w{i}x{k}" for k in range(60)), "en" if i % 2 else None, None if i % 3 else "s", 1) for i in range(12)]
    rows = [(*r, 1, "k", 2, 0.5) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, row string, id int, draw double"
    for given in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            path = fresh_path(spark, "step")
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() >= 0
