"""Every operator and stage over nulls, empty and long texts, equal rows, no rows and clashing columns."""

import pytest

import corpus_pipeline
from vectorloom.llm import ctw, iblt, licenses, merkle, mixing, packing, quality, secrets, sharding, simhash, toxicity, wordpieces

OPERATORS = {
    "ctw": ctw.scored, "iblt": iblt.fingerprinted, "secrets": secrets.scan, "quality": quality.judged, "sharding": sharding.sharded,
    "mixing": mixing.mixed, "simhash": simhash.near_duplicates, "wordpieces": wordpieces.token_counts,
    "merkle": merkle.checked, "licenses": licenses.scan,
}


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_are_all_answered(odd, name):
    found = OPERATORS[name](odd).collect()
    assert len(found) == 11
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((i is None, i or 0) for i in [1, 2, 3, None, None, 5, 5, 6, 7, 8, 9])


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows_give_no_rows(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


def test_odd_rows_are_packed(odd, nothing):
    pieces = packing.pack_documents(odd, capacity=64, shard_items=4).collect()
    assert {r["doc_id"] for r in pieces} == {1, 2, 3, None, 5, 6, 7, 8, 9}
    assert sum(1 for r in pieces if r["doc_id"] == 5) == 2 and sum(1 for r in pieces if r["doc_id"] == 1) == 1
    assert packing.pack_documents(nothing).collect() == []


def test_odd_rows_are_scored_for_toxicity(spark, odd, nothing):
    known = labels_of(spark, [(5, 1, 0), (7, 1, 1), (7, 1, None), (None, 1, 1), (99, 0, 1)])
    found = toxicity.scored(odd, known).collect()
    assert len(found) == 11 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in toxicity.scored(odd, labels_of(spark, [])).collect()} == {0.5}
    assert toxicity.scored(nothing, known).collect() == []


def test_values_of_odd_rows(odd):
    by_id = {r["doc_id"]: r for r in mixing.mixed(odd).collect() if r["doc_id"] is not None}
    assert by_id[1]["size"] == by_id[2]["size"] == by_id[3]["size"] == 0 and by_id[1]["taken"] == 0 and by_id[7]["size"] == 6000
    assert {r["doc_id"]: r["n_tokens"] for r in ctw.scored(odd).collect()}[1] == 1
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.sharded(odd).collect()}[1] == (1, 0)
    same = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect() if r["doc_id"] is not None}
    assert same[5] == same[6] == 5 and same[1] == same[2] == same[3] == 1
    assert all(r["fingerprint"] == "0" * 16 for r in simhash.near_duplicates(odd).collect() if r["doc_id"] in (1, 2, 3))


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_and_no_rows(spark, odd, nothing, stage):
    _, work = corpus_pipeline.STAGES[stage]
    for docs in (odd, nothing):
        out = work(spark, docs, "")
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        found = [r["doc_id"] for r in out.collect()]
        if docs is nothing:
            assert found == []
        elif stage == 0:
            # One text has 50 words, and it repeats itself.
            assert set(found) <= {7}
        elif stage == 4:
            assert set(found) == {1, 2, 3, None, 5, 6, 7, 8, 9}
        else:
            assert len(found) == {1: 6, 2: 11, 3: 14}[stage]
