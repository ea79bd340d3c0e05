"""One row of each text stays at the pipeline's second stage, whatever the ids."""

import pytest

import corpus_pipeline
from wayframe.llm import exact_dedup

DOCS = "doc_id long, text string, `a.b` string, __copied int"


@pytest.mark.parametrize("prune_rows", [0, 1000])
def test_one_row_of_each_text(spark, prune_rows):
    rows = [(1, "x", "p", 1), (1, "x", "p", 1), (1, "x", "o", 2), (None, "y", "q", 1), (None, "y", "q", 1), (3, "z", None, 1), (3, "z", None, None), (2, "z", "r", 1), (None, "w", "s", 1), (7, None, "t", 1), (7, "", "t", 1), (9, "v", "u", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = exact_dedup.one_per_text(docs, prune_rows=prune_rows)
    assert out.columns == docs.columns
    want = [(1, "x", "o", 2), (None, "y", "q", 1), (3, "z", None, None), (None, "w", "s", 1), (7, None, "t", 1), (9, "v", "u", 1)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert exact_dedup.one_per_text(docs.limit(0)).count() == 0


def test_stage_leaves_no_repeated_row(spark, data):
    docs = spark.createDataFrame([(5, "same"), (5, "same"), (None, "none"), (None, "none")], "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, data)
    assert sorted(r.text for r in out.collect()) == ["none", "same"]
