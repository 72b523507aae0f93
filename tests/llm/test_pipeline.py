"""The corpus pipeline, stage by stage."""

import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F

import pytest

from spellwise.llm import common, simhash, toxicity

from .conftest import LONG, TEXTS

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, SF))
        seen.append((name, before, docs))
    assert [d.columns for _, _, d in seen[:-1]] == [columns] * 4
    (_, raw, mild), (_, _, single), (_, whole, cut), (_, _, mixed), (_, _, encoded) = seen
    gone = raw.join(mild, "doc_id", "left_anti").select("doc_id")
    verdict = toxicity.toxicity(raw, common.table(spark, SF, "labels"), keep=["doc_id"]).where("predicted = 1")
    assert gone.exceptAll(verdict.select("doc_id")).count() == 0 and gone.count() == verdict.count()
    groups = simhash.like_documents(mild)
    assert single.count() == groups.select("component_id").distinct().count() < mild.count()
    assert single.join(groups, "doc_id").where("doc_id <> component_id").count() == 0
    assert cut.where(F.length("text") != F.col("n_chars")).count() == 0
    assert cut.join(whole.select("doc_id", F.length("text").alias("n")), "doc_id").where("length(text) > n").count() == 0
    kept = mixed.select("doc_id").distinct()
    assert kept.count() == cut.count()
    most = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 <= most <= 2
    assert encoded.count() == mixed.count() and encoded.where("NOT round_trip").count() == 0


def test_run_equals_the_stages_and_is_registered(spark, sf):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "ids", "n_tokens"} <= set(rows.columns) and rows.count() > 0


@pytest.mark.parametrize("place", range(5))
def test_stages_stand_odd_rows(spark, odd, none, place):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names and empty tables, at each stage."""
    name, stage = corpus_pipeline.STAGES[place]
    rows = stage(spark, odd, SF).collect()
    kept = sorted(((r.doc_id is not None, r.doc_id or 0) for r in rows))
    every = sorted(((i is not None, i or 0) for i, _ in TEXTS))
    empty = stage(spark, none, SF)
    assert empty.count() == 0
    if place == 4:
        assert kept == every and all(len(r.ids) == r.n_tokens for r in rows)
        return
    assert list(empty.columns) == odd.columns and set(kept) <= set(every)
    texts = {r.doc_id: r.text for r in rows}
    if name == "toxicity":
        assert kept == every and texts[3] is None and texts[6] == LONG
    elif name == "simhash_near_dedup":
        assert set(every) - set(kept) == {(True, 2), (True, 4), (True, 5)} and [r.doc_id for r in rows].count(8) == 2
    elif name == "substring_dedup":
        assert (True, 2) not in kept and {(True, 3), (True, 4), (True, 5), (False, 0)} <= set(kept) and texts[3] is None and len(texts[6]) < len(LONG)
    else:
        assert set(kept) == set(every) and all(r.score == "x" and r.row == "r" for r in rows)
