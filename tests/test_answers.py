"""Reports on answers, comparisons and named cases with nulls, repeats and empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import legal
from tessera.operators import answers


def report(texts, known, shown, **more):
    return {r.id: r for r in answers.report(texts, known, shown, "id", "said", legal.reference_places, legal.reference_key, **more).collect()}


def test_report_strikes_unknown_references_and_flags_those_not_shown(spark):
    texts = spark.createDataFrame([(1, "See AIR 1990 SC 12 and AIR 1991 SC 13."), (2, "None."), (3, None), (4, "")], "id int, said string")
    known = spark.createDataFrame([("AIR 1990 Supreme Court 12",), (None,)], "ref string")
    got = report(texts, known, known.limit(0))
    assert got[1].said.startswith("See AIR 1990 SC 12 and [unverified].") and got[1].said.endswith(answers.NOTE)
    assert (got[1].removed, got[1].flagged, got[1].verified) == (["AIR 1991 SC 13"], ["AIR 1990 SC 12"], ["AIR 1990 SC 12"])
    assert got[1].triggered and got[1].reason == "1 removed; 1 not shown"
    assert got[2].said == "None." and not got[2].triggered and got[3].said is None and got[3].removed == [] and got[4].said == ""
    assert report(texts, known, known, note="")[1].said == "See AIR 1990 SC 12 and [unverified]."
    assert report(texts.limit(0), known, known) == {}


def test_comparison_tells_nulls_and_missing_rows(spark):
    ours = spark.createDataFrame([(1, "A b."), (2, "a b"), (3, None), (4, "x")], "id int, t string")
    theirs = spark.createDataFrame([(1, "a  B"), (2, "b a"), (3, None)], "id int, t string")
    got = {r.id: r.status for r in answers.compared(ours, theirs, "id", "t").collect()}
    assert got[1] == "same" and got[2] == "differs" and got[4] == "missing"


def test_named_case_keeps_rows_without_a_day_apart(spark):
    rows = spark.createDataFrame([("q", 1, 0.9, "X", None), ("q", 2, 0.8, "X", None), ("q", 3, 0.7, "X", 5), ("q", 4, 0.6, "X", 5), ("r", 5, 0.1, "X", 1)], "asked string, id int, score double, court string, day int")
    got = answers.named_case(rows, "asked", "score", F.col("court") == "S", "court", "day", "id").collect()
    assert sorted((r.position, r.id) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_texts_of_one_file_are_dealt_before_they_are_searched(spark):
    """A file of many short texts is one partition, and would be searched by one task."""
    texts = spark.range(50).selectExpr("id", "concat('See (2014) 2 SCC ', id) as said").coalesce(1)
    listed = spark.createDataFrame([("2014 (2) SCC 7",)], "ref string")
    found = answers.report(texts, listed, listed, "id", "said", legal.reference_places, legal.reference_key)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("Generate explode") :]
    assert [r.id for r in found.filter("not triggered").collect()] == [7]
