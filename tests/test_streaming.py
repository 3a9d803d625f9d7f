"""Streaming forms against their batch forms, over several micro-batches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import events as ev
from tessera.streaming import events as sv

SCHEMA = "event_id long, user_id long, ts timestamp, event_type string, value double"


@pytest.fixture(scope="module")
def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


@pytest.fixture()
def stream(spark, events, tmp_path):
    """The events in four files by time, one a micro-batch."""
    bounds = [r[0] for r in events.selectExpr("percentile(unix_micros(ts), array(0.25D, 0.5D, 0.75D)) as p").select(F.explode("p")).collect()]
    edges = [float("-inf"), *bounds, float("inf")]
    for i in range(4):
        us = F.unix_micros("ts").cast("double")
        events.filter((us > edges[i]) & (us <= edges[i + 1])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return sv.read_events(spark, str(tmp_path / "in"), SCHEMA)


def run(spark, df, tmp_path, mode, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def test_claims_are_made_once(spark, stream, events, tmp_path):
    twice = stream.unionByName(stream)
    found = run(spark, sv.claim_once(twice, ["event_id"], late="60 days"), tmp_path, "append", "claims")
    assert found.count() == found.select("event_id").distinct().count() == events.count()


def test_windows_equal_the_batch(spark, stream, events, tmp_path):
    total = F.sum("value")
    found = run(spark, sv.windowed_counts(stream, ["event_type"], width="1 day", late="40 days", total=total), tmp_path, "update", "windows")
    last = {(r.s, r.event_type): r.n for r in found.groupBy(F.col("window.start").alias("s"), "event_type").agg(F.max("n").alias("n")).collect()}
    batch = events.groupBy(F.date_trunc("day", "ts").alias("s"), "event_type").agg(F.count("*").alias("n"))
    assert last == {(r.s, r.event_type): r.n for r in batch.collect()}


def test_sessions_close_behind_the_watermark(spark, stream, events, tmp_path):
    found = run(spark, sv.session_counts(stream, ["user_id"], gap="6 hours", late="1 minute"), tmp_path, "append", "sessions")
    assert 0 < found.agg(F.sum("n")).first()[0] <= events.count()


def test_balances_equal_the_sums(spark, stream, events, tmp_path):
    delta = F.round(F.col("value") * 100).cast("long").alias("delta")
    found = run(spark, sv.running_balances(stream.select("user_id", delta)), tmp_path, "update", "balances")
    last = {r.user_id: r.b for r in found.groupBy("user_id").agg(F.max_by("balance", "entries").alias("b")).collect()}
    assert last == {r.user_id: r.b for r in events.select("user_id", delta).groupBy("user_id").agg(F.sum("delta").alias("b")).collect()}


def test_rate_limit_equals_the_batch(spark, stream, events, tmp_path):
    found = run(spark, sv.rate_limited(stream, "user_id", 86_400, 2), tmp_path, "append", "limits")
    batch = ev.fixed_windows(events, "user_id", "ts", ["event_id"], 86_400, 2)
    assert {(r.key, r.event_id, r.allowed) for r in found.collect()} == {(r.user_id, r.event_id, r.allowed) for r in batch.collect()}


def test_fan_out(spark):
    body = {"entry": [{"changes": [{"value": {"messages": [{"id": "m1", "type": "text", "from": "9", "timestamp": 5}, {"id": "m2", "type": "reaction", "timestamp": 6}], "statuses": [{"id": "s1", "status": "read", "timestamp": 7}]}}, {"value": {}}]}]}
    rows = spark.createDataFrame([(json.dumps(body),), ("not json",), (None,)], "body string")
    assert sorted((r.kind, r.id, r.status) for r in sv.fan_out(rows).collect()) == [("messages", "m1", None), ("statuses", "s1", "read")]
