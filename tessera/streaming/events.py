"""Structured Streaming forms of the event operators; each has a batch form in ``tessera.operators``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fan_out(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Rows (kind, id, sender, ts, status) of the messages and statuses nested in webhook payloads; reactions are left out."""
    item = "array<struct<id: string, type: string, from: string, status: string, timestamp: long>>"
    schema = f"entry array<struct<changes: array<struct<value: struct<messages: {item}, statuses: {item}>>>>>"
    values = payloads.select(F.explode(F.from_json(body, schema)["entry"]).alias("e")).select(F.explode("e.changes").alias("c")).select("c.value")
    tagged = lambda kind: F.transform(F.coalesce(f"value.{kind}", F.array().cast(item)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    rows = values.select(F.explode(F.concat(tagged("messages"), tagged("statuses"))).alias("r"))
    fine = rows.filter("not (r.kind = 'messages' and coalesce(r.x.type, '') = 'reaction')")
    return fine.select("r.kind", "r.x.id", F.col("r.x.from").alias("sender"), F.timestamp_seconds("r.x.timestamp").alias("ts"), "r.x.status")


def claim_once(events: DataFrame, key: list[str], time: str = "ts", late: str = "7 days") -> DataFrame:
    """Each key once, for repeats that come within ``late``; state older than that is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, by: list[str], time: str = "ts", width: str = "1 hour", late: str = "1 hour", slide: str | None = None, **measures: Column) -> DataFrame:
    """Counts and measures of tumbling (or sliding) windows; rows later than ``late`` are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = events.withWatermark(time, late).groupBy(window.alias("window"), *by)
    return grouped.agg(F.count("*").alias("n"), *(m.alias(name) for name, m in measures.items()))


def session_counts(events: DataFrame, by: list[str], time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *by)
    return grouped.agg(F.count("*").alias("n"))


def running_balances(entries: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """After each batch, the balance of every user (user_id, delta) it touched; state holds one sum and one count a user.

    With ``ttl_ms`` a user without entries for that long (processing time) is forgotten.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        balance, n = state.get if state.exists else (0, 0)
        for pdf in batches:
            balance, n = balance + int(pdf["delta"].sum()), n + len(pdf)
        state.update((balance, n))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"user_id": [key[0]], "balance": [balance], "entries": [n]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    grouped = entries.select(F.col("user_id").cast("long"), F.col("delta").cast("long")).groupBy("user_id")
    return grouped.applyInPandasWithState(fold, "user_id long, balance long, entries long", "balance long, n long", "update", timeout)


def rate_limited(events: DataFrame, key: str, seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """Rows (key, event_id, allowed): fixed windows that start with the first hit after the last window ran out.

    ``events`` has the key, event_id and a timestamp ts; a batch's hits of a key
    are taken in the order of ts.  Hits later than ``late`` are left out, and a
    key is forgotten when the watermark has passed its window.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        hits = pd.concat(list(batches)).sort_values(["us", "event_id"])  # one key's hits of one micro-batch
        allowed = []
        for us in hits["us"]:
            if start is None or us - start >= seconds * 1_000_000:
                start, used = int(us), 0
            used += 1
            allowed.append(used <= limit)
        state.update((start, used))
        state.setTimeoutTimestamp(max(start // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "event_id": hits["event_id"], "allowed": allowed})

    rows = events.select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("at"))
    return rows.withWatermark("at", late).groupBy("key").applyInPandasWithState(fold, "key long, event_id long, allowed boolean", "start long, used long", "append", GroupStateTimeout.EventTimeTimeout)

