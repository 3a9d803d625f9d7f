"""Event-log operators in batch form: claims, latest state, retention, queue, quotas, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: what insert-or-ignore would have kept."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_state(df: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each key by ``order``; an aggregate, so nothing is sorted."""
    last = F.max(F.struct(*order, *(F.col(v).alias(f"_{v}") for v in values))).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, *(F.col(f"_last._{v}").alias(v) for v in values))


def upsert(target: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``target`` with the last change of each key in place of its row, and new keys added."""
    ranked = changes.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(o) for o in order))))
    last = ranked.filter("_rn = 1").select(*target.columns)
    return target.join(last.select(*key), key, "left_anti").select(*target.columns).unionByName(last)


def insert_absent(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``target`` and the rows of ``new`` whose key it lacks."""
    return target.unionByName(new.select(*target.columns).join(target.select(*key), key, "left_anti").select(*target.columns))


def retain(df: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; rows without a time stay."""
    kept = F.col(time) >= F.expr(f"timestamp_ntz '{as_of}' - interval {days} days")
    return df.filter(F.col(time).isNull() | kept)


def erase(tables: dict[str, DataFrame], owners: DataFrame, keys: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the owners' rows, and how many rows each lost; ``owners`` has the one column owner."""
    left, lost = {}, None
    for name, df in tables.items():
        own = owners.select(F.col("owner").alias(keys[name])).distinct()
        left[name] = df.join(own, keys[name], "left_anti").select(*df.columns)
        count = df.join(own, keys[name], "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("name"), "deleted")
        lost = count if lost is None else lost.unionByName(count)
    return left, lost


def queue_stats(jobs: DataFrame, as_of: str) -> DataFrame:
    """One row for jobs (state, run_at, done_at): waiting, active, dead, done in the last day, and the oldest wait in seconds."""
    now = F.lit(as_of).cast("timestamp_ntz")
    waiting = (F.col("state") == "QUEUED") & (F.col("run_at") <= now)
    day = F.expr(f"timestamp_ntz '{as_of}' - interval 1 day")
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    return jobs.agg(
        F.count_if(waiting).alias("waiting"),
        F.count_if(F.col("state") == "ACTIVE").alias("active"),
        F.count_if(F.col("state") == "DEAD").alias("dead"),
        F.count_if((F.col("state") == "DONE") & (F.col("done_at") >= day)).alias("done_24h"),
        F.coalesce(seconds(now) - F.min(F.when(waiting, seconds(F.col("run_at")))), F.lit(0)).alias("oldest_wait"),
    )


def claimable(jobs: DataFrame, as_of: str, slots: int) -> DataFrame:
    """The oldest ready jobs (job_id, lock_key, state, run_at, lease_until), one of each lock key, none whose key has a live lease."""
    now = F.lit(as_of).cast("timestamp_ntz")
    live = jobs.filter((F.col("state") == "ACTIVE") & (F.col("lease_until") > now)).select("lock_key").distinct()
    ready = jobs.filter((F.col("state") == "QUEUED") & (F.col("run_at") <= now)).join(live, "lock_key", "left_anti")
    return claim_first(ready, ["lock_key"], ["run_at", "job_id"]).orderBy("run_at", "job_id").limit(slots)


def retry(attempts: Column, most: int, base_seconds: int = 5, cap: int = 300) -> tuple[Column, Column]:
    """(state, delay in seconds) after a failed attempt: doubling delays up to the cap, DEAD after the last attempt."""
    delay = F.least(F.lit(float(cap)), base_seconds * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(30)))).cast("long")
    return F.when(attempts >= most, "DEAD").otherwise("QUEUED"), F.when(attempts < most, delay)


def reclaim(jobs: DataFrame, as_of: str, most: int) -> DataFrame:
    """Jobs whose lease has run out go back to QUEUED, or to DEAD at the last attempt."""
    stalled = (F.col("state") == "ACTIVE") & (F.col("lease_until") < F.lit(as_of).cast("timestamp_ntz"))
    state = F.when(stalled & (F.col("attempts") >= most), "DEAD").when(stalled, "QUEUED").otherwise(F.col("state"))
    return jobs.withColumns({"state": state, "lease_until": F.when(~stalled, F.col("lease_until"))})


def within_quota(df: DataFrame, key: list[str], time: str, order: list[str], limit: int) -> DataFrame:
    """Adds ``allowed``: whether the row is among the first ``limit`` of its key and day."""
    w = Window.partitionBy(*key, F.to_date(time)).orderBy(*order)
    return df.withColumn("allowed", F.row_number().over(w) <= limit)


def sessions(df: DataFrame, key: list[str], time: str, order: list[str], gap_seconds: int) -> DataFrame:
    """Adds ``session``, counting from 1 in each key: a row more than the gap after the one before starts a new one."""
    w = Window.partitionBy(*key).orderBy(*order)
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    fresh = F.coalesce((seconds - F.lag(seconds).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    return df.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w)).drop("_new")


def fixed_windows(df: DataFrame, key: str, time: str, order: list[str], seconds: int, limit: int) -> DataFrame:
    """Rows (key, order columns, window, allowed): a window starts with the first hit after the last one has run out.

    Where a window starts depends on every hit before it, so each key's hits are
    folded in order.  Rows of a key come sorted and are read one by one.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp")).alias("_us")
    rows = df.select(F.col(key).alias("_key"), micros, *order)
    schema = ", ".join([f"{key} {df.schema[key].dataType.simpleString()}", *(f"{o} {df.schema[o].dataType.simpleString()}" for o in order), "window long", "allowed boolean"])

    def fold(batches):
        now, start, number, used = object(), 0, 0, 0
        for pdf in batches:
            windows, allowed = [], []
            for k, us in zip(pdf["_key"], pdf["_us"], strict=True):
                if k != now:
                    now, start, number, used = k, us, 1, 0
                elif us - start >= seconds * 1_000_000:
                    start, number, used = us, number + 1, 0
                used += 1
                windows.append(number)
                allowed.append(used <= limit)
            out = pdf.drop(columns=["_us"]).rename(columns={"_key": key})
            yield out.assign(window=windows, allowed=allowed)

    return rows.repartition("_key").sortWithinPartitions("_key", "_us", *order).mapInPandas(fold, schema)


def recent_turns(turns: DataFrame, key: str, order: str, n: int, chars: int) -> DataFrame:
    """The last 2 * n turns of each conversation in their order, texts cut to ``chars``, without leading assistant turns."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    last = turns.withColumn("_rn", F.row_number().over(back)).filter(F.col("_rn") <= 2 * n)
    forward = Window.partitionBy(key).orderBy(order)
    started = F.max((F.col("role") != "assistant").cast("int")).over(forward) == 1
    kept = last.withColumn("_started", started).filter("_started")
    return kept.withColumn("text", F.substring("text", 1, chars)).drop("_rn", "_started")
