"""Reports: gap-filled series, filtered aggregates, percentiles, checksums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_series(events: DataFrame, time: str, first: str, last: str, measures: dict[str, Column]) -> DataFrame:
    """One row per day from ``first`` to ``last`` with the measures of its events; days without events have nulls turned to 0."""
    spark = events.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 day"))).alias("day"))
    inside = events.filter((F.col(time) >= F.lit(first).cast("timestamp_ntz")) & (F.col(time) < (F.to_date(F.lit(last)) + 1).cast("timestamp_ntz")))
    per_day = inside.groupBy(F.to_date(time).alias("day")).agg(*(m.alias(n) for n, m in measures.items()))
    return days.join(per_day, "day", "left").select("day", *(F.coalesce(n, F.lit(0)).alias(n) for n in measures))


BIN = 1.01  # ratio of the edges of a bin


def at_ranks(df: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """Rows (by, n, and a column a rank): the values at ranks of each group, counted from 1; nulls don't count.

    ``ranks`` are expressions of n.  Values are counted by bins a hundredth
    wide, which say in which bin a rank lies; the values of these bins alone are
    then counted one by one.  So no task holds a group's values, and the result
    is exact.
    """
    size = F.floor(F.log(F.abs(F.col(value))) / F.lit(math.log(BIN))) + 1_000_000
    placed = df.filter(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).alias("_v"), F.when(F.col(value) == 0, 0).otherwise(F.signum(value) * size).cast("long").alias("_bin"))
    upto = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.groupBy("_by", "_bin").agg(F.count("*").alias("_k"))
    before = counted.withColumns({"_before": F.coalesce(F.sum("_k").over(upto(["_by"], "_bin")), F.lit(0)), "n": F.sum("_k").over(Window.partitionBy("_by"))})
    wanted = before.select("_by", "_bin", "_before", "_k", "n", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()))).alias("_r"))
    wanted = wanted.filter("_r.rank > _before and _r.rank <= _before + _k").select("_by", "_bin", "n", "_r.name", (F.col("_r.rank") - F.col("_before")).alias("_rank"))
    bins = wanted.select("_by", "_bin").distinct()
    same = lambda a, b: a["_by"].eqNullSafe(b["_by"]) & (a["_bin"] == b["_bin"])
    inside = placed.join(bins, same(placed, bins), "left_semi").groupBy("_by", "_bin", "_v").agg(F.count("*").alias("_k"))
    inside = inside.withColumn("_before", F.coalesce(F.sum("_k").over(upto(["_by", "_bin"], "_v")), F.lit(0)))
    met = inside.join(wanted.withColumnsRenamed({"_by": "_by2", "_bin": "_bin2"}), F.col("_by").eqNullSafe(F.col("_by2")) & (F.col("_bin") == F.col("_bin2"))).filter("_rank > _before and _rank <= _before + _k")
    return met.groupBy(F.col("_by").alias(by)).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks))


def percentiles(df: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Interpolated percentiles and the maximum of ``value`` by ``by``."""
    place = {p: F.lit(p) * (F.col("n") - 1) for p in shares}
    ranks = {f"{side}{i}": f(place[p]) + 1 for i, p in enumerate(shares) for side, f in (("low", F.floor), ("high", F.ceil))}
    known = at_ranks(df, by, value, ranks | {"largest": F.col("n")})
    cut = [(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (place[p] - F.floor(place[p]))).alias(f"p{int(p * 100)}") for i, p in enumerate(shares)]
    return known.select(by, "n", *cut, "largest")


def nearest_rank(df: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Percentiles that are values of the data: the ceil(share * n)-th smallest."""
    return at_ranks(df, by, value, {f"p{int(p * 100)}": F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)) for p in shares}).drop("n")


def checksum(df: DataFrame) -> DataFrame:
    """One row (n, digest) that does not depend on the order of rows.

    The digest adds up the rows' own digests, so it needs no sorted list of all
    rows in one place.
    """
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns))
    part = F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def unequal_counts(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose counts differ between two tables, with both; a key may be in one only."""
    a, b = left.select(key, F.col(count).alias("left_count")), right.select(key, F.col(count).alias("right_count"))
    return a.join(b, key, "full").filter(~F.col("left_count").eqNullSafe(F.col("right_count")))


def setting(override: Column, environment: Column, default: Column) -> Column:
    """The first of the three that is not blank."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(given(override), given(environment), default)
