"""Arrangement of result rows: group quotas, promoted rows, leading rows first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_quota(df: DataFrame, group: str, groups: list[str], shares: tuple[float, ...], most: int, order: list[Column]) -> DataFrame:
    """At most ``most`` rows: of each group, in the order of ``groups``, its share of the places; column place counts from 1.

    A group takes ceil(share * most) places if it has so many rows.  Places that
    are left go to the groups in their order.  Other groups' rows are dropped.
    """
    number = F.array_position(F.array(*map(F.lit, groups)), F.col(group)).cast("int")
    rows = df.filter(F.col(group).isin(groups)).withColumn("_g", number)
    sizes = rows.agg(*(F.count_if(F.col("_g") == i).alias(f"_n{i}") for i in range(1, len(groups) + 1)))
    for i, share in enumerate(shares, 1):
        sizes = sizes.withColumn(f"_t{i}", F.least(F.col(f"_n{i}"), F.lit(-int(-share * most // 1)).cast("long")))
    spare = F.greatest(F.lit(most) - sum(F.col(f"_t{i}") for i in range(1, len(groups) + 1)), F.lit(0))
    sizes = sizes.withColumn("_spare", spare)
    for i in range(1, len(groups) + 1):
        more = F.least("_spare", F.col(f"_n{i}") - F.col(f"_t{i}"))
        sizes = sizes.withColumns({f"_k{i}": F.col(f"_t{i}") + more, "_spare": F.col("_spare") - more})
    quota = F.element_at(F.array(*(F.col(f"_k{i}") for i in range(1, len(groups) + 1))), F.col("_g"))
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).filter(F.col("_rn") <= most)
    taken = first.crossJoin(F.broadcast(sizes)).filter(F.col("_rn") <= quota)  # sizes is one row
    placed = taken.withColumn("place", F.row_number().over(Window.orderBy("_g", "_rn"))).filter(F.col("place") <= most)
    return placed.select(*df.columns, "place")


def promote(df: DataFrame, home: Column, most: int, order: list[Column]) -> DataFrame:
    """All rows by ``order``, but the first ``most`` rows with ``home`` before the others; ``df`` is a short result."""
    nth = F.row_number().over(Window.partitionBy(home).orderBy(*order))
    key = F.when(home & (nth <= most), 0).otherwise(1)
    marked = df.withColumn("_first", key)
    return marked.withColumn("place", F.row_number().over(Window.orderBy("_first", *order))).drop("_first")


def leading_first(leading: DataFrame, rest: DataFrame, key: str, most: int, order: list[Column]) -> DataFrame:
    """``leading`` and then those rows of ``rest`` that are not in it, at most ``most`` rows."""
    every = leading.withColumn("_part", F.lit(0)).unionByName(rest.join(leading.select(key), key, "left_anti").withColumn("_part", F.lit(1)))
    return every.orderBy("_part", *order).limit(most).drop("_part")
