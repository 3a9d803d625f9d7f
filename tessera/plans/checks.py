"""Assertions about physical plans, for tests and reviews."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan(df: DataFrame) -> str:
    """The formatted physical plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchanges(df: DataFrame) -> int:
    """Shuffles of the plan (without broadcasts and reused ones)."""
    return len(re.findall(r"^[\s:+\-|]*(?:\* )?Exchange \(\d+\)", plan(df), re.M))


def scanned_columns(df: DataFrame) -> list[str]:
    """Columns that the scans read, from their ReadSchema."""
    return [c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(df)) for c in schema.split(",")]


def pushed_filters(df: DataFrame) -> str:
    return "; ".join(re.findall(r"PushedFilters: \[([^\]]*)\]", plan(df)))


def has_cartesian(df: DataFrame) -> bool:
    return "CartesianProduct" in plan(df)
