"""Columns copied from a parent row, and columns made from others, kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last change of each key by ``order``; of changes with one order value the greatest row."""
    return changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("_new"))


def updated(children: DataFrame, changes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``children`` with ``columns`` of the last change of their parent (key, order, columns); children of others stay as they are.

    A change sets all of ``columns``, also to null.  Keys of both sides may be
    null and then meet nothing.  Changes alone are grouped; children meet them
    by one join, for which Spark broadcasts the changes where they are small.
    """
    new = latest(changes, key, order, columns)
    met = children.join(new, key, "left")
    kept = [F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in children.columns]
    return met.select(*kept)


def filled(df: DataFrame, source: str, target: str, make: Callable[[pd.Series], list], batch: int = 32) -> DataFrame:
    """``df`` with ``target`` made where it is null and ``source`` isn't, ``batch`` rows at a time.

    ``make`` gets a series of sources and returns as many values.  Rows that
    have a value don't go through Python, and a task holds one batch.
    """
    missing = F.col(target).isNull() & F.col(source).isNotNull()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch].copy()
                made = make(part[source])
                if len(made) != len(part):
                    raise ValueError(f"{len(made)} values for {len(part)} rows")
                part[target] = pd.Series(list(made), index=part.index, dtype=object)
                yield part

    return df.filter(~missing).unionByName(df.filter(missing).mapInPandas(run, df.schema))

