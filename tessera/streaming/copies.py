"""Change propagation: a stream of changed parents brings the columns copied to their children up to date.

The children lie in a folder ``bucket=<b>/version=<v>``; a bucket's greatest
version that is marked as done is what it holds.  A batch of changes writes a new version, named by
the batch, of the buckets its parents fall into, and then marks it; so other
buckets aren't read or written, a batch that comes again or was broken off
writes the same again, and readers see whole batches alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.copies import latest, updated

FIRST = -1  # the version that create() writes


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _marks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket int, version long").json(f"{path}/marks")


def create(children: DataFrame, path: str, key: str, buckets: int) -> None:
    """Writes the table of children; the number of buckets has to stay."""
    rows = children.withColumns({"bucket": _bucket(key, buckets), "version": F.lit(FIRST).cast("long")})
    rows.repartition("bucket").write.partitionBy("bucket", "version").parquet(f"{path}/rows")
    children.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(FIRST).cast("long").alias("version")).write.json(f"{path}/marks/batch={FIRST}")


def current(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None, below: int | None = None) -> DataFrame:
    """The children as of the last marked batch, or the last before ``below``; of the given buckets alone, if any are given.

    The marks, a row a bucket and batch that touched it, say which versions to read.
    """
    marks = _marks(spark, path) if below is None else _marks(spark, path).filter(F.col("version") < below)
    chosen = marks.groupBy("bucket").agg(F.max("version").alias("version"))
    rows = spark.read.schema(f"{schema}, bucket int, version long").parquet(f"{path}/rows")
    rows = rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))
    return rows.join(F.broadcast(chosen), ["bucket", "version"], "left_semi").drop("bucket", "version")  # a row a bucket


def apply(spark: SparkSession, path: str, schema: str, changes: DataFrame, batch: int, key: str, order: str, columns: list[str], buckets: int) -> list[int]:
    """Brings the children of the changed parents up to date; the buckets that were written.  A batch may be applied again."""
    new = latest(changes, key, order, columns).select(key, F.lit(0).alias(order), *(F.col("_new")[c].alias(c) for c in columns)).persist()
    try:
        touched = sorted(r.b for r in new.select(_bucket(key, buckets).alias("b")).distinct().collect())  # at most one a bucket
        if touched:
            old = current(spark, path, schema, touched, batch)
            rows = updated(old, new, key, order, columns).withColumns({"bucket": _bucket(key, buckets), "version": F.lit(batch).cast("long")})
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{path}/rows")
            spark.createDataFrame([(b, batch) for b in touched], "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{path}/marks/batch={batch}")
        return touched
    finally:
        new.unpersist()


def propagate(changes: DataFrame, path: str, schema: str, checkpoint: str, key: str, order: str, columns: list[str], buckets: int) -> StreamingQuery:
    """Starts a query that applies a stream of changes (key, order, columns) batch by batch, until all that is there is applied."""

    def one(df: DataFrame, batch: int) -> None:
        apply(df.sparkSession, path, schema, df, batch, key, order, columns, buckets)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
