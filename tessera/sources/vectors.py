"""Stored vectors in coarse cells: a search reads the cells nearest to its vector and compares exactly inside them.

Cells are those of centroids found on a bounded sample; every vector is stored,
in the cell of its nearest centroid.  Distances are cosine distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = 64  # vectors a cell that the centroids are found on
ROUNDS = 8
CHUNK = 20_000  # stored vectors that queries meet in one task, and queries
BLOCK = 200  # queries that are placed or compared at a time


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids(vectors: DataFrame, key: str, vector: str, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a sample of at most SAMPLE * cells vectors, chosen by a hash of their keys; the first are spread by distance."""
    some = vectors.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE * cells).select(vector)
    x = _unit(some.toPandas()[vector])
    if not len(x):
        return np.zeros((0, 0))
    chosen = [0]
    far = 1 - x @ x[0]
    while len(chosen) < min(cells, len(x)) and far.max() > 1e-12:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        kept = np.linalg.norm(sums, axis=1) > 1e-12
        c = np.where(kept[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300), c)
    return c


def _placed(rows: DataFrame, key: str, vector: str, c: np.ndarray, n: int) -> DataFrame:
    """Rows (cell, key, vector) of the ``n`` cells nearest to each vector; null vectors and those without length have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[[np.linalg.norm(v) > 0 for v in frame["vector"]]]
            for a in range(0, len(frame), BLOCK):
                some = frame.iloc[a : a + BLOCK]
                near = np.argsort(-(_unit(some["vector"]) @ c.T), axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"cell": near.ravel().astype(np.int32), "key": some["key"].repeat(near.shape[1]).to_numpy(), "vector": some["vector"].repeat(near.shape[1]).to_numpy()})

    known = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    kind = known.schema["key"].dataType.simpleString()
    return known.mapInPandas(run, f"cell int, key {kind}, vector array<double>")


def build(vectors: DataFrame, path: str, key: str, vector: str, cells: int) -> None:
    """Writes all vectors by cell, and the centroids.  Keys have to be unique; the centroids are ``cells`` vectors and are read whole."""
    spark, c = vectors.sparkSession, centroids(vectors, key, vector, cells)
    spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    if len(c):
        placed = _placed(vectors, key, vector, c, 1).withColumn("chunk", F.expr("pmod(xxhash64(key), 64)"))
        placed.repartition("cell", "chunk").drop("chunk").write.partitionBy("cell").parquet(f"{path}/cells")


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()
    return np.array([np.asarray(r) for r in rows["centroid"]])


def probed(spark: SparkSession, path: str, asked: list[float], probes: int) -> DataFrame:
    """The stored rows (cell, key, vector) of the ``probes`` cells nearest to one vector; other cells aren't read."""
    near = np.argsort(-(_centroids(spark, path) @ _unit([asked])[0]), kind="stable")[:probes]
    return spark.read.parquet(f"{path}/cells").filter(F.col("cell").isin([int(i) for i in near]))


def _least(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the ``k`` smallest of each row, the first columns of equal ones; those that are no number come last."""
    d = np.where(np.isnan(distance), np.inf, distance)
    if d.shape[1] <= k:
        return np.nonzero(np.ones(d.shape, dtype=bool))
    last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    below, level = d < last, d == last
    return np.nonzero(below | level & (np.cumsum(level, axis=1, dtype=np.int32) <= k - below.sum(axis=1, keepdims=True)))


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Rows (query, key, distance) of the ``k`` nearest on the right of each query, found for a BLOCK of queries at a time."""
    if not len(left) or not len(right):
        return pd.DataFrame({"query": [], "key": [], "distance": []})
    order = right.sort_values("key")
    keys, stored, found = order["key"].to_numpy(), _unit(order["vector"]).T, []
    for a in range(0, len(left), BLOCK):
        some = left.iloc[a : a + BLOCK]
        distance = np.round(1 - _unit(some["asked"]) @ stored, 9) + 0.0
        row, column = _least(distance, k)
        found.append(pd.DataFrame({"query": some["query"].to_numpy()[row], "key": keys[column], "distance": distance[row, column]}))
    return pd.concat(found)


def neighbours(queries: DataFrame, path: str, key: str, vector: str, k: int, probes: int) -> DataFrame:
    """Rows (query, key, distance, rank) of the ``k`` stored vectors nearest to each query, as far as its ``probes`` cells hold them.

    Queries are sent to their cells.  A cell of many vectors is met in chunks of
    some CHUNK, by as many queries at most, so no task holds more of either, and
    each chunk sends on its ``k`` best.  All queries meet all vectors of their
    cells, which is work by the product of both.  Equal distances (to nine
    digits) go by key.
    """
    spark = queries.sparkSession
    asked = _placed(queries, key, vector, _centroids(spark, path), probes).withColumnsRenamed({"key": "query", "vector": "asked"})
    stored = spark.read.parquet(f"{path}/cells")
    sizes = stored.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("long").alias("chunks"))
    chunked = stored.join(F.broadcast(sizes), "cell").withColumn("chunk", F.expr("pmod(xxhash64(key), chunks)"))  # a row a cell
    counts = sizes.select(F.col("cell").alias("at"), F.col("chunks").alias("many"))
    share = -(-max(queries.count(), 1) // CHUNK)  # a query is in a cell once, so no share of a cell has more than its share of all
    dealt = F.pmod(F.xxhash64("query"), F.lit(share)).alias("share")
    sent = asked.join(F.broadcast(counts), F.col("cell") == F.col("at")).select("at", "query", "asked", F.explode(F.expr("sequence(0L, many - 1)")).alias("part"), dealt)
    chunked = chunked.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(share - 1).cast("long"))))
    kinds = [sent.schema["query"].dataType.simpleString(), chunked.schema["key"].dataType.simpleString()]

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, k)

    met = sent.groupBy("at", "part", "share").cogroup(chunked.groupBy("cell", "chunk", "share")).applyInPandas(nearest, f"query {kinds[0]}, key {kinds[1]}, distance double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "key")))
    return ranked.filter(F.col("rank") <= k)
