"""Neighbours by probed cells against all vectors."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.sources import vectors


def brute(rows, queries, k):
    keys = np.array([r[0] for r in rows])
    x = vectors._unit([r[1] for r in rows])
    out = {}
    for q, v in queries:
        d = np.round(1 - x @ vectors._unit([v])[0], 9)
        out[q] = [int(i) for i in keys[np.lexsort((keys, d))][:k]]
    return out


@pytest.fixture(scope="module")
def stored(spark, medium, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    df = spark.read.parquet(f"{medium}/embeddings.parquet").select("vec_id", "embedding")
    vectors.build(df, path, "vec_id", "embedding", 32)
    return df, [(r.vec_id, r.embedding) for r in df.collect()], path


def found(queries, path, k, probes):
    out = {}
    for r in vectors.neighbours(queries, path, "vec_id", "embedding", k, probes).orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append(r.key)
    return out


def test_recall_of_probed_cells(spark, stored, monkeypatch):
    df, rows, path = stored
    queries = df.filter("vec_id % 20 = 0")
    expected = brute(rows, [(i, v) for i, v in rows if i % 20 == 0], 10)
    got = found(queries, path, 10, 20)
    recall = sum(len(set(got[q]) & set(e)) for q, e in expected.items()) / sum(map(len, expected.values()))
    assert recall >= 0.9, recall  # unclustered vectors in 64 dimensions: 20 of 32 cells, some 0.6 of the rows
    assert found(queries, path, 10, 32) == expected
    monkeypatch.setattr(vectors, "CHUNK", 7)
    assert found(queries, path, 10, 32) == expected


def test_other_cells_are_not_read(spark, stored):
    df, rows, path = stored
    near = vectors.probed(spark, path, rows[3][1], 2)
    assert "PartitionFilters: [cell" in near._jdf.queryExecution().executedPlan().toString()
    assert {r.cell for r in near.select("cell").distinct().collect()} <= set(range(32)) and rows[3][0] in {r.key for r in near.collect()}
    assert near.count() < len(rows) and spark.read.parquet(f"{path}/cells").count() == len(rows)
    asked = df.filter(F.col("vec_id") == rows[3][0])
    top = [r.vec_id for r in retrieval.dense_topk(df, asked, 5).orderBy("dense_rank").collect()]
    assert found(asked, path, 5, 32)[rows[3][0]] == top


def test_null_short_and_equal_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors.build(df, str(tmp_path / "a"), "vec_id", "embedding", 4)
    got = found(df, str(tmp_path / "a"), 2, 4)
    assert got == {1: [1, 2], 2: [1, 2], 5: [5, 6], 6: [6, 1]}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<double>")
    vectors.build(same, str(tmp_path / "b"), "vec_id", "embedding", 8)
    assert found(same.limit(1), str(tmp_path / "b"), 3, 2) == {0: [0, 1, 2]}


def test_many_queries_are_compared_in_blocks():
    rng = np.random.default_rng(3)
    n = 3000
    side = pd.DataFrame({"query": np.arange(n), "asked": list(rng.integers(-2, 3, (n, 3)).astype(float))})
    right = pd.DataFrame({"key": np.arange(n)[::-1], "vector": list(rng.integers(-2, 3, (n, 3)).astype(float))})
    tracemalloc.start()
    got = vectors._nearest(side, right, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n * 8 / 2, peak  # a table of all distances takes n * n * 8 bytes
    rows = list(zip(right["key"], right["vector"], strict=True))
    expected = brute(rows, list(zip(side["query"][:50], side["asked"][:50], strict=True)), 10)
    found_ = {q: [int(i) for i in g.sort_values(["distance", "key"])["key"]] for q, g in got[got["query"] < 50].groupby("query")}
    assert found_ == expected


def test_least_puts_no_numbers_last():
    d = np.array([[np.nan, 2.0, 1.0, 1.0], [np.nan, np.nan, np.nan, 0.5]])
    row, column = vectors._least(d, 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 2), (0, 3), (1, 0), (1, 3)]
