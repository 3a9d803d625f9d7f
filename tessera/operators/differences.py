"""Differences of two texts, word by word: a longest common subsequence, and what is left of each text between its runs.

The subsequence is found by divide and conquer in linear space.  A row of the
table of lengths is one integer with a bit a word, so a step costs an addition
of integers, and two texts of n and m words take some n * m / 64 machine words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.functions.text import words


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of longest common subsequences of ``a`` and each beginning of ``b``, the empty one first."""
    at: dict[object, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full  # bit j is 0 where the length grows by one at b[j]
    for x in a:
        met = row & at.get(x, 0)
        row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, ascending."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.append((n, m))
        if i == n or j == m:
            continue
        if n - i == 1:
            hit = next((k for k in range(j, m) if b[k] == a[i]), None)
            found += [] if hit is None else [(i, hit)]
            continue
        half = (i + n) // 2
        cut = int(np.argmax(_lengths(a[i:half], b[j:m]) + _lengths(a[half:n][::-1], b[j:m][::-1])[::-1]))
        todo += [(i, half, j, j + cut), (half, n, j + cut, m)]
    return sorted(found)


def edits(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """(op, i, n, j, m) in order: a[i:n] becomes b[j:m]; op is replace, delete or insert."""
    out, i, j = [], 0, 0
    for x, y in [*common(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append(("replace" if x > i and y > j else "delete" if x > i else "insert", i, x, j, y))
        i, j = x + 1, y + 1
    return out


def differences(pairs: DataFrame, key: str, ours: str, theirs: str) -> DataFrame:
    """Rows (key, op, our_start, our_stop, their_start, their_stop, removed, added), one a difference of a pair.

    Places count words from 0, and stops are the first word after.  Words are
    lower-case runs of letters and digits.  A null text has no words.  Equal texts have no
    rows; keys may repeat or be null, but replaying needs them unique.  A pair is
    compared by one task; its time grows with the product of the words that lie
    between the texts' equal beginnings and ends, so pairs that a frequent key
    has joined should be dealt evenly before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if a != b and (found := edits(a, b)):
                    ops, *places = zip(*found, strict=True)
                    texts = [pa.array([side[p:q] for p, q in zip(places[k], places[k + 1], strict=True)], pa.list_(pa.string())) for k, side in ((0, a), (2, b))]
                    keys = batch.column("key").take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(ops), *(pa.array(p, pa.int32()) for p in places), *texts], names)

    of = lambda c: F.coalesce(words(F.col(c)), F.array().cast("array<string>"))
    unlike = pairs.select(F.col(key).alias("key"), F.col(ours).alias("a"), F.col(theirs).alias("b")).filter("not a <=> b")
    rows = unlike.select("key", of("a").alias("a"), of("b").alias("b"))
    fields = StructType.fromDDL("op string, our_start int, our_stop int, their_start int, their_stop int, removed array<string>, added array<string>").fields
    names = ["key", *(f.name for f in fields)]
    return rows.mapInArrow(run, StructType([StructField("key", rows.schema["key"].dataType), *fields])).withColumnRenamed("key", key)


def replay(pairs: DataFrame, found: DataFrame, key: str, ours: str) -> DataFrame:
    """Rows (key, words) of the other text, made of the words of ``ours`` and the differences."""
    steps = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("our_start", "our_stop", "added"))).alias("steps"))  # of one pair
    both = pairs.select(key, words(F.coalesce(F.col(ours), F.lit(""))).alias("own")).join(steps, key, "left")

    def further(acc, x):
        kept = F.slice("own", acc["at"] + 1, x["our_start"] - acc["at"])
        return F.struct(x["our_stop"].alias("at"), F.concat(acc["out"], F.array(kept, x["added"])).alias("out"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("out"))
    rest = lambda acc: F.flatten(F.concat(acc["out"], F.array(F.slice("own", acc["at"] + 1, F.size("own")))))
    return both.select(key, F.coalesce(F.aggregate("steps", nothing, further, rest), F.col("own")).alias("words"))


def ratios(pairs: DataFrame, found: DataFrame, key: str, ours: str, theirs: str) -> DataFrame:
    """Rows (key, ratio): twice the words in common over all words of the pair; 1 for two texts without words."""
    gone = found.groupBy(key).agg(F.sum(F.size("removed") + F.size("added")).alias("gone"))
    size = lambda c: F.size(words(F.coalesce(F.col(c), F.lit(""))))
    every = size(ours) + size(theirs)
    both = pairs.select(key, every.alias("every")).join(gone, key, "left")
    return both.select(key, F.coalesce(1 - F.coalesce("gone", F.lit(0)) / F.nullif("every", F.lit(0)), F.lit(1.0)).alias("ratio"))
