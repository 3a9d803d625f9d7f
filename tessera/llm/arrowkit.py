"""Small helpers for mapInArrow functions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def give_back() -> None:
    """Freed memory goes back to the system; a worker stays for later tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Large tables that a worker keeps from one task to the next, by name.
KEPT: dict[str, dict] = {}


def drop_tables(but: str | None) -> None:
    """A worker goes from one operator to another; the tables of those before go with them."""
    for name, table in KEPT.items():
        if name != but and table:
            table.clear()
            give_back()


def tidy(run: Callable, keeps: str | None = None) -> Callable:
    """``run`` for mapInArrow, without the tables that other operators keep, and giving memory back after its last batch."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables(keeps)
        yield from run(batches)
        give_back()

    return whole


def annotate(docs: DataFrame, run: Callable, reads: list[str], added: str, **needed: Column) -> DataFrame:
    """The rows of ``docs`` as ``row``, and the columns ``added`` that ``run`` finds for them.

    ``run`` gets batches of ``row``, a struct of all columns so that no names
    clash, and of ``needed``; it yields ``row`` and what it adds.  It takes
    columns of ``docs``, those in ``reads``, with :func:`field`.
    """
    if missing := set(reads) - set(docs.columns):
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    schema = StructType([StructField("row", docs.schema), *StructType.fromDDL(added).fields])
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in needed.items())).mapInArrow(tidy(run), schema)


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of the batch, or of its ``row``."""
    return batch.column(name) if name in batch.schema.names else batch.column("row").field(name)


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """values[bounds[i]:bounds[i+1]] as list i."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype())))


def list_values(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, lengths) of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        chunks = [c for c in column.chunks if len(c)]
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = [list_values(c) for c in chunks]
        return np.concatenate([v for v, _ in done]), np.concatenate([n for _, n in done])
    off = np.asarray(column.offsets)
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], np.diff(off)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups, of rows that come sorted by ``key`` (no nulls)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1], side="left"))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
