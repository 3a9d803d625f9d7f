"""Every registered query with SQL against an independent engine, and the rest for a stable result."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from tessera import catalog


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def engine(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


#: Columns that a query is about have several values each.
ABOUT = {
    "answer_reports": ("removed", "flagged", "verified", "triggered", "reason"),
    "delayed_jobs": ("dedupe",),
    "multi_strategy_lookup": ("asked", "strategy"),
    "other_laws": ("acts",),
    "plan_listing": ("archived", "o_orderpriority"),
    "questions_on_subject": ("way", "place"),
    "recodified": ("new_act", "whole"),
    "recodified_numbers": ("act", "section"),
    "release_points": ("released",),
    "routed_sessions": ("before", "after", "action", "argument", "charge"),
    "sections_shown": ("act",),
    "shared_tags": ("tags",),
    "two_meanings": ("now", "title"),
}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, medium, name):
    assert name in catalog.QUERIES
    got = catalog.QUERIES[name](spark, medium)
    said = engine(medium).sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(said.columns)
    rows = got.collect()
    assert rows and rows_of(got.columns, [tuple(r) for r in rows]) == rows_of(said.columns, said.fetchall())
    for column in ABOUT.get(name, ()):
        assert len({r[column] for r in rows}) > 1, column


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, small, name):
    found = catalog.QUERIES[name](spark, small)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_the_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
