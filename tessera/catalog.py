"""All registered queries of the library proper, with their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.queries import answers, changes, corpus, events, guard, lookup, reporting, retrieval, search, sessions, subjects, text

_MODULES = (retrieval, search, lookup, reporting, events, changes, text, corpus, answers, guard, subjects, sessions)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: sql for m in _MODULES for k, sql in m.ORACLES.items()}
