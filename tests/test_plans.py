"""What the optimizer has to do for the queries: prune columns, push filters, shuffle little, never multiply tables."""

from __future__ import annotations

import pytest

from tessera import catalog
from tessera.plans import checks


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_query_multiplies_tables(spark, small, name):
    assert not checks.has_cartesian(catalog.QUERIES[name](spark, small))


@pytest.mark.parametrize(
    "name, columns, most_shuffles",
    [
        ("event_mix", {"ts", "event_type", "value"}, 2),
        ("latest_state", {"event_id", "ts", "user_id", "event_type"}, 1),
        ("ledger_totals", {"user_id", "event_type", "value"}, 1),
        ("corpus_breakdown", {"doc_id", "lang", "source", "n_chars", "vec_id", "toxic"}, 6),
        ("rollup_extra", {"l_quantity", "l_returnflag", "l_linestatus"}, 1),
    ],
)
def test_scans_and_shuffles(spark, small, name, columns, most_shuffles):
    df = catalog.QUERIES[name](spark, small)
    assert set(checks.scanned_columns(df)) <= columns
    assert checks.exchanges(df) <= most_shuffles


def test_filters_reach_the_scan(spark, small):
    assert "lang" in checks.pushed_filters(catalog.QUERIES["hybrid_passages"](spark, small))
