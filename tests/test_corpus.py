"""Sections and the acts that have them."""

from __future__ import annotations

from tessera.operators import corpus
from tessera.queries import corpus as queries


def test_other_laws_has_every_act_of_every_section(spark, medium):
    every = queries._sections(spark, medium).distinct().collect()
    expected = {}
    for r in every:
        expected.setdefault(r.section, set()).add(r.act)
    got = {r.section: r.acts for r in queries.other_laws(spark, medium).collect()}
    assert got == {s: "; ".join(sorted(acts)) for s, acts in expected.items()}


def test_listed_acts_are_left_out(spark):
    rows = spark.createDataFrame([("A", "1"), ("B", "1"), ("B", "1"), ("C", "1"), ("A", "2"), (None, "3")], "act string, section string")
    got = {r.section: r.acts for r in corpus.laws_with_section(rows, ["A"]).collect()}
    assert got == {"1": ["B", "C"]}
