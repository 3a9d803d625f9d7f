"""Search against plain Python and SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import sentence, table_of
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from tessera.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """Rows (item id, rank, doc id, score), each row of docs and items by itself."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(docs, items, **options):
    return sorted((tuple(r) for r in lexical.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 3) for i, t in rows], "item_id long, text string, doc_id int, rank string, score long")


ITEMS = [(1, "River3 stone4 the old Winter1 river3"), (2, None), (3, ""), (4, "!!! --"), (5, "中文 İSTANBUL straße x"), (5, "word"), (6, "word"), (6, "word"), (None, "12345 two WORDS"), (7, "nowhere absent")]


def test_odd_rows(spark, odd, odd_rows):
    """Nulls, empty and long texts, repeated ids and rows on both sides, ties, clashing names, terms that no document has."""
    expected = brute([(i, t) for i, t, *_ in odd_rows], ITEMS)
    assert got(odd, items_of(spark, ITEMS)) == expected and len({r[0] for r in expected}) == 4


def test_empty_tables(spark, odd, nothing):
    some = items_of(spark, ITEMS)
    assert got(nothing, some) == [] == got(odd, some.limit(0)) == got(table_of(spark, [(1, "..", None, None)]), some)
    assert lexical.search(nothing, some).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("k", [1, 3])
def test_ties_go_by_id_over_many_tasks(spark, k):
    """Equal scores in all tasks, more of them than are kept; small blocks and parts change nothing."""
    rows = [(i, "same text here" if i % 3 else f"other words {i % 5}", "en", "s") for i in range(400)]
    random.Random(2).shuffle(rows)
    items = [(1, "same here"), (2, "words 1 2"), (3, "other text")]
    assert got(table_of(spark, rows).repartition(7), items_of(spark, items), k=k) == brute([r[:2] for r in rows], items, k)


def test_blocks_and_parts_change_nothing(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 5)
    assert got(odd, items_of(spark, ITEMS)) == brute([(i, t) for i, t, *_ in odd_rows], ITEMS)


def test_parts_of_few_pairs():
    """Accumulation in parts of a few triples gives what one part gives."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    counts = rng.integers(0, 6, 300)
    flat = np.concatenate([np.sort(rng.choice(20, c, replace=False)) for c in counts])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(300)), pa.array(counts + 3), *(lexical.list_array(x, np.append(0, np.cumsum(counts)), t) for x, t in ((flat, pa.int32()), (flat % 3 + 1, pa.int64())))], ["doc_id", "n", "terms", "tfs"]
    )
    starts = np.arange(0, 101, 5)
    index = type("Held", (), {"value": (starts, np.tile(np.arange(5), 20), rng.integers(1, 9, 100))})
    whole, found = [next(lexical._accumulate(index, 300, 2000, 4)(iter([b]))) for b in (batch,)], []
    lexical.PAIRS, held = 7, lexical.PAIRS
    try:
        found = [next(lexical._accumulate(index, 300, 2000, 4)(iter([batch.slice(0, 100), batch.slice(100)])))]
    finally:
        lexical.PAIRS = held
    rows = lambda b: sorted(map(tuple, zip(*(c.to_pylist() for c in b[0].columns), strict=True)))
    assert rows(found) == rows(whole) and len(rows(whole)) == 20


@settings(deadline=None)
@given(arrays(np.int64, st.integers(0, 300), elements=st.integers(0, 1 << 50)))
def test_radix_order(keys):
    assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()


def test_lengths_beyond_64_bits():
    n = np.array([0, 1, 10**9])
    assert lexical.lengths(n, 10**11, 10**13).tolist() == [25 + 75 * int(x) * 10**11 // 10**13 for x in n]


def test_documents_equal_the_sql(spark, medium):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{medium}/{name}.parquet'")
    docs, items = (spark.read.parquet(f"{medium}/{name}.parquet") for name in ("documents", "benchmark"))
    expected = sorted(con.sql(f"select item_id, rank, doc_id, score from ({lexical.oracle_sql()})").fetchall(), key=repr)
    found = got(docs, items)
    assert found == expected and len(found) == 400


def test_mixed_sentences(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randrange(1, 60)), "en", "s") for i in range(300)]
    items = [(i, sentence(rng, 12)) for i in range(15)]
    assert got(table_of(spark, rows).repartition(3), items_of(spark, items)) == brute([r[:2] for r in rows], items)
