from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import sentence, table_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import ngram_join, partenum
from tessera.llm.arrowkit import annotate, list_array
from tessera.llm.components import connected_components


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_documents_equal_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = brute.components(rows)
    assert result(ngram_join.jaccard_components(docs)) == expected
    assert len({c for _, c in expected.values()}) < len(rows)


@pytest.mark.parametrize("split", [ngram_join.SPLIT, 12])
def test_large_groups_equal_brute_force(spark, monkeypatch, split):
    """Copies, near copies in one bucket, chains of links, and texts that share a frequent passage only; buckets cut or not."""
    monkeypatch.setattr(ngram_join, "SPLIT", split)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    base, passage = [word() for _ in range(70)], [word() for _ in range(25)]
    texts = [" ".join(base)] * 150
    for _ in range(250):
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(70)] = word()
        texts.append(" ".join(own))
    chain = [word() for _ in range(90)]
    for i in range(25):
        chain[3 * i] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(passage + [word() for _ in range(40)]) for _ in range(150)]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    assert result(ngram_join.jaccard_components(table_of(spark, [(*r, None, None) for r in rows]).repartition(5))) == brute.components(rows)


def all_rows(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_odd_rows(odd, odd_rows, nothing):
    assert all_rows(ngram_join.jaccard_components(odd)) == Counter(brute.component_rows([r[:2] for r in odd_rows]))
    assert ngram_join.jaccard_components(nothing).collect() == []
    assert ngram_join.one_of_each(nothing).collect() == []


def repeated_ids():
    """Ids that repeat with other texts, and several null ids, each text with a near copy under another id."""
    rng = random.Random(9)
    rows = []
    for n in range(120):
        text = sentence(rng, 60)
        rows += [(None if n % 6 == 0 else n % 40, text), (1000 + n % 7 if n % 3 else None, text + " end")]
    return rows + [(5, rows[0][1]), (5, rows[0][1]), (None, None), (None, ""), (7, ""), (7, "")]


def test_ids_that_repeat_with_other_texts_and_null_ids(spark):
    rows = repeated_ids()
    df = table_of(spark, [(*r, None, None) for r in rows]).repartition(5)
    expected = brute.component_rows(rows)
    assert all_rows(ngram_join.jaccard_components(df)) == Counter(expected)
    kept = Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(df).collect())
    wordless = Counter(r for r in rows if not brute.words(r[1]))
    assert {r: n for r, n in kept.items() if r in wordless} == wordless
    classes = {frozenset(brute.shingles(t)): None for _, t in rows if brute.words(t)}
    assert all(n == 1 for r, n in kept.items() if r not in wordless)
    singles = [brute.shingles(t) for _, t in kept if brute.words(t)]
    assert len(singles) == 120 and all(s in classes for s in singles)  # of each text and its near copy exactly one stays
    assert all(100 * len(a & b) < 75 * len(a | b) for k, a in enumerate(singles) for b in singles[:k])


def test_one_of_each_keeps_columns_and_smallest_ids(odd, odd_rows):
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    wordless = [i for i, t, *_ in odd_rows if not brute.words(t)]
    expected = {c for i, n, c in brute.component_rows([r[:2] for r in odd_rows]) if n}
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*expected, *wordless])


def test_half_of_a_signature_travels_and_loses_no_shared_one():
    texts = [" ".join(f"w{i}" for i in range(a, a + 60)) for a in (0, 3, 500)]
    sketch = type("Sketch", (), {"value": np.zeros(ngram_join.SKETCH_CELLS, np.uint32)})
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    rows = pa.Table.from_batches(ngram_join._signature_rows(sketch, 3)(iter([batch])))
    assert rows.schema.field("sigs").type.value_type == pa.int32()
    found = [ngram_join._shared(rows.filter(pc.equal(rows["part"], p))).column("node").to_pylist() for p in range(3)]
    (_, _, values, bounds), = ngram_join._sets(pa.array(texts))
    near = set(ngram_join._set_hashes(values, bounds)[:2].tolist())
    assert {n for nodes in found for n in nodes} == near


def test_a_hub_meets_its_partners_in_chunks(spark):
    """One set with many near copies that are no near copies of each other: each link is found."""
    rng = random.Random(21)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for n in range(1, 90):
        own, at = list(base), rng.randrange(0, 96)
        own[at : at + 12] = [f"x{n}_{j}" for j in range(12)]
        rows.append((n, " ".join(own)))
    got = all_rows(ngram_join.jaccard_components(table_of(spark, [(*r, None, None) for r in rows]).repartition(4)))
    assert got == Counter(brute.component_rows(rows)) and {c for _, _, c in got} == {0}


def test_a_bucket_s_pairs_leave_in_batches(monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIR_ROWS", 500)
    n = 200
    same = ngram_join.parity(np.arange(1, 40, dtype=np.uint64) << np.uint64(40))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * n), pa.array(range(n)), pa.array(range(n)), pa.array([39] * n), list_array(np.tile(same, n), np.arange(n + 1) * len(same), pa.int64()), pa.array([0] * n)],
        ["deal", "node", "comp", "n_shingles", "parity", "side"],
    )
    out = list(ngram_join._bucket_pairs(True)(iter([batch])))
    assert sum(b.num_rows for b in out) == n * (n - 1) // 2 and max(b.num_rows for b in out) < 500 + n
    forest = list(ngram_join._bucket_pairs(False)(iter([batch])))
    assert sum(b.num_rows for b in forest) == n - 1 + 1  # a star, and the deal that the last round has to see


def test_a_large_bucket_is_dealt_over_many_tasks(spark):
    """20,000 sets of one bucket and 5 of another: each pair is in exactly one deal, and no deal is larger than a task's reach."""
    rows = spark.range(20_000).selectExpr("1L as bucket", "id as node", "50L as n_shingles", "array(id) as parity")
    rows = rows.unionByName(spark.range(5).selectExpr("2L as bucket", "id as node", "50L as n_shingles", "array(id) as parity"))
    large = spark.createDataFrame([(1, 5)], "bucket long, subs long")
    within, across = ngram_join._deals(rows, large)
    own = [r["count"] for r in within.groupBy("deal").count().collect()]
    cells = {}
    for r in across.groupBy("deal", "side").count().collect():
        cells.setdefault(r.deal, {})[r.side] = r["count"]
    pairs = sum(n * (n - 1) // 2 for n in own) + sum(c[ngram_join.LEFT] * c[ngram_join.RIGHT] for c in cells.values())
    assert pairs == 20_000 * 19_999 // 2 + 10 and len(own) == 6 and len(cells) == 10
    assert max(own) < ngram_join.SPLIT and max(sum(c.values()) for c in cells.values()) < 1.1 * ngram_join.SPLIT
    tasks = across.repartition(8, "deal").groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("deal")).count()
    assert tasks > 2


def test_sides_of_a_cell():
    """Pairs of a cell are of both sides; a forest of them joins all that could be joined."""
    comp, size, sketch = np.arange(10), np.full(10, 39), np.zeros((10, 2), np.uint64)
    side = np.array([ngram_join.LEFT] * 4 + [ngram_join.RIGHT] * 6)
    pairs = lambda s, **o: {(i, int(x)) for i, j in ngram_join._near(comp, size, sketch, s, **o) for x in j}
    assert pairs(side) == {(i, j) for i in range(4) for j in range(4, 10)}
    assert len(pairs(side, forest=True)) == 9 and len(pairs(side * 0)) == 45
    assert pairs(side[:4].repeat(3)[:10]) == set() == pairs(np.full(10, ngram_join.RIGHT))


def test_rows_without_words_stay_and_copies_are_cut_before_they_move(spark):
    """100,000 wordless rows and as many copies of one text, all with null ids: the former aren't shuffled, the latter leave each task as one row."""
    rows = spark.range(200_000, numPartitions=4).selectExpr("cast(null as long) as doc_id", "if(id % 2 = 0, ' ', 'one two three four five six') as text")
    kept = ngram_join.one_of_each(rows)
    assert kept.groupBy("text").count().orderBy("text").collect() == [(" ", 100_000), ("one two three four five six", 1)]
    stay = kept._jdf.queryExecution().executedPlan().toString().rsplit("Filter", 1)[1]
    assert "Exchange" not in stay and "Range" in stay
    copies = rows.filter("text <> ' '")
    moved = annotate(copies, ngram_join._nodes("text"), ["text"], "node long, rank long", doc=F.col("doc_id"), rank=F.xxhash64("text"))
    assert moved.count() == 4
    mixed = spark.range(20_000, numPartitions=1).selectExpr("1L as doc_id", "concat('one two three four five', repeat(' ', cast(id % 1000 as int)), ' six') as text")
    assert annotate(mixed, ngram_join._nodes("text"), ["text"], "node long, rank long", doc=F.col("doc_id"), rank=F.xxhash64("text")).count() < 40


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 300), st.integers(0, 10_000), st.floats(0, 1))
def test_linked_sets_share_a_signature(size, seed, share):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, 3 * size + 8, dtype=np.uint64))
    a = pool[rng.permutation(len(pool))[:size]]
    drop = int(rng.integers(0, int(share * size * 0.25) + 1))
    extra = np.setdiff1d(pool, a)[: int(rng.integers(0, 1 + size // 4))]
    b = np.concatenate((a[drop:], extra))
    inter, first = len(np.intersect1d(a, b)), partenum.bands(1 << 40)
    sketch = rng.integers(0, 9, 1 << partenum.SKETCH_BITS).astype(np.uint32)
    if len(b) and partenum.linked(inter, len(a), len(b)):
        sigs = [set(partenum.signatures(np.sort(x), sketch, first).tolist()) for x in (a, b)]
        assert sigs[0] & sigs[1]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 200), st.integers(0, 9999))
def test_parity_never_rules_out_a_link(size, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    b = np.unique(np.concatenate((a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, int(rng.integers(0, size)), dtype=np.uint64))))
    if len(b):
        x, y = ngram_join.parity(a), ngram_join.parity(b)
        n = min(len(x), len(y))
        bits = int(np.bitwise_count((ngram_join.fold(x, n) ^ ngram_join.fold(y, n)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("edges, expected", [([], {}), ([(1, None), (3, 3)], {}), ([(i + 1, i) for i in range(40)] + [(99, 98), (98, 99)], {**dict.fromkeys(range(41), 0), 98: 98, 99: 98})])
def test_components(spark, edges, expected):
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == expected
