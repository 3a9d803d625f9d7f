from __future__ import annotations

import random
from collections import Counter

import brute
from conftest import sentence, table_of
from pyspark.sql import functions as F

from tessera.llm import decontam
from tessera.llm.shared import materialise

ITEMS = "item_id long, text string, ys int, m string"


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "m") for i, t in rows], ITEMS)


def pairs(df):
    return {(r.doc_id, r.item_id): r.similarity for r in df.collect()}


def equal(got, expected):
    return set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_documents_equal_brute_force(spark, small, document_rows, documents):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    near, every = brute.leaks(document_rows, items, decontam.SIMILARITY_PERCENT, decontam.RADIUS)
    got = pairs(decontam.find_leaks(documents, bench))
    assert equal(got, near) and set(near) == set(every)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind != 0)] = [] if kind == 1 else [f"edit{rng.randrange(99)}"]
    return " ".join(out)


def test_edited_passages_inside_long_texts(spark):
    rng = random.Random(11)
    items = [(i, sentence(rng, rng.randrange(5, 60))) for i in range(40)]
    rows = []
    for n in range(160):
        item = rng.choice(items)[1].split()
        body = edited(rng, item, rng.randrange(3)) if n % 4 else sentence(rng, 30)
        rows.append((n, f"{sentence(rng, rng.randrange(40))} {body} {sentence(rng, rng.randrange(40))}", None, None))
    near, every = brute.leaks([r[:2] for r in rows], items, decontam.SIMILARITY_PERCENT, decontam.RADIUS)
    got = pairs(decontam.find_leaks(table_of(spark, rows).repartition(3), items_of(spark, items)))
    assert len(every) >= 60 and equal(got, near) and len(near) >= 0.98 * len(every)


def test_every_way_of_joining_agrees(spark, monkeypatch, documents, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    one = pairs(decontam.find_leaks(documents, bench))
    kept = Counter(r.doc_id for r in decontam.without_leaks(documents, bench).collect())
    monkeypatch.setattr(decontam, "BROADCAST_ANCHORS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_LEAKS", -1)
    assert pairs(decontam.find_leaks(documents, bench)) == one
    assert Counter(r.doc_id for r in decontam.without_leaks(documents, bench).collect()) == kept


def test_odd_rows(spark, odd, odd_rows, nothing):
    long = next(t for i, t, *_ in odd_rows if i == 10).split()
    items = [(1, " ".join(long[30_000:30_050])), (2, None), (3, ""), (4, "too few words"), (None, next(t for i, t, *_ in odd_rows if i == 6)), (1, " ".join(long[30_000:30_050]))]
    bench = items_of(spark, items)
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(odd, bench).collect()}
    assert got == {(10, 1), *((d, None) for d in (6, 7, 8, 9, None))}
    kept = decontam.without_leaks(odd, bench)
    assert kept.columns == odd.columns
    clean = [i for i, *_ in odd_rows if i not in (6, 7, 8, 9, 10, None)] + [None]  # of the rows with a null id only the one with a leak goes
    assert Counter(r.doc_id for r in kept.collect()) == Counter(clean)
    assert decontam.find_leaks(nothing, bench).collect() == [] and decontam.find_leaks(odd, bench.limit(0)).collect() == []
    assert decontam.without_leaks(odd, bench.limit(0)).count() == len(odd_rows)


def test_repeated_and_null_item_ids(spark):
    rng = random.Random(3)
    texts = [sentence(rng, 54) for _ in range(40)]
    items = [(7, texts[0])] * 13 + [(8, t) for t in texts[1:10]] + [(None, t) for t in texts[10:]]
    change = lambda t, at: " ".join("edit" if i == at else w for i, w in enumerate(t.split()))
    rows = [(n, f"{sentence(rng, 20)} {t if n % 2 else change(t, 12)} {sentence(rng, 20)}", None, None) for n, t in enumerate(texts)]
    rows += [(100 + n, f"{sentence(rng, 20)} {change(texts[0], at)} {sentence(rng, 20)}", None, None) for n, at in enumerate(range(4, 50, 3))]
    near, every = brute.leaks([r[:2] for r in rows], items, decontam.SIMILARITY_PERCENT, decontam.RADIUS)
    got = decontam.find_leaks(table_of(spark, rows), items_of(spark, items))
    once = {(r.doc_id, r.item_id): r.n_windows for r in decontam.find_leaks(table_of(spark, rows), items_of(spark, sorted(set(items), key=str))).collect()}
    assert {d for d, _ in every} == {r[0] for r in rows} and equal(pairs(got), near) and set(near) == set(every) and {(r.doc_id, r.item_id): r.n_windows for r in got.collect()} == once


def test_insertions_move_anchors_within_the_window(spark, monkeypatch):
    rng = random.Random(17)
    items = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(54))) for i in range(30)]
    rows = []
    for n in range(90):
        w = items[n % 30][1].split()
        body = w[:2] + ["in"] + w[2:45] + ["put", "there"] + w[45:] if n < 30 else edited(rng, w, 1 + n % 3).split()
        rows.append((n, " ".join([sentence(rng, n % 3 * 9), *body, sentence(rng, n % 4 * 9)]), None, None))
    near, every = brute.leaks([r[:2] for r in rows], items, decontam.SIMILARITY_PERCENT, decontam.RADIUS)
    for most in (decontam.BROADCAST_ANCHORS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_ANCHORS", most)
        got = pairs(decontam.find_leaks(table_of(spark, rows), items_of(spark, items)))
        assert equal(got, near)
    assert {d for d, _ in every} >= set(range(30)) and len(near) >= 0.97 * len(every)


def test_fingerprints(spark):
    rng = random.Random(8)
    arrays = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 50, 127, 128, 129, 400)] + [[-1] * 127, [(1 << 63) - 1] * 127, [-1] * 300]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, xs array<long>").withColumn("fp", decontam.simhash("xs"))
    assert {r.i: r.fp & (1 << 64) - 1 for r in df.collect()} == {i: brute.simhash(a) for i, a in enumerate(arrays)}


def as_struct(fp):
    return brute.signed(fp & (1 << 64) - 1), brute.signed(fp >> 64)


def fingerprints(rng, n, far):
    """Items' fingerprints, and windows' at known distances up to ``far`` from one of them."""
    items = [(i, rng.getrandbits(128)) for i in range(n)]
    windows = []
    for w in range(120):
        fp = items[w][1]
        for b in rng.sample(range(128), w % (far + 1)):
            fp ^= 1 << b
        windows.append((w, fp))
    return windows, items


def test_blocks_find_all_within_the_radius_and_few_others(spark):
    """5,000 items of one length: every fingerprint within the radius of a window's is met, by a tenth of all pairs; without a block some aren't."""
    windows, items = fingerprints(random.Random(2), 5_000, 36)
    left = spark.createDataFrame([(w, 50, as_struct(f)) for w, f in windows], "w long, m int, fp struct<lo: long, hi: long>")
    right = spark.createDataFrame([(n, 50, as_struct(f)) for n, f in items], "item long, m int, ifp struct<lo: long, hi: long>")
    near = {(w, i) for w, a in windows for i, b in items if (a ^ b).bit_count() <= decontam.RADIUS}
    got = {(r.w, r.item) for r in decontam.near_texts(left, right).collect()}
    assert got == near and len(near) >= 100
    fewer = [{(r.w, r.item) for r in decontam.near_texts(left, right, blocks=range(a, b)).collect()} for a, b in ((0, 3), (0, 1))]
    assert near > fewer[0] > fewer[1]
    met = left.select("w", F.explode(decontam.block_values("fp")).alias("b")).join(right.select("item", F.explode(decontam.block_values("ifp", 3)).alias("b")), "b")
    assert met.select("w", "item").distinct().count() < 0.1 * len(windows) * len(items)


def test_listed_items_do_not_pass_the_driver(spark):
    """200 stored items are a small file, but over a million rows of block values: more than may be broadcast here."""
    windows, items = fingerprints(random.Random(3), 200, 36)
    near = {(w, i) for w, a in windows for i, b in items if (a ^ b).bit_count() <= decontam.RADIUS}
    rows = [(w, 50, as_struct(f)) for w, f in windows] + [(w + 1000, 50, as_struct(f)) for w, f in windows]  # each fingerprint twice
    left = spark.createDataFrame(rows, "w long, m int, fp struct<lo: long, hi: long>")
    right = materialise(spark.createDataFrame([(n, 50, as_struct(f)) for n, f in items], "item long, m int, ifp struct<lo: long, hi: long>"), "items")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "100m")
    try:
        got = sorted((r.w, r.item) for r in decontam.near_texts(left, right).collect())
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == sorted(near | {(w + 1000, i) for w, i in near})


def test_recall_of_fingerprints_over_all_windows_of_edited_passages():
    """Of all windows whose similarity is just enough, at least 0.95 lie within the radius; of those above 0.8, 0.995; of unlike ones none."""
    rng = random.Random(5)
    just, more = [], []
    for _ in range(1200):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(30, 70))]
        ys, xs = (brute.shingle_hashes(t) for t in (" ".join(words), edited(rng, words, rng.randrange(1, 3))))
        c = sum((Counter(xs) & Counter(ys)).values())
        similarity = c / (len(xs) + len(ys) - c)
        if similarity >= 0.75:
            (just if similarity < 0.8 else more).append((brute.fingerprint(xs) ^ brute.fingerprint(ys)).bit_count())
    within = lambda d: sum(x <= decontam.RADIUS for x in d) / len(d)
    assert len(just) > 100 and len(more) > 100 and within(just) >= 0.95 and within(more) >= 0.995
    unlike = [(brute.fingerprint([rng.getrandbits(63) for _ in range(40)]) ^ brute.fingerprint([rng.getrandbits(63) for _ in range(40)])).bit_count() for _ in range(300)]
    assert within(unlike) == 0
