from __future__ import annotations

import math
import random
from collections import Counter

import brute
from conftest import sentence, table_of
from pyspark.sql import functions as F

from tessera.llm import quality


def edges(value):
    """(bin, lower edge, upper edge) of a value."""
    if value == 0:
        return -math.inf, 0.0, 0.0
    b = math.ceil(math.log(value) / math.log(quality.BIN))
    return b, quality.BIN ** (b - 1), quality.BIN**b


def expected(rows, fences=3.0, prior=50.0):
    """The rules with weighted quantiles of single documents, each document of a group, its language and all with its weight."""
    counted = [(i, brute.quality(t), len([x for x in (t or "").split("\n") if brute.words(x)]), lang, source) for i, t, lang, source in rows]

    def metrics(c, lines):
        share = lambda a, b: a / b if b else None
        return share(c[2], c[1]), share(c[3], lines), share(c[4], c[0]), share(c[1], c[0])

    measured = [(lang, source, metrics(c, lines)) for _, c, lines, lang, source in counted]

    def bounds(lang, source, j):
        levels = [[m[j] for a, b, m in measured if m[j] is not None and fits(a, b)] for fits in (lambda a, b: (a, b) == (lang, source), lambda a, b: a == lang, lambda a, b: True)]
        weighted: list[tuple[float, float]] = []
        for values in reversed(levels):
            total = sum(w for _, w in weighted)
            weighted = [(v, w * prior / total) for v, w in weighted] + [(v, 1.0) for v in values]
        if not weighted:
            return None
        weighted.sort()
        total = sum(w for _, w in weighted)

        def at(q):
            done = 0.0
            for v, w in weighted:
                done += w
                if done >= q * total * (1 - 1e-9):
                    return edges(v)
            return edges(weighted[-1][0])

        q10, q25, q50, q75, q90 = (at(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9))
        spread = lambda a, b: b[2] - a[1] if a[0] != b[0] else 0.0
        mean = lambda far: sum(w * max(far(edges(v)[2]), 0.0) for v, w in weighted) / total
        below, above = mean(lambda v: q25[1] - v), mean(lambda v: v - q75[2])
        return q25[1] - fences * max(spread(q25, q75), spread(q10, q50), below), q75[2] + fences * max(spread(q25, q75), spread(q50, q90), above)

    known = {(a, b): [bounds(a, b, j) for j in range(4)] for a, b, _ in measured}
    out = []
    for i, c, lines, lang, source in counted:
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        spared = (c[2] <= 2, c[3] <= 1, c[4] <= 6, False)
        fine = all(v is None or f[0] - 1e-9 <= v and (few or v <= f[1] * (1 + 1e-8)) for v, f, few in zip(metrics(c, lines), known[lang, source], spared, strict=True))
        out.append((i, *c, failed, not failed and fine))
    return Counter(out)


def check(df, rows):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert Counter(map(tuple, quality.judge(df).select(*names).collect())) == expected(rows)


def test_documents_equal_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    check(docs, [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()])


def test_odd_rows(odd, odd_rows, nothing):
    check(odd, odd_rows)
    assert quality.judge(nothing).collect() == []


def test_groups_have_thresholds_of_their_own(spark):
    """What is usual in one source is an outlier in another."""
    rng = random.Random(2)
    plain = [(i, sentence(rng, 80), "en", "prose") for i in range(300)]
    code = [(1000 + i, " ".join(f"{w} #" if j % 4 == 0 else w for j, w in enumerate(sentence(rng, 80).split())), "en", "code") for i in range(300)]
    odd = (5000, code[0][1], "en", "prose")
    got = {r.doc_id: r.kept for r in quality.judge(table_of(spark, [*plain, *code, odd])).collect()}
    assert not got[5000] and got[1000] and sum(got.values()) >= 590


def test_two_runs_agree(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    one, two = (sorted(map(str, quality.thresholds(quality.features(d)).collect())) for d in (docs.repartition(3), docs.repartition(11, "text")))
    assert one == two


def test_null_and_empty_names_are_groups_of_their_own(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, 80), None, None) for i in range(200)] + [(500 + i, " ".join(w + " #" for w in sentence(rng, 80).split()), "", "") for i in range(200)]
    rows += [(999, rows[250][1], None, None)]
    got = {r.doc_id: r.kept for r in quality.judge(table_of(spark, rows)).collect()}
    assert got[0] and got[550] and not got[999]
    check(table_of(spark, rows), rows)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1").select("doc_id")
    got = quality.judge(docs).filter("not base_failed").join(labels, "doc_id").selectExpr("avg(cast(kept as int)) as share").first()
    assert got.share >= 0.95


def test_a_single_symbol_or_repeated_line_is_no_fault(spark):
    """Clean texts with one R&D, one repeated line or one repeated phrase stay among many that have none; texts full of them go."""
    rng = random.Random(6)
    rows = [(i, sentence(rng, 400), "en", f"s{i % 3}") for i in range(600)]
    words = lambda: sentence(rng, 400).split()
    rows += [(1000 + i, " ".join(["R&D", *words()]), "en", "s0") for i in range(40)]
    for i in range(40):
        w = words()
        rows.append((2000 + i, "\n".join([*(" ".join(w[k : k + 20]) for k in range(0, 400, 20)), " ".join(w[:20])]), "en", "s1"))
        rows.append((3000 + i, " ".join([*w, "and", *w[:3]]), "en", "s2"))
    for i in range(5):
        line = sentence(rng, 10)
        rows.append((8000 + i, " ".join(w + " &&&" for w in words()), "en", "s0"))
        rows.append((9000 + i, "\n".join([line] * 12 + [sentence(rng, 10) for _ in range(20)]), "en", "s1"))
    got = {r.doc_id: (r.kept, r.failed) for r in quality.judge(table_of(spark, rows)).collect()}
    assert all(got[k + i][0] for k in (1000, 2000, 3000) for i in range(40)) and all(got[i][0] for i in range(600))
    assert not any(got[k + i][0] for k in (8000, 9000) for i in range(5))


def test_no_threshold_is_0_where_a_tenth_of_the_texts_has_more(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    feats = quality.features(docs)
    shares = quality.with_metrics(feats).groupBy("lang", "source").agg(*(F.avg((F.col(m) > 0).cast("int")).alias(m) for m in quality.SPARED))
    known = {(r.lang, r.source): r for r in quality.thresholds(feats).collect()}
    for row in shares.collect():
        high = known[f"={row.lang}", f"={row.source}"]
        assert all(high[f"{m}_high"] > 0 for m in quality.SPARED if row[m] >= 0.1)
    kept = quality.judge(docs).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r.quality: r.share for r in kept.collect()}
    assert share[1] > 0.9 and share[0] < 0.1
