"""Proofs against hashlib, and against SQL on the documents."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
from conftest import table_of
from pyspark.sql import functions as F

from tessera.llm import manifest

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree_of(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i - i % 8
        out.append((nodes[a:i], nodes[i + 1 : a + 8]))
        i //= 8
    return out


def brute(rows):
    """rows (doc_id, text, lang, source, n_chars); the contract in plain Python."""
    groups = {}
    for i, text, lang, source, n in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        entry = (leaf_of((i, source, lang, n, text)), leaf_of((i, source, lang, n, lower(text) if hit else text)))
        groups.setdefault(lang, []).append(((i is not None, i or 0), *entry, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([e[1] for e in sorted(groups[g])]) for g in names}
    top = tree_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for j, (_, leaf, seen, i) in enumerate(sorted(groups[g])):
            steps = way(trees[g], j) + way(top, k)
            for left, right in steps:
                seen = sha(*left, seen, *right)
            proof = sha(*("".join(left + right) for left, right in steps))
            out.append((i, leaf, trees[g][-1][0], top[-1][0], proof, seen, seen == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in manifest.prove(df).select(COLUMNS).collect()), key=repr)


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_odd_rows(odd):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing names."""
    assert got(odd) == brute(plain(odd))


def test_empty_table_and_one_row(spark, nothing):
    assert got(nothing) == [] and manifest.prove(nothing).columns == COLUMNS
    (row,) = got(table_of(spark, [(1, "Only", "en", "a")]))
    assert row[1] == row[2] == row[3] and row[4] == sha() and row[6]


def test_trees_of_all_shapes(spark):
    """Runs of one, full and nearly full levels, trees of one to five levels, and several blocks."""
    rng, sizes = random.Random(1), (1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 4097)
    rows = [(1000 * k + i, f"Text {i} {rng.random()}", f"l{k}", None) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    df = table_of(spark, rows).repartition(5)
    assert got(df) == brute(plain(df))


def test_many_groups(spark):
    """A tree over 700 groups has blocks of its own; null, empty and non-ASCII names are in the order of their bytes."""
    names = [None, "", "-", "=", "é", "\U0001f600", "中", *(f"g{k}" for k in range(693))]
    rows = [(i, f"Text {i}", names[i % 700], "s") for i in range(1500)]
    df = table_of(spark, rows)
    assert got(df) == brute(plain(df))


def test_equal_rows_are_spread_and_each_has_a_proof(spark):
    """A third of all rows being one repeated row doesn't put them in one partition."""
    rows = [(5, "Same", "en", "a")] * 3000 + [(i, f"T{i}", "de", "a") for i in range(6000)]
    df = table_of(spark, rows).repartition(8)
    read = manifest.leaves(df)
    placed = manifest.numbered(read, "grp", ["doc_id", "leaf", "row"])
    assert sorted(r.idx for r in placed.filter("grp = '=en'").collect()) == list(range(3000))
    held = [r["count"] for r in read.repartitionByRange(8, "grp", "doc_id", "leaf", "row").groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) < 3000
    assert got(df) == brute(plain(df))


def test_salted_nodes_change_nothing(spark, monkeypatch):
    """With a salt on every level and group the join finds the same siblings."""
    df = table_of(spark, [(i, f"T{i}", "en", "a") for i in range(5000)])
    expected = got(df)
    monkeypatch.setattr(manifest, "_salts", lambda level: f"shiftleft(1L, {level})")
    assert got(df) == expected


def test_tampering_is_a_parameter(spark):
    df = table_of(spark, [(i, f"t{i}", "en", "a") for i in range(20)])
    touched = manifest.prove(df, tampering=lambda c: c | {"n_chars": F.when(F.col("doc_id") == 3, -1).otherwise(c["n_chars"])})
    assert [r.doc_id for r in touched.filter("not verified").collect()] == [3]
    assert manifest.prove(df, tampering=lambda c: c).filter("verified").count() == 20


def by_sql(con):
    return sorted(con.sql(f"select {', '.join(COLUMNS)} from ({manifest.oracle_sql()})").fetchall(), key=repr)


def test_documents_equal_the_sql(spark, medium):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{medium}/documents.parquet'")
    df = spark.read.parquet(f"{medium}/documents.parquet")
    found = got(df)
    assert found == by_sql(con) == brute(plain(df))
    verified = sum(r[6] for r in found)
    assert 0 < verified < len(found)


def test_the_sql_with_nulls_and_many_groups(odd, spark):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", plain(odd) + [(i, f"Text {i}", f"g{i % 20}", None, None) for i in range(100)])
    rows = con.sql("select doc_id, text, lang, source, n_chars from documents").fetchall()
    assert by_sql(con) == brute(rows)
