"""Copied columns: the table form, and a stream of changes with repeated batches."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import copies
from tessera.streaming import copies as sync

SCHEMA = "judgment long, chunk long, court string, day string"
CHANGES = "judgment long, seq long, court string, day string"


def test_last_change_reaches_the_children_of_its_parent_alone(spark):
    rows = spark.createDataFrame([(1, 1, "A", "x"), (1, 2, "A", "x"), (2, 1, "B", "y"), (None, 1, "N", "z")], SCHEMA)
    changes = spark.createDataFrame([(1, 1, "Q", "q"), (1, 2, None, "r"), (1, 2, None, "p"), (3, 1, "Z", "z"), (None, 1, "Z", "z")], CHANGES)
    got = copies.updated(rows, changes, "judgment", "seq", ["court", "day"])
    assert got.columns == rows.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 1, None, "r"), (1, 2, None, "r"), (2, 1, "B", "y"), (None, 1, "N", "z")], key=repr)
    assert copies.updated(rows, changes.limit(0), "judgment", "seq", ["court", "day"]).count() == 4


def test_missing_values_are_made_in_bounded_batches(spark, tmp_path):
    rows = [(i, None if i % 11 == 0 else f"text {i}", None if i % 2 else [float(i)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, text string, vector array<double>").coalesce(2)
    log = str(tmp_path)

    def make(texts):
        with open(f"{log}/{texts.index[0]}-{texts.iloc[0].split()[1]}", "w") as out:
            out.write(str(len(texts)))
        return [[float(len(t)), 0.5] for t in texts]

    got = {r.id: r.vector for r in copies.filled(df, "text", "vector", make, 16).collect()}
    assert got == {i: [float(len(t)), 0.5] if v is None and t is not None else v for i, t, v in rows}
    sizes = [int(f.read_text()) for f in Path(log).iterdir()]
    assert max(sizes) <= 16 and sum(sizes) == sum(v is None and t is not None for _, t, v in rows)
    assert copies.filled(df.limit(0), "text", "vector", make).count() == 0


def test_changes_are_propagated_once(spark, tmp_path):
    """A changed judgment reaches its passages alone, other buckets aren't written, and a batch that comes again changes nothing."""
    path, inbox = str(tmp_path / "table"), tmp_path / "in"
    rows = [(j, c, f"court {j}", "2000-01-01") for j in range(40) for c in range(5)]
    sync.create(spark.createDataFrame(rows, SCHEMA), path, "judgment", 8)
    batches = [[(3, 1, "High", "2001-01-01"), (3, 2, "Supreme", "2001-01-02"), (77, 1, "none", "2001-01-01")], [(5, 3, None, "2002-02-02"), (3, 3, "Supreme", "2003-03-03")]]
    expected = {(j, c): (court, day) for j, c, court, day in rows}
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.parquet(str(inbox / f"part={k}"))
        source = spark.readStream.schema(CHANGES + ", part int").option("maxFilesPerTrigger", 1).parquet(str(inbox)).drop("part")
        query = sync.propagate(source, path, SCHEMA, str(tmp_path / "checkpoint"), "judgment", "seq", ["court", "day"], 8)
        query.awaitTermination(120)
        assert query.exception() is None
        for j, _, court, day in batch:
            expected |= {(j, c): (court, day) for c in range(5) if (j, c) in expected}
    read = lambda: {(r.judgment, r.chunk): (r.court, r.day) for r in sync.current(spark, path, SCHEMA).collect()}
    assert read() == expected and sync.current(spark, path, SCHEMA).count() == len(rows)
    versions = {p.parent.name: [] for p in Path(path).glob("rows/bucket=*/version=*")}
    for p in Path(path).glob("rows/bucket=*/version=*"):
        versions[p.parent.name].append(p.name)
    assert len(versions) == 8 and sum(map(len, versions.values())) <= 8 + 2 + 2
    again = spark.createDataFrame(batches[1], CHANGES)
    sync.apply(spark, path, SCHEMA, again, 1, "judgment", "seq", ["court", "day"], 8)
    assert read() == expected
    plan = sync.current(spark, path, SCHEMA, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert sync.apply(spark, path, SCHEMA, again.filter(F.lit(False)), 9, "judgment", "seq", ["court", "day"], 8) == []
