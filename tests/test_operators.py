"""Event, ledger, arrangement and source operators on small rows with nulls, ties and repeats."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import arrange, ledger, reporting
from tessera.operators import events as ev
from tessera.sources import files


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_upsert_and_insert_absent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, at long")
    assert rows(ev.upsert(old, changes, ["k"], ["at"]), "k", "v") == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(ev.insert_absent(old, changes.filter("at = 1"), ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "z")]
    assert ev.upsert(old.limit(0), changes.limit(0), ["k"], ["at"]).count() == 0


def test_erase_counts_what_it_takes(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 4)], "u long, x long")
    left, lost = ev.erase({"a": a}, spark.createDataFrame([(1,), (1,), (None,)], "owner long"), {"a": "u"})
    assert rows(left["a"], "x") == [(3,), (4,)] and rows(lost, "name", "deleted") == [("a", 2)]


def test_retry_doubles_up_to_the_cap(spark):
    state, delay = ev.retry(F.col("n"), 9)
    found = spark.range(1, 11).withColumnRenamed("id", "n").orderBy("n").select(state.alias("s"), delay.alias("d")).collect()
    assert [r.d for r in found] == [5, 10, 20, 40, 80, 160, 300, 300, None, None] and [r.s for r in found][-2:] == ["DEAD", "DEAD"]


def test_recent_turns_start_with_a_question(spark):
    turns = spark.createDataFrame([("c", i, "assistant" if i % 2 else "user", f"text {i}") for i in range(9)] + [("d", 0, "assistant", "alone")], "conv string, turn long, role string, text string")
    found = ev.recent_turns(turns, "conv", "turn", 2, 4)
    assert rows(found, "conv", "turn", "text") == [("c", 6, "text"), ("c", 7, "text"), ("c", 8, "text")]


def test_fixed_windows_start_with_the_first_hit(spark):
    hits = spark.createDataFrame([(1, i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 5, 9, 10, 12, 30])], "k long, id long, t string").withColumn("ts", F.to_timestamp("t"))
    found = ev.fixed_windows(hits, "k", "ts", ["id"], 10, 2)
    assert [(r.window, r.allowed) for r in found.orderBy("id").collect()] == [(1, True), (1, True), (1, False), (2, True), (2, True), (3, True)]


def test_spend_fold_takes_free_credits_first(spark):
    actions = spark.createDataFrame([(1, 1, "grant", 10), (1, 2, "spend", 25), (1, 3, "spend", 6), (1, 4, "deduct", 99), (1, 5, "grant", -3), (1, 6, "what", 1), (2, 1, "spend", 21)], "user_id long, seq long, op string, amount long")
    found = {(r.user_id, r.seq): (r.free, r.paid, r.done) for r in ledger.spend_fold(actions).collect()}
    assert found == {(1, 1): (20, 10, True), (1, 2): (0, 5, True), (1, 3): (0, 5, False), (1, 4): (0, 0, True), (1, 5): (0, 0, False), (1, 6): (0, 0, False), (2, 1): (20, 0, False)}


def test_refunds_reverse_each_bucket_once(spark):
    spends = spark.createDataFrame([("spend:1", "free", "SPEND", -3), ("spend:1", "paid", "SPEND", -2), ("spend:2", "paid", "SPEND", -7)], "reference string, bucket string, kind string, delta long")
    asked = spark.createDataFrame([("spend:1",), ("spend:1",), ("spend:9",)], "reference string")
    back = ledger.refunds(spends, asked)
    assert rows(back, "reference", "bucket", "kind", "delta") == [("refund:1", "free", "REFUND", 3), ("refund:1", "paid", "REFUND", 2)]
    assert rows(ledger.unrefunded(spends.unionByName(back)), "reference") == [("spend:2",)]


def test_idempotent_keeps_entries_without_reference(spark):
    entries = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, None, 1), (4, None, 1)], "id long, ref string, delta long")
    assert rows(ledger.idempotent(entries, "ref", ["id"]), "id") == [(1,), (3,), (4,)]


def test_quota_gives_spare_places_on(spark):
    found = [("SC", i) for i in range(1)] + [("HC", i) for i in range(9)] + [("XX", 1)]
    df = spark.createDataFrame(found, "court string, rank long")
    placed = arrange.by_quota(df, "court", ["SC", "HC", "DC"], (0.4, 0.3, 1.0), 5, [F.col("rank")])
    assert [(r.court, r.rank, r.place) for r in placed.orderBy("place").collect()] == [("SC", 0, 1), ("HC", 0, 2), ("HC", 1, 3), ("HC", 2, 4), ("HC", 3, 5)]


def test_promote_and_leading_first(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(9)], "rank long, home boolean")
    moved = arrange.promote(df, F.col("home"), 2, [F.col("rank")])
    assert [r.rank for r in moved.orderBy("place").collect()] == [0, 3, 1, 2, 4, 5, 6, 7, 8]
    first = arrange.leading_first(df.filter("rank in (7, 8)"), df, "rank", 4, [F.col("rank")])
    assert [r.rank for r in first.collect()] == [7, 8, 0, 1]


def test_checksum_does_not_depend_on_order(spark):
    df = spark.range(1000).withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")))
    one, two = (reporting.checksum(x).first() for x in (df.repartition(3), df.orderBy(F.desc("id"))))
    assert one == two and one != reporting.checksum(df.filter("id > 0")).first() and reporting.checksum(df.limit(0)).first().n == 0


def test_judgments_and_rejects(spark, tmp_path):
    fine = {"case_title": "A v B", "full_text": "text", "judgment_date": "2020-01-31", "bench": ["X"]}
    lines = [json.dumps(fine), json.dumps({"case_title": " ", "full_text": "t"}), json.dumps({"case_title": "t"}), "{broken", ""]
    (tmp_path / "j.jsonl").write_text("\n".join(lines))
    good, bad = files.judgments(spark, str(tmp_path / "j.jsonl"))
    one = good.first()
    assert good.count() == 1 and (one.court_name, str(one.judgment_date), one.keywords, len(one.content_hash)) == ("Unknown", "2020-01-31", [], 64)
    assert sorted(r.reason for r in bad.collect()) == ["no text", "no title", "not JSON"]


def test_logs_and_files(spark, tmp_path):
    (tmp_path / "a.log").write_text('x {"level":"info","time":"2024-01-02T00:00:00Z","step":"s","ms":5.5,"msg":"m"}\nno json\n{"level":"warn","time":"bad"}\n')
    found = files.log_records(spark, str(tmp_path / "a.log"))
    assert rows(found, "level", "step", "ms") == [("info", "s", 5.5)] and files.log_records(spark, str(tmp_path / "a.log"), "2024-02-01").count() == 0
    assert [r.name for r in files.text_files(spark, str(tmp_path / "*.log")).collect()] == ["a.log"]


def test_rebuild_replaces_only_its_parents(spark, tmp_path):
    path = str(tmp_path / "children")
    files.rebuild_children(spark.createDataFrame([(1, "a"), (2, "b")], "parent long, v string"), path, "parent")
    files.rebuild_children(spark.createDataFrame([(2, "c")], "parent long, v string"), path, "parent")
    assert rows(spark.read.parquet(path), "parent", "v") == [(1, "a"), (2, "c")]
    files.write_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_charges_take_free_credits_first_and_once_a_reference(spark):
    actions = [(1, 1, 3, "a"), (1, 2, 3, "a"), (1, 3, 9, "b"), (1, 4, 4, "b"), (1, 5, 0, "c"), (1, 6, 1, None), (1, 7, 1, None), (2, 1, 2, "x"), (2, 2, 30, "y"), (3, 1, 1, "old"), (None, 1, 1, "z")]
    df = spark.createDataFrame(actions, "user_id long, seq long, cost long, reference string").repartition(3)
    balances = spark.createDataFrame([(1, 4, 5, True), (3, 0, 0, True)], "user_id long, free long, paid long, granted boolean")
    spent = spark.createDataFrame([("old:paid",), ("x%:free",), (None,), ("grant:1",)], "reference string")
    charged = ledger.charges(df, balances, spent, 20).cache()
    got = {(r.user_id, r.seq): (r.allowed, r.charged, r.free_left, r.paid_left, r.already_spent) for r in charged.collect()}
    assert got == {
        (1, 1): (True, 3, 1, 5, False),
        (1, 2): (True, 0, 1, 5, True),
        (1, 3): (False, 0, 1, 5, False),
        (1, 4): (True, 4, 0, 2, False),
        (1, 5): (True, 0, 0, 2, False),
        (1, 6): (True, 1, 0, 1, False),
        (1, 7): (True, 1, 0, 0, False),
        (2, 1): (True, 2, 18, 0, False),
        (2, 2): (False, 0, 18, 0, False),
        (3, 1): (True, 0, 0, 0, True),
    }
    made = sorted(tuple(r) for r in ledger.entries_of(charged).filter("user_id < 3 and seq < 5").collect())
    assert made == sorted([(1, 1, "SPEND", "FREE", -3, 1, "a:free"), (1, 4, "SPEND", "FREE", -1, 0, "b:free"), (1, 4, "SPEND", "PAID", -3, 2, "b:paid"), (2, 1, "GRANT", "FREE", 20, 20, "grant:2"), (2, 1, "SPEND", "FREE", -2, 18, "x:free")])
