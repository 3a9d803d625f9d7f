"""The session router: the rule, the batch form, and the stream with late and repeated messages and a restart."""

from __future__ import annotations

import datetime
import random

import pytest

from tessera.operators import sessions as batch
from tessera.streaming import sessions as stream

START = datetime.datetime(2024, 1, 1, 9)
SCHEMA = "user_id long, id long, ts timestamp, said string, known boolean"
OUT = ("before", "after", "action", "argument", "charge")


def talk(*said, known=True, gap=10, ttl=1800):
    now, out = batch.Session(), []
    for i, text in enumerate(said):
        now, told = batch.step(now, i * gap * 1_000_000, text, known, ttl)
        out.append(told)
    return out


def test_six_states():
    assert [t[1:3] for t in talk("hi", "x", "A. Name, D/12/2020, Delhi, Delhi", "blah", "2", known=False)] == [
        ("AWAITING_PROFILE", "ask_profile"), ("AWAITING_PROFILE", "ask_profile"), ("AWAITING_LANGUAGE", "save_profile"), ("AWAITING_LANGUAGE", "ask_language"), ("MAIN_MENU", "set_language")]
    assert [t[1:] for t in talk("hi", "1", "DLCT01-000123-2024", "dlct010001232024", "DLCT01000", "DLCT0100012", "what is bail", "0")] == [
        ("MAIN_MENU", "greet", None, 0), ("CASE_STATUS", "ask_input", None, 0), ("CASE_STATUS", "search", "DLCT010001232024", 1), ("CASE_STATUS", "search", "DLCT010001232024", 0),
        ("MAIN_MENU", "classify", "DLCT01000", 0), ("MAIN_MENU", "classify", "DLCT0100012", 0), ("MAIN_MENU", "classify", "what is bail", 0), ("MAIN_MENU", "show_menu", None, 0)]
    assert [t[2:] for t in talk("hi", "3", "bail", "more", "और", "more", "more", "3", "bail", "Bail!", "thanks")] == [
        ("greet", None, 0), ("ask_input", None, 0), ("search", "bail", 2), ("next_page", None, 0), ("next_page", None, 0), ("next_page", None, 0), ("nothing_more", None, 0),
        ("ask_input", None, 0), ("search", "bail", 2), ("search", "Bail!", 0), ("classify", "thanks", 0)]
    assert talk("hi", "more", known=False)[1][1:3] == ("AWAITING_PROFILE", "ask_profile")
    assert [t[0] for t in talk("hi", "2", "IPC 302", gap=2000)] == [None, None, None]


def messages(n, seed=5):
    rng = random.Random(seed)
    pool = ["1", "2", "3", "0", "more", "what is IPC 302", "DLCT010001232024", "thanks", "DLCT0100012x9", "A. B, D/1/2020, Delhi, Delhi", "anticipatory bail", "", None, "धारा 302 क्या है"]
    at, rows = START, []
    for i in range(n):
        at += datetime.timedelta(seconds=rng.randrange(1, 240))
        rows.append((rng.randrange(6), i, at, rng.choice(pool), rng.random() < 0.5))
    return rows


def folded(rows, ttl=1800):
    out, now = {}, {}
    for u, i, ts, text, known in sorted(rows, key=lambda r: (r[2], r[1])):
        if (u, i) in out:
            continue
        us = int(ts.replace(tzinfo=datetime.UTC).timestamp() * 1_000_000)
        now[u], out[u, i] = batch.step(now.get(u, batch.Session()), us, text, known, ttl)
    return out


def test_table_equals_the_fold(spark):
    rows = messages(400)
    odd = [(None, 1, START, "x", True), (1, None, START, "x", True), (1, 5000, None, "x", True)]
    df = spark.createDataFrame(rows + rows[::7] + odd, SCHEMA).repartition(5)
    got = {(r.user_id, r.id): tuple(r[c] for c in OUT) for r in batch.routed(df, "user_id", "id", "ts", "said", "known").collect()}
    assert got == folded(rows) and {v[1] for v in got.values()} == set(batch.STATES)
    assert batch.routed(df.limit(0), "user_id", "id", "ts", "said", "known").count() == 0


@pytest.fixture()
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_with_repeats_late_messages_and_a_restart(spark, store, tmp_path):
    rows = messages(160)
    parts = [rows[:60], [*rows[60:110], *rows[90:100]], rows[110:]]  # repeats within a batch
    last = rows[109][2]
    parts[2] = [(9, 9000, last - datetime.timedelta(hours=5), "hi", True), *parts[2], (rows[0][0], rows[109][1] + 5000, last, "more", True)]
    final = rows[-1][2] + datetime.timedelta(hours=3)
    parts.append([(99, 7000, final, "hi", True)])
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))

    def run(upto):
        source = spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = stream.routed(source.filter(f"part <= {upto}") if upto < 3 else source, "user_id", "id", "ts", "said", "known")
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None

    hidden = tmp_path / "later"
    hidden.mkdir()
    for k in (2, 3):
        (tmp_path / "in" / f"part={k}").rename(hidden / f"part={k}")
    run(3)
    for k in (2, 3):
        (hidden / f"part={k}").rename(tmp_path / "in" / f"part={k}")
    run(3)  # another query, from the checkpoint
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    told = {(r.user_id, r.id): tuple(r[c] for c in OUT) for r in got if r.action != "expired"}
    kept = [r for r in rows] + [parts[2][-1], parts[3][0]]
    assert told == folded(kept) and (9, 9000) not in told
    assert len(told) == sum(r.action != "expired" for r in got)
    assert {r.user_id for r in got if r.action == "expired"} == {r[0] for r in rows}
