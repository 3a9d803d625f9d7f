"""Search, change and guard operators on small rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import search, spans
from tessera.functions.text import terms
from tessera.operators import changes, retrieval
from tessera.plans import checks
from tessera.session import dealt


@pytest.mark.parametrize(
    "text, groups, never",
    [
        ("bail or parole -murder", (("bail", "parole"),), ("murder",)),
        ('"anticipatory bail" high court', (("anticipatory bail",), ("high",), ("court",)), ()),
        ("or -", (), ()),
        ("", (), ()),
        ("a or b or c d", (("a", "b", "c"), ("d",)), ()),
    ],
)
def test_web_query(text, groups, never):
    assert search.web_query(text) == search.Query(groups, never)


def test_matches(spark):
    rows = spark.createDataFrame([(1, "Anticipatory bail was granted."), (2, "Bail, anticipatory"), (3, ""), (4, None)], "i int, t string")
    find = lambda q: [r.i for r in rows.filter(search.matches(terms(F.col("t")), search.web_query(q))).orderBy("i").collect()]
    assert find('"anticipatory bail"') == [1] and find("bail -granted") == [2] and find("granted or anticipatory") == [1, 2] and find("x") == []


def test_expansion_is_bounded():
    groups = [["bail", "surety", "bond"], ["x", "y"], ["bond", "bail", *map(str, range(9))]]
    assert search.expanded(["bail"], groups, 3) == ["bail", "surety", "bond", "0"]
    assert search.expanded(["none"], groups) == ["none"]


def test_ranges_topics_and_intents(spark):
    rows = spark.createDataFrame([("230 to 232, 171-I and 376(1)",), ("5 - 3",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(search.number_ranges(F.col("t"))).collect()] == [["230", "231", "232", "171-I", "376(1)"], ["5"], [], None]
    asked = spark.createDataFrame([("What is the punishment under section 302?",), ("case status CNR",), (None,)], "t string")
    found = asked.select(search.topic(F.col("t")).alias("w"), search.intent(F.col("t"), [("status", r"\bstatus\b"), ("law", r"\bsection\b")], "talk").alias("i")).collect()
    assert [(r.w, r.i) for r in found] == [(["punishment"], "law"), (["case", "status", "cnr"], "status"), (None, "talk")]


def test_bm25_prefers_rare_terms_and_short_texts(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common common"), (3, "common rare " + "pad " * 5), (4, None), (5, "")], "doc_id long, text string")
    found = retrieval.bm25_topk(docs, ["rare", "common"], 10).orderBy("sparse_rank").collect()
    assert [r.doc_id for r in found] == [1, 3, 2]
    assert retrieval.bm25_topk(docs.limit(0), ["rare"], 10).collect() == []


def test_hashed_vectors_have_unit_length(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "a"), (3, ""), (4, None)], "k long, t string")
    found = search.hashed_vectors(docs, "k", "t", 16).groupBy("k").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert sorted(r.k for r in found) == [1, 2] and all(abs(r.n - 1) < 1e-9 for r in found)


def test_null_guards_change_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "k long, v string")
    found = changes.update_where(df, F.col("k") > 2, {"v": F.lit("new"), "k": F.col("k") + 1})
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "a"), (None, "b"), (4, "new")], key=repr)


def test_merge_sums_and_fills(spark):
    accounts = spark.createDataFrame([(1, 5, None), (2, 7, "x"), (3, 1, "y"), (4, 2, "own")], "id long, paid long, city string")
    moves = spark.createDataFrame([(2, 1), (3, 1), (3, 1), (9, 1)], "old long, new long")
    found = changes.merge_accounts(accounts, moves, "id", ["paid"], ["city"])
    assert sorted(map(tuple, found.collect())) == [(1, 13, "x"), (4, 2, "own")]


def test_tokens(spark):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    tokens = spark.createDataFrame([(1, 1, day(1), day(30)), (2, 1, day(2), day(30)), (3, 2, day(1), day(5)), (4, 3, day(1), day(30)), (5, 4, day(1), day(30))], "token_id long, user_id long, a string, b string")
    tokens = tokens.select("token_id", "user_id", F.col("a").cast("timestamp_ntz").alias("issued_at"), F.col("b").cast("timestamp_ntz").alias("expires_at"))
    uses = spark.createDataFrame([(4, True), (5, False), (5, False), (2, False), (1, True)], "token_id long, ok boolean")
    assert [r.token_id for r in changes.live_tokens(tokens, uses, day(20), 2).collect()] == [2]


def test_guard_strikes_what_is_not_known(spark):
    answers = spark.createDataFrame([(1, "see A1 and B2"), (2, "nothing"), (3, None)], "k long, t string")
    known = spark.createDataFrame([("A1",), ("A1",)], "ref string")
    found = {r.k: (r.t, r.removed) for r in changes.guarded(answers, known, "k", "t", lambda c: spans.places(c, r"[A-Z]\d")).collect()}
    assert found == {1: ("see A1 and [unverified]", ["B2"]), 2: ("nothing", []), 3: (None, [])}


def test_cut_and_lifecycle(spark):
    turns = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 0), (None, 5)], "c long, t long")
    anchors = spark.createDataFrame([(1, 2), (1, 3), (2, None)], "c long, t long")
    assert sorted(map(tuple, changes.cut_from(turns, anchors, "c", "t").collect()), key=repr) == sorted([(1, 0), (1, 1), (2, 0), (None, 5)], key=repr)
    events = spark.createDataFrame([(1, "made", 1), (1, "paid", 3), (1, "paid", 2), (1, "other", 9), (2, "other", 1)], "o long, s string, at long")
    assert [tuple(r) for r in changes.lifecycle(events, ["made", "paid", "done"], "o", "s", "at").collect()] == [(1, "paid", 2)]


def test_a_query_without_terms_matches_nothing(spark):
    rows = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    for asked in ("", "!!", '""'):
        assert rows.filter(search.matches(terms(F.col("t")), search.web_query(asked))).count() == 0


def test_vectors_of_texts_are_dealt_once(spark):
    docs = spark.createDataFrame([(1, "one two two"), (1, "two"), (None, "three"), (2, None)], "k long, t string")
    found = search.hashed_vectors(docs, "k", "t", 16)
    assert checks.exchanges(found) == 1
    rows = {(r.k, r.bucket): r.value for r in found.collect()}
    whole = {(r.k, r.bucket): r.value for r in search.hashed_vectors(spark.createDataFrame([(1, "one two two two"), (None, "three")], "k long, t string"), "k", "t", 16).collect()}
    assert rows == whole


def test_dealt_rows_get_more_partitions_as_they_grow(spark):
    few, many = (dealt(spark.range(n), "id", each=100) for n in (50, 5000))
    assert few.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and many.rdd.getNumPartitions() == 50
    assert many.agg({"id": "sum"}).first()[0] == sum(range(5000))
