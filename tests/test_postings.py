"""Searches by stored postings against scans, and what they read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import search
from tessera.functions.text import terms, trigram_similarity
from tessera.plans import checks
from tessera.sources import postings


@pytest.fixture(scope="module")
def index(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "the the of the. The of, THE"), (-4, "of nothing"), (-5, "die der das")], "doc_id long, text string")
    docs = docs.unionByName(more).cache()
    postings.build_terms(docs, f"{path}/terms", "doc_id", "text")
    postings.build_trigrams(docs.select("doc_id", F.substring("text", 1, 24).alias("text")), f"{path}/grams", "doc_id", "text")
    return docs, path


@pytest.mark.parametrize("text", ["the", "the of", "the or der -that", '"of the"', '"the the of"', '"of the" or die -"the. of"', "-the", '-"of the"', "absent", "absent or of", '"absent the"', "", "-"])
def test_equal_to_a_scan(spark, index, text):
    docs, path = index
    query = search.web_query(text)
    expected = {r.doc_id for r in docs.filter(search.matches(terms(F.coalesce("text", F.lit(""))), query)).collect()}
    got = [r.doc_id for r in postings.web_search(spark, f"{path}/terms", query, "doc_id").collect()]
    assert sorted(got) == sorted(expected)


def test_only_the_asked_terms_are_read(spark, index):
    found = postings.web_search(spark, f"{index[1]}/terms", search.web_query("the -that"), "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 1 and "PartitionFilters: [bucket" in scans[0] and "PushedFilters: [In(term" in scans[0]
    files = found.inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 64


@pytest.mark.parametrize("least", [0.0, 0.3, 0.6, 0.99])
@pytest.mark.parametrize("text", ["Anblewh sttible athawh th", "the the of the", "die der dass", "zzzz", "", "of"])
def test_similar_texts_equal_a_scan(spark, index, text, least):
    docs, path = index
    scored = docs.select("doc_id", trigram_similarity(F.coalesce(F.substring("text", 1, 24), F.lit("")), F.lit(text)).alias("s")).filter(F.col("s") > least)
    expected = {(r.doc_id, round(r.s, 9)) for r in scored.collect()}
    got = {(r.doc_id, round(r.similarity, 9)) for r in postings.similar(spark, f"{path}/grams", text, least, "doc_id").collect()}
    assert got == expected


def test_terms_meet_where_their_text_is(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, "a"), (3, None), (4, "")], "k long, t string")
    made = postings.term_rows(docs, "k", "t")
    assert checks.exchanges(made) == 1
    moved = [line for line in checks.plan(made).splitlines() if line.startswith("Arguments: hashpartitioning")]
    assert len(moved) == 1 and "term" not in moved[0]
    assert sorted((r.term, r.key, r.positions) for r in made.collect()) == [("a", 1, [1]), ("a", 2, [0]), ("b", 1, [0, 2])]
