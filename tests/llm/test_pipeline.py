"""The pipeline's stages, each against a plain Python form on what the stage before kept."""

from __future__ import annotations

import random
from collections import Counter

import brute
import corpus_pipeline
import public_tokenizers
from conftest import sentence, table_of
from test_tokens import check_packing
from tokenizers import Tokenizer

from tessera.llm import decontam, langid, queries, toxicity


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_take_effect_one_after_the_other(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    path = public_tokenizers.path(queries.WORD_BPE)

    known = {r.doc_id: r for r in langid.identify(docs).collect()}
    kept = stages["language_id"](spark, docs, medium).cache()
    assert {i for i, _ in rows_of(kept)} == {i for i, r in known.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LANGUAGE_SCORE}
    assert kept.columns == columns

    scored = {r.doc_id: r.predicted for r in toxicity.score_toxicity(kept, spark.read.parquet(f"{medium}/labels.parquet")).collect()}
    clean = stages["toxicity"](spark, kept, medium).cache()
    assert {i for i, _ in rows_of(clean)} == {i for i, p in scored.items() if p == 0} and clean.columns == columns

    single = stages["ngram_join"](spark, clean, medium).cache()
    assert {i for i, _ in rows_of(single)} == {c for _, c in brute.components(rows_of(clean)).values()} and single.columns == columns

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    _, leaks = brute.leaks(rows_of(single), items, decontam.SIMILARITY_PERCENT, decontam.RADIUS)
    fresh = stages["decontamination"](spark, single, medium).cache()
    assert {i for i, _ in rows_of(fresh)} == {i for i, _ in rows_of(single)} - {i for i, _ in leaks} and fresh.columns == columns

    packed = stages["packing"](spark, fresh, medium).collect()
    check_packing(rows_of(fresh), packed, {path: Tokenizer.from_file(path)}, 2048)
    assert 0 < fresh.count() < single.count() < clean.count() < kept.count() <= docs.count()


def test_run_is_the_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    strip = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert strip(corpus_pipeline.run(spark, small)) == strip(docs)


def test_stages_of_odd_and_empty_tables(spark, odd, nothing, small):
    for df in (odd, nothing, table_of(spark, [(1, None, None, None)])):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small)
            assert name == "packing" or docs.columns == df.columns
        docs.collect()


def test_rows_with_repeated_and_null_ids(spark, small):
    """A row that goes takes no other row with it, whatever their ids."""
    rng = random.Random(19)
    item = next(r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if len(r.text.split()) > 30)
    clean = [(None if n % 2 else n % 3, sentence(rng, 60)) for n in range(12)]
    bad = [(None, "1234 !!"), (0, None), (None, f"{sentence(rng, 10)} {item} {sentence(rng, 10)}"), (1, clean[4][1] + " end")]
    docs = table_of(spark, [(*r, "en", "a") for r in clean + bad])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
    left = Counter((r.doc_id, r.text) for r in docs.collect())
    near = {clean[4], bad[3]}  # of a text and its near copy one stays
    assert sum(left[r] for r in near) == 1
    assert left - Counter(near) == Counter(r for r in clean if r not in near)
