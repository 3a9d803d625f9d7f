"""Tables that hold what an operator may meet: nulls, empty and long texts, repeats, other columns."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, h long, text_ string, component long, b int, part int, score double, toxic int"


def table_of(spark, rows):
    """documents of (doc_id, text, lang, source) with other columns whose names operators might use."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 7, "k", 1, t, 0, 1, 2, 0.5, 1) for i, t, lang, source in rows], SCHEMA)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(("river", "stone", "walks", "Under", "seven", "quiet", "lamps", "north", "garden", "old", "winter", "letters")) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    long = sentence(rng, 60_000)
    body = sentence(rng, 80)
    return [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, " \t\r\n ", None, "a"),
        (4, "word", "en", "a"),
        (5, "two words", "fr", "b"),
        (6, body, "en", "a"),
        (7, body, "en", "a"),
        (8, body + " End", None, None),
        (9, body.upper(), "en", "a"),
        (10, long, "en", "a"),
        (10, long, "en", "a"),
        (11, "12345 !!! ---", "en", "a"),
        (12, "line one\nline one\n\nline one\nother <|endoftext|> and <|startoftext|>", "en", "b"),
        (13, "Ünïcode ğ İstanbul ẞtraße  wide space é \U0001f600 中文 ‍ x", "de", "b"),
        (None, body, "en", "a"),
        (None, None, None, None),
        (-4, "</s>[INST] ok [/INST]", "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table_of(spark, odd_rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return table_of(spark, [])


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
