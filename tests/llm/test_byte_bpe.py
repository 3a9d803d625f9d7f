"""Encoding by halves against the library that the ranks are for."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_bpe

PATHS = {name: public_tokenizers.path(name) for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")}
PATH = PATHS["byte_bpe_50k.tiktoken"]


def library(path, pattern=public_tokenizers.PATTERN):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


ENCODERS = {path: library(path) for path in PATHS.values()}


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.mark.parametrize("path", PATHS.values(), ids=PATHS)
@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(path, text):
    ranks = byte_bpe.ranks_of(path)
    packed = ranks.encode([text])[0]
    assert ids_of(packed) == ENCODERS[path].encode_ordinary(text) and ranks.decode(packed) == text.encode()


@pytest.mark.parametrize("path", PATHS.values(), ids=PATHS)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "aa", "ing", "the", "é", "中", "̀", "x" * 70]), min_size=2, max_size=60), st.integers(1, 10_000))
def test_any_cut_of_a_pretoken_is_joined(path, parts, cut):
    """The product of two encodings is the encoding of the whole, wherever it is cut, also inside a character."""
    ranks, data = byte_bpe.ranks_of(path), "".join(parts).encode()
    cut = 1 + cut % (len(data) - 1)
    whole = ranks._merge_long(data)
    assert ranks.join(ranks.tree(data[:cut]), ranks.tree(data[cut:])) == whole == ranks.tree(data)
    if len(data) <= byte_bpe.SHORT:
        assert ranks.merge(data) == whole


def test_product_is_associative():
    ranks, rng = byte_bpe.ranks_of(PATH), random.Random(3)
    for _ in range(200):
        a, b, c = (ranks.tree(bytes(rng.choices(b"aeinorst", k=rng.randrange(1, 40)))) for _ in range(3))
        assert ranks.join(ranks.join(a, b), c) == ranks.join(a, ranks.join(b, c))


def test_pretokens_of_hundreds_of_thousands_of_bytes():
    ranks, rng = byte_bpe.ranks_of(PATH), random.Random(4)
    for text in ("a" * 200_000, "ab" * 50_000 + "c", "".join(rng.choices("abcdefgh", k=200_000)), "-" * 30_001 + "x", " " * 50_000 + "y", "的" * 20_000):
        packed = ranks.encode([text])[0]
        assert ranks.decode(packed) == text.encode()
        assert ids_of(packed) == ENCODERS[PATH].encode_ordinary(text)


def test_characters_on_which_unicode_versions_differ():
    """Every assigned and unassigned character between letters, in runs of 4,096 characters."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ranks, encoder = byte_bpe.ranks_of(PATH), ENCODERS[PATH]
    for a in range(0, len(codes), 4096):
        if codes[a] > 0x33000 and codes[a] < 0xE0000 or codes[a] > 0xE2000:
            continue
        text = "".join(f"x{chr(c)} {chr(c)}'s\t{chr(c)}" for c in codes[a : a + 4096])
        assert ids_of(ranks.encode([text])[0]) == encoder.encode_ordinary(text), hex(codes[a])


def expected(i, text):
    ids = ENCODERS[PATH].encode_ordinary(text or "")
    return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def got(df):
    return sorted((tuple(r) for r in byte_bpe.round_trip(df, PATH).collect()), key=repr)


def test_documents(spark, documents, document_rows):
    assert got(documents) == sorted((expected(*r) for r in document_rows), key=repr)


def test_odd_rows(odd, odd_rows):
    """Nulls, empty and long texts, special strings, repeats, columns with clashing names."""
    assert got(odd) == sorted((expected(i, t) for i, t, *_ in odd_rows), key=repr)


def test_empty_table(nothing):
    assert got(nothing) == [] and byte_bpe.round_trip(nothing, PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_segments_and_a_full_table(spark, monkeypatch):
    """Cutting long texts and starting the table anew change nothing."""
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdeé's \n", k=rng.randrange(1, 12))) for _ in range(4000)) for _ in range(3)]
    monkeypatch.setattr(byte_bpe, "SEGMENT", 500)
    monkeypatch.setattr(byte_bpe, "LIMIT", 100)
    ranks = byte_bpe.Ranks(PATH)
    for text in texts:
        parts = list(byte_bpe._segments(text))
        assert "".join(parts) == text and len(parts) > 10
        assert ids_of(b"".join(ranks.encode([p])[0] for p in parts)) == ENCODERS[PATH].encode_ordinary(text)
        assert len(ranks.kept) < 1000


def test_a_round_trip_takes_one_worker_a_task(documents):
    """Workers change places from task to task: with two in a row both would hold the encoder's tables."""
    assert byte_bpe.round_trip(documents, PATH)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = byte_bpe.decode_ids(byte_bpe.encode_texts(documents, PATH), PATH)
    told = apart.selectExpr("doc_id", "cast(octet_length(ids) div 4 as long)", "sha2(ids, 256)", "sha2(spelt, 256)")
    assert got(documents) == sorted((tuple(r) for r in told.collect()), key=repr)


def test_the_table_of_merges_is_bounded_and_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(byte_bpe, "LIMIT", 40)
    ranks, asked, merge = byte_bpe.Ranks(PATH), [], byte_bpe.Ranks.merge
    monkeypatch.setattr(byte_bpe.Ranks, "merge", lambda self, data: asked.append(data) or merge(self, data))
    for i in range(200):
        for data in (b"often", b"n%d" % i):
            assert ranks.known(data) == merge(ranks, data)
        assert len(ranks.merged) + len(ranks.merged_before) <= 40
    assert asked.count(b"often") == 1


def test_files_without_all_bytes_and_unknown_ids_are_refused(tmp_path):
    (tmp_path / "few").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="every byte"):
        byte_bpe.Ranks(str(tmp_path / "few"))
    with pytest.raises(IndexError):
        byte_bpe.ranks_of(PATH).decode(np.array([60_000], "<u4").tobytes())
