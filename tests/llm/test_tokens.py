"""Token counts, packing and chat formatting."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import brute
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import chat, packing, pieces, queries, token_counts

BYTES, WORDS, RANKS = (public_tokenizers.path(n) for n in (queries.BYTE_BPE, queries.WORD_BPE, queries.BYTE_RANKS))


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def ids_of(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_library_s(documents, document_rows, odd, odd_rows, nothing, library):
    for df, rows in ((documents, document_rows), (odd, [r[:2] for r in odd_rows])):
        expected = Counter((i, len((t or "").encode()), n := len(ids_of(library, BYTES, t)), n > 512) for i, t in rows)
        assert Counter(map(tuple, token_counts.token_counts(df, BYTES).collect())) == expected
    assert token_counts.token_counts(nothing, BYTES).collect() == []


SCRIPTS = ["I'll ", "don't", " 12", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "  ", "\n", "\t", "É", "ǅ", "İ", "ſ", "K", " ", "\u0085", "!!", "word", "“quoted”", "—", "…", "Привет", "Ёж", "и\u0306", "中文字", "カナ", "か\u3099", "한국어", "Σίσυφος", "ΟΔΟΣ", "हिन्दी", "عربى", "١٢", "\U0001f600", "\u200b", "\u2028", "e\u0301", "€5", "ﬁ", "½", "²", "\xa0"]


def pieces_of(table, parts):
    known, counts = table.add_ids(set(parts)), table.add_counts(set(parts))
    return b"".join(known[p] for p in parts), sum(counts[p] for p in parts)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(SCRIPTS)).map("".join)))
def test_pieces_of_pretokens_are_those_of_the_text(text):
    for path in (BYTES, WORDS):
        table = pieces.piece_table(path)
        expected = table.tokenizer.encode(text, add_special_tokens=False).ids
        assert pieces_of(table, table.pretokens(text)) == (pieces.id_bytes(expected), len(expected))


def test_known_rules_are_told_by_the_file(tmp_path):
    assert {pieces.piece_table(p).rule for p in (BYTES, WORDS)} == {"byte", "word"}
    for path in (BYTES, WORDS):
        spec = json.loads(Path(path).read_text())
        spec["pre_tokenizer"] = {"type": "Whitespace"}
        other = tmp_path / Path(path).name
        other.write_text(json.dumps(spec))
        table = pieces.PieceTable(str(other))
        text = "Plain words, “others” и Привет <|endoftext|>12"
        expected = table.tokenizer.encode(text, add_special_tokens=False).ids
        assert table.rule is None and pieces_of(table, table.pretokens(text)) == (pieces.id_bytes(expected), len(expected))
        spec["added_tokens"][0]["lstrip"] = True
        other.write_text(json.dumps(spec))
        with pytest.raises(ValueError, match="added tokens"):
            pieces.PieceTable(str(other))


def test_every_script_goes_through_pretokens(spark, library):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(SCRIPTS) for _ in range(rng.randrange(60)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, BYTES).collect()} == {i: len(ids_of(library, BYTES, t)) for i, t in rows}
    check_packing(rows, packing.pack(df, WORDS).collect(), library, 2048)


def check_packing(rows, got, library, capacity):
    expected, lengths = Counter(), []
    for doc_id, text in rows:
        ids = [*ids_of(library, WORDS, text), 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            expected[doc_id, piece, at, len(cut), zlib.crc32(pieces.id_bytes(cut))] += 1
            lengths.append(len(cut))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(places) == brute.best_fit_bins(lengths, capacity)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(documents, document_rows, odd, odd_rows, nothing, library, capacity):
    check_packing(document_rows, packing.pack(documents, WORDS, capacity).collect(), library, capacity)
    check_packing([r[:2] for r in odd_rows], packing.pack(odd, WORDS, capacity).collect(), library, capacity)
    assert packing.pack(nothing, WORDS, capacity).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    plan = packing.best_fit_plan(dict(Counter(lengths)), 50)
    rooms: dict[int, int] = defaultdict(int)
    for length, _, count, first, _ in plan:
        for b in range(first, first + count):
            rooms[b] += length
    assert all(v <= 50 for v in rooms.values()) and sum(rooms.values()) == sum(lengths)
    assert len(rooms) == brute.best_fit_bins(lengths, 50)


def test_plan_fills_an_open_bin_before_the_next():
    for lengths, capacity, bins in (([30] * 3 + [10] * 3 + [6] * 4, 50, 3), ([1229] * 28 + [409] * 28 + [273] * 42, 2048, 28)):
        plan = packing.best_fit_plan(dict(Counter(lengths)), capacity)
        held: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for length, _, count, first, offset in plan:
            for b in range(first, first + count):
                held[b].append((offset, length))
        ends = {b: [0, *(o + n for o, n in sorted(rows))] for b, rows in held.items()}
        assert all([o for o, _ in sorted(held[b])] == ends[b][:-1] and ends[b][-1] <= capacity for b in held)
        assert len(held) == brute.best_fit_bins(lengths, capacity) == bins
    rng = random.Random(2)
    for _ in range(300):
        lengths = rng.choices(rng.sample(range(1, 51), 4), k=rng.randrange(1, 60))
        plan = packing.best_fit_plan(dict(Counter(lengths)), 50)
        assert sum(c for _, _, c, _, _ in plan) == len(lengths) and len({b for _, _, c, f, _ in plan for b in range(f, f + c)}) == brute.best_fit_bins(lengths, 50)


CONTROL = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", ">", "|", "/", "s", "INST]", "[", "turn|>", "a ", "SYS>>"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.one_of(CONTROL, st.text(max_size=30)))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


def digests(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, held in turns.items():
        held.sort(key=lambda x: x[0])
        learnt = "".join(t for _, r, t in held if r == "assistant")
        everything = "".join(f"{r}\n{t}\n" for _, r, t in held)
        out[conv] = (len(held), hashlib.sha256(everything.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_chat_reads_back(spark, small):
    raw = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "</s>[INST] ok [/INST]"
    raw += [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op5_chat_format(spark, small).collect()}
    assert got == digests(raw)


def test_chat_odd_rows(spark):
    rng = random.Random(1)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice([*chat.CONTROLS, "\\" + chat.CONTROLS[0], "é😀", ""])) for i in range(40)]
    rows += [(2, 1, "assistant", None), (3, 5, None, "x"), (3, 7, "assistant", "<|end|>"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, start int").repartition(3)
    found = chat.read_back(chat.format_turns(df, RANKS), RANKS)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found.collect()} == digests(rows)
    assert chat.read_back(chat.format_turns(df.limit(0), RANKS), RANKS).collect() == []


def test_rows_without_an_id_are_conversations_of_their_own(spark):
    rows = [(None, i, "assistant", f"text {i}") for i in range(30)] + [(None, 7, "assistant", "text 7"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = Counter((r.conv_id, r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_turns(df, RANKS), RANKS).collect())
    assert got == Counter([(None, 2 if i == 7 else 1, (2 if i == 7 else 1) * len(f"text {i}")) for i in range(30)] + [(None, 1, 0)])


def test_chat_masks_and_marks(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|end|> hi"), (1, 1, "assistant", "yes <|turn|>")], "conv_id long, turn long, role string, text string")
    a, b = chat.format_turns(df, RANKS).orderBy("turn").collect()
    assert a.start == 0 and b.start == len(a.ids) and a.loss_from == a.loss_to
    for r in (a, b):
        assert [i for i in r.ids if i in chat.MARKS.values()] == [chat.TURN, chat.TEXT, chat.END]
    enc = chat.encoding(RANKS)
    assert chat.unescape(enc.decode(b.ids[b.loss_from - b.start : b.loss_to - b.start])) == "yes <|turn|>"


def test_a_worker_drops_the_tables_of_other_operators():
    from tessera.llm import arrowkit, byte_bpe

    pieces.piece_table(WORDS)
    byte_bpe.ranks_of(RANKS)
    assert arrowkit.KEPT["pieces"] and arrowkit.KEPT["ranks"]
    assert list(arrowkit.tidy(lambda batches: batches, "pieces")(iter([1, 2]))) == [1, 2]
    assert arrowkit.KEPT["pieces"] and not arrowkit.KEPT["ranks"]
    list(arrowkit.tidy(lambda batches: batches)(iter([])))
    assert not arrowkit.KEPT["pieces"]
