"""The bounded table of pieces, and how much text the packing holds at a time."""

from __future__ import annotations

import pyarrow as pa

from tessera.llm import packing, pieces
from tessera.llm.queries import WORD_BPE, tokenizer_path


class Context:
    @staticmethod
    def get():
        return Context()

    def partitionId(self):
        return 0


def test_a_full_table_keeps_the_words_at_hand(monkeypatch):
    table, whole = (pieces.PieceTable(tokenizer_path(WORD_BPE)) for _ in range(2))
    monkeypatch.setattr(pieces, "LIMIT", 40)
    encoded, others = [], table._others
    monkeypatch.setattr(table, "_others", lambda words: encoded.append(len(words)) or others(words))
    for first in range(0, 200, 10):
        words = {f"word{i}" for i in range(first, first + 20)}  # half of them are known
        ids = table.add_ids(words)
        assert words <= set(ids) and len(ids) <= 40 and table.chars == sum(map(len, ids))
        assert {w: ids[w] for w in words} == {w: whole.add_ids({w})[w] for w in words}
    assert encoded == [20] + [10] * 19


def test_plain_words_are_encoded_without_the_normaliser():
    """It changes none of them: not one settled character, and no two of them where they meet."""
    table = pieces.PieceTable(tokenizer_path(WORD_BPE))
    assert table.bare.normalizer is None and table.tokenizer.normalizer is not None
    settled = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and pieces._PLAIN.fullmatch(chr(i))]
    words = [w for i in range(len(settled)) for w in table.pretokens(settled[i] + settled[i * 7919 % len(settled)])]
    assert len(words) > 30_000 and all(isinstance(w, str) for w in words)
    assert [w for w in words if table.tokenizer.normalizer.normalize_str(w) != w] == []
    known, counts = table.add_ids(set(words)), table.add_counts(set(words))
    for w in words[::37]:
        ids = table.tokenizer.encode(w, add_special_tokens=False).ids
        assert (known[w], counts[w]) == (pieces.id_bytes(ids), len(ids))


def test_packing_cuts_a_megabyte_at_a_time(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", Context)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(["some words of text " * 500] * 400)], ["doc_id", "text"])
    made = list(packing._cut(tokenizer_path(WORD_BPE), 2048, 0)(iter([batch])))
    assert max(len(set(b.column("doc_id").to_pylist())) for b in made) <= 2**20 // (19 * 500) + 1
    assert [i for b in made for i in dict.fromkeys(b.column("doc_id").to_pylist())] == list(range(400))
