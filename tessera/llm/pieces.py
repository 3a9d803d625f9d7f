"""Pre-tokens of a ``tokenizers`` file and a bounded table of their pieces.

A tokenizer cuts a text at special strings, normalises what lies between, cuts
it into pre-tokens and each of them into pieces, whatever stands around it.  So
pieces are found once per distinct pre-token and kept; the table of a worker
holds at most ``LIMIT`` entries of ``LIMIT_CHARS`` characters in all, or those
of the words at hand; beyond that it keeps what these need and drops the rest.

Any file is cut by its own normaliser and pre-tokenizer.  For the two pre-token
rules known here, texts of characters on which regular-expression engines and
Unicode versions agree are cut faster, by the same rule.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import regex

from tessera.llm.arrowkit import KEPT

LIMIT = 800_000
LIMIT_CHARS = 16 * LIMIT

# The pre-token pattern that the byte-level file states, and the
# settings by which the two known rules are told.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_RULE = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_RULE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)

# Characters that composition leaves alone and whose class is settled: Latin
# below U+0250 but for separators and U+0130 (which lower-cases to two),
# Cyrillic letters, dashes, quotes and other marks, kana, CJK and Hangul.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ɏЀ-ҁҊ-ӿ‐-‧‰-⁞€™ぁ-ゖァ-ヺ一-鿯가-힣]*")


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian uint32."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceTable:
    """Pieces by pre-token of one ``tokenizers`` file.

    A pre-token is a string of the text where a known rule cuts it, the bytes of
    the library's form of it where the library does, and the id of a special string.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        if spec["model"].get("dropout"):
            raise ValueError(f"{path}: pieces are drawn at random")
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError(f"{path}: added tokens that depend on what stands around them")
        self.rule = next((n for n, r in (("byte", BYTE_RULE), ("word", WORD_RULE)) if r == (spec["normalizer"], spec["pre_tokenizer"])), None)
        self.bare = self.tokenizer
        if self.rule and spec["normalizer"]:  # strings that a known rule cuts are normal as they are
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
        self.find = regex.compile(BYTE_PATTERN).findall
        self.special_ids = {t.content: i for i, t in added.items()}
        listed = sorted(self.special_ids, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, listed))})") if listed else None
        self.chars = 0
        self.counts: dict[str | bytes | int, int] = {}
        self.ids: dict[str | bytes | int, bytes] = {}

    def pretokens(self, text: str) -> list[str | bytes | int]:
        """Parts whose pieces don't depend on each other.

        The rule of the lower-casing file drops white space and no piece spans
        it, so runs between white space do as its parts.
        """
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return [x for i, part in enumerate(parts) for x in ([self.special_ids[part]] if i % 2 else self._between(part))]
        return self._between(text)

    def _between(self, text: str) -> list[str | bytes]:
        if self.rule and _PLAIN.fullmatch(text):
            return text.lower().split() if self.rule == "word" else self.find(text)
        tokenizer = self.tokenizer
        text = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        parts = [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if tokenizer.pre_tokenizer else [text] if text else []
        return [p.encode() for p in parts]

    def _kept(self, table: dict, words: set, new: list) -> dict:
        """The table that ``new`` ones of ``words`` enter: if it would be too large, what it knows of ``words`` alone."""
        chars = lambda ws: sum(len(w) for w in ws if not isinstance(w, int))
        more = chars(new)
        if len(table) + len(new) > LIMIT or self.chars + more > LIMIT_CHARS:
            table = {w: table[w] for w in words if w in table}
            self.chars = chars(table)
        self.chars += more
        return table

    def _others(self, words: list) -> list[tuple[bytes | int, list[int]]]:
        """Ids of those of ``words`` that aren't strings of a text."""
        return [(w, [w] if isinstance(w, int) else [t.id for t in self.tokenizer.model.tokenize(w.decode())]) for w in words if not isinstance(w, str)]

    def add_counts(self, words: set) -> dict[str | bytes | int, int]:
        """Number of pieces of at least ``words``, each counted once."""
        new = [w for w in words if w not in self.counts]
        self.counts = self._kept(self.counts, words, new)
        self.counts.update((w, len(ids)) for w, ids in self._others(new))
        plain = [w for w in new if isinstance(w, str)]
        for a in range(0, len(plain), 20_000):
            part = plain[a : a + 20_000]
            self.counts.update(zip(part, (len(e.ids) for e in self.bare.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return self.counts

    def add_ids(self, words: set) -> dict[str | bytes | int, bytes]:
        """Little-endian uint32 ids of at least ``words``.

        Plain words are encoded many at a time with a special string between
        them, at whose id the ids are cut; no word holds one.  Ids alone are
        asked for, not the places they stand at.
        """
        new = [w for w in words if w not in self.ids]
        self.ids = self._kept(self.ids, words, new)
        self.ids.update((w, id_bytes(ids)) for w, ids in self._others(new))
        plain = [w for w in new if isinstance(w, str)]
        if not plain:
            return self.ids
        if not self.special_ids:
            encoded = self.bare.encode_batch_fast(plain, add_special_tokens=False)
            self.ids.update((w, id_bytes(e.ids)) for w, e in zip(plain, encoded, strict=True))
            return self.ids
        mark, mark_id = next(iter(self.special_ids.items()))
        for a in range(0, len(plain), 500):
            part = plain[a : a + 500]
            ids = np.array(self.bare.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(ids == mark_id)).tolist()
            raw = ids.tobytes()
            self.ids.update((w, raw[i:j]) for w, i, j in zip(part, [0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True))
        return self.ids


_tables: dict[str, PieceTable] = KEPT.setdefault("pieces", {})


def piece_table(path: str) -> PieceTable:
    """This worker's table for a file."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]
