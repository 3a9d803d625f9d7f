"""Byte-level BPE encoding as a monoid tree reduction, and decoding up the same tree.

Encodings of byte strings form a monoid: the product of two encodings is the
encoding of the joined bytes.  A pre-token is cut into halves until they are
short, the short ones are merged by rank, and neighbours are multiplied by
:meth:`Ranks.join`, which re-encodes a window around their border and lets it
grow until it leaves its outermost tokens as they were.  That is proof enough:

* A sequence of tokens is the encoding of its bytes if, and only if, each
  adjacent pair is the encoding of its own bytes.  (A merge picks the least
  rank, the leftmost of equals.  The first merge over a border between two
  tokens would also be picked in the pair's own bytes, where up to then the
  same merges were made.)
* A pair whose two tokens come unchanged from one half, or from the window, is
  such a pair.  So is the pair at a window's edge, if the window's outermost
  token is still the token of the half that stood there.

Pre-tokens don't depend on each other, so between them the product is plain
concatenation; and products may be taken in any order, so a text is a flat
concatenation of its pre-tokens, of which a worker keeps a bounded table.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrowkit import KEPT, tidy
from tessera.llm.pieces import _PLAIN as SETTLED
from tessera.llm.pieces import BYTE_PATTERN, id_bytes
from tessera.llm.wordhash import chunks, text_buffer

LEAF = 8  # bytes merged by rank at once; longer strings are cut into halves
SHORT = 64  # pre-tokens up to this many characters are kept in the table
LIMIT = 1_000_000  # entries of each of the two tables of a worker
SEGMENT = 1 << 20
BATCH_BYTES = 1 << 22

_CUT = re.compile(r"[!-~](?= )")


class Ranks:
    """The vocabulary of a rank file: base64 of the bytes, a blank and the rank, one token a line."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(spelt): int(rank) for spelt, rank in map(bytes.split, lines)}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError(f"{path}: not every byte has a rank")
        self.spelling: list[bytes | None] = [None] * (max(self.rank.values()) + 1)
        for spelt, rank in self.rank.items():
            self.spelling[rank] = spelt
        self.find = regex.compile(BYTE_PATTERN)
        self.stand_ins = _StandIns()
        self.kept: dict[str, bytes] = {}
        self.merged: dict[bytes, list[int]] = {}
        self.merged_before: dict[bytes, list[int]] = {}

    def known(self, data: bytes) -> list[int]:
        """``merge`` with a table: the same short halves and windows come up in many pre-tokens.

        The table has two halves: when the one that is filled is full, it takes
        the other's place, and what is asked for again comes back from there.
        """
        if len(data) > 2 * LEAF:
            return self.merge(data)
        ids = self.merged.get(data)
        if ids is None:
            if len(self.merged) >= LIMIT // 2:
                self.merged, self.merged_before = {}, self.merged
            ids = self.merged[data] = self.merged_before.get(data) or self.merge(data)
        return ids

    def merge(self, data: bytes) -> list[int]:
        """Ids of ``data`` by merging the pair of least rank, the leftmost of equals, while there is one."""
        if len(data) > SHORT:
            return self._merge_long(data)
        rank, parts = self.rank, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [rank.get(a + b) for a, b in zip(parts, parts[1:])]  # noqa: B905
            found = [r for r in ranked if r is not None]
            if not found:
                break
            i = ranked.index(min(found))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [rank[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for a wide window, with a heap of the pairs of a linked list."""
        rank, n = self.rank, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            middle = end[i]
            if middle in (0, to) or middle >= n or end[middle] != to:  # one of the two has been merged since
                continue
            end[i], end[middle] = to, 0
            if to < n:
                before[to] = i
                if (r := rank.get(data[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if i and (r := rank.get(data[before[i] : to])) is not None:
                heapq.heappush(heap, (r, before[i], to))
        out, i = [], 0
        while i < n:
            out.append(rank[data[i : end[i]]])
            i = end[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The product: the encoding of the bytes of ``left`` and ``right`` together."""
        a, b = len(left) - 1, 1
        while True:
            window = self.known(b"".join(map(self.spelling.__getitem__, left[a:] + right[:b])))
            fixed_left, fixed_right = a == 0 or window[0] == left[a], b == len(right) or window[-1] == right[b - 1]
            if fixed_left and fixed_right:
                return left[:a] + window + right[b:]
            if not fixed_left:
                a = max(2 * a - len(left), 0)
            if not fixed_right:
                b = min(2 * b, len(right))

    def tree(self, data: bytes) -> list[int]:
        """Ids of ``data``, which isn't empty, by halves."""
        if len(data) <= LEAF:
            return self.known(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def pretoken(self, text: str) -> bytes:
        """Packed ids of a pre-token; one that is a token as it stands is that token, whatever its merges give."""
        data = text.encode()
        whole = self.rank.get(data)
        return id_bytes([whole] if whole is not None else self.tree(data))

    def pretokens(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return self.find.findall(text)
        spans = self.find.finditer(text.translate(self.stand_ins))
        return [text[m.start() : m.end()] for m in spans]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian uint32) of each text."""
        cut = [self.pretokens(t) for t in texts]
        new = {w for of in cut for w in of if w not in self.kept}
        if len(self.kept) + len(new) > LIMIT:
            self.kept, new = {}, {w for of in cut for w in of}
        found = {w: self.pretoken(w) for w in new}
        if long := [w for w in new if len(w) > SHORT]:
            kept = self.kept | found
            for w in long:
                del found[w]
        self.kept.update(found)
        get = (kept if long else self.kept).__getitem__
        return [b"".join(map(get, of)) for of in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids spell."""
        codes, spelling = np.frombuffer(ids, "<u4"), self.spelling
        return b"".join(b"".join(map(spelling.__getitem__, codes[a : a + SEGMENT].tolist())) for a in range(0, len(codes), SEGMENT))


class _StandIns(dict):
    """For ``str.translate``: an ASCII character of the class that the encoding library gives to a character.

    Engines know different versions of Unicode.  The library drops what its
    pattern doesn't match, so a pattern of one class tells who is in it.
    """

    def __init__(self):
        self.classes = None

    def __missing__(self, code: int) -> int:
        if code < 128:
            self[code] = code
            return code
        if self.classes is None:
            import tiktoken

            one_byte = {bytes([b]): b for b in range(256)}
            self.classes = [(s, tiktoken.Encoding(p, pat_str=p, mergeable_ranks=one_byte, special_tokens={})) for p, s in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t"))]
        self[code] = ord(next((stand_in for stand_in, of in self.classes if of.encode_ordinary(chr(code))), "!"))
        return self[code]


_ranks: dict[str, Ranks] = KEPT.setdefault("ranks", {})


def ranks_of(path: str) -> Ranks:
    """This worker's vocabulary of a file."""
    if path not in _ranks:
        _ranks[path] = Ranks(path)
    return _ranks[path]


def _segments(text: str) -> Iterator[str]:
    """Parts of a long text, cut between a mark or letter and a blank, over which no pre-token reaches."""
    a = 0
    while len(text) - a > SEGMENT and (cut := _CUT.search(text, a + SEGMENT)):
        yield text[a : cut.end()]
        a = cut.end()
    yield text[a:]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in chunks(off, BATCH_BYTES):
                rows = texts.slice(a, b - a).to_pylist()
                ids = [b"".join(ranks.encode([part])[0] for part in _segments(rows[0]))] if len(rows) == 1 else ranks.encode(rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in batches:
            ids = pc.fill_null(batch.column("ids"), b"")
            lengths = pc.binary_length(ids).to_numpy(zero_copy_only=False)
            for a, b in chunks(np.append(0, np.cumsum(lengths.astype(np.int64))), BATCH_BYTES):
                spelt = [ranks.decode(x) for x in ids.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "ids")), pa.array(spelt, pa.binary())], ["doc_id", "ids", "spelt"])

    return run


def _both(path: str):
    return lambda batches: _decode(path)(_encode(path)(batches))


def _texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_texts(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (binary: little-endian unsigned 32-bit ids, one after the other).

    ``ranks`` is a path of a rank file, readable on every executor, that has
    every single byte.  Ids are those of the encoding library for the whole
    text without special tokens: each match of the published pattern is encoded
    by itself.  A null or empty text has no ids; ids of documents may repeat or
    be null and are passed on; other columns are ignored; an empty table gives
    no rows.  Texts are encoded whole, a long one in segments of some million
    characters by one task; a pre-token of n bytes takes some n log n steps
    unless all of it depends on its first bytes, and n log² n at most.
    """
    return _texts(docs, id_col, text_col).mapInArrow(tidy(_encode(ranks), "ranks"), "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, ranks: str) -> DataFrame:
    """The rows (doc_id, ids) of :func:`encode_texts` with ``spelt``, the bytes the ids stand for.

    Null ids count as none.  An id that the file doesn't have is an error.
    """
    return encoded.select("doc_id", "ids").mapInArrow(tidy(_decode(ranks), "ranks"), "doc_id long, ids binary, spelt binary")


def round_trip(docs: DataFrame, ranks: str, **columns: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens, and SHA-256 of the packed ids and of the bytes they decode to (lowercase hex).

    The rows of :func:`decode_ids` of :func:`encode_texts`, but a task does both
    in one worker.  Two operators in a row have two workers a task, which change
    places from task to task, so that in the end each holds the tables of the encoder.
    """
    spelt = _texts(docs, **columns).mapInArrow(tidy(_both(ranks), "ranks"), "doc_id long, ids binary, spelt binary")
    n_tokens = F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens")
    return spelt.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("spelt", 256).alias("decoded_sha256"))
