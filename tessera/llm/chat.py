"""Chat formatting by token-level assembly.

A turn is <|turn|> role <|text|> text <|end|>.  The three marks are reserved
ids that no text encodes to; role and text are encoded apart from each other
and from the marks.  Control strings inside texts get a backslash after their
first character (as do those that have backslashes there already), which
:func:`unescape` undoes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrowkit import list_array, list_values, tidy
from tessera.llm.wordhash import chunks, text_buffer

# The marks of this template with their reserved ids, and other templates' control strings.
MARKS = {"<|turn|>": 50257, "<|text|>": 50258, "<|end|>": 50259}
CONTROLS = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TURN, TEXT, END = MARKS.values()

# The first character of a control string and the backslashes after it, where the rest of the string follows.
_AT = "|".join(f"{re.escape(f)}{{}}(?={'|'.join(re.escape(c[1:]) for c in CONTROLS if c[0] == f)})" for f in sorted({c[0] for c in CONTROLS}))
_ESCAPE = re.compile(_AT.replace("{}", r"\\*"))
_UNESCAPE = re.compile(_AT.replace("{}", r"\\+"))


def escape(text: str) -> str:
    """One more backslash after the first character of every control string, so that the text holds none."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


_encodings: dict[str, object] = {}


def encoding(path: str):
    """This worker's encoding of a byte-level rank file."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _ids(enc, text: str) -> np.ndarray:
    return enc.encode_to_numpy(escape(text), disallowed_special=()).astype(np.int32)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        marks = [np.array([x], np.int32) for x in (TURN, TEXT, END)]
        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            for a, b in chunks(off):
                part = batch.slice(a, b - a)
                roles = [_ids(enc, x or "") for x in part.column("role").to_pylist()]
                texts = [_ids(enc, x or "") for x in part.column("text").to_pylist()]
                flat = np.concatenate([x for r, t in zip(roles, texts, strict=True) for x in (marks[0], r, marks[1], t, marks[2])])
                head, body = (np.array([len(x) for x in xs], np.int64) for xs in (roles, texts))
                bounds = np.append(0, np.cumsum(head + body + 3))
                kept = [part.column(c) for c in ("conv_id", "own", "turn", "role")]
                yield pa.RecordBatch.from_arrays([*kept, list_array(flat, bounds, pa.int32()), pa.array(head + 2), pa.array(body)], ["conv_id", "own", "turn", "role", "ids", "head", "body"])

    return run


def format_turns(conversations: DataFrame, ranks: str, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, own, turn, ids, start, loss_from, loss_to.

    ``conversations`` has conv_id, turn, role and text; other columns are
    ignored.  A conversation's ids are its rows' ``ids`` in the order of
    ``start``, which is where each row's ids begin.  The loss mask covers
    positions loss_from..loss_to-1 of the conversation, the text of a turn whose
    role is in ``learn_roles`` (an empty span otherwise); positions are prefix
    sums of segment lengths in the order of turn, role and ids.  Null role and
    text count as empty.  A row with a null conv_id belongs to no other: it is
    a conversation of its own, told by ``own``, a hash of its content, so only
    rows equal in all count as one; ``own`` is null for all others.  Rows that
    repeat a turn follow each other; an empty table gives no rows.  Texts are
    encoded whole; a very long one is held by its task with its ids.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
    schema = "conv_id long, own long, turn long, role string, ids array<int>, head long, body long"
    parts = rows.mapInArrow(tidy(_encode(ranks)), schema)
    order = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce(F.sum(F.size("ids").cast("long")).over(order), F.lit(0)))
    begin = F.col("start") + F.col("head")
    end = F.when(F.coalesce("role", F.lit("")).isin(*learn_roles), begin + F.col("body")).otherwise(begin)
    return placed.select("conv_id", "own", "turn", "ids", "start", begin.alias("loss_from"), end.alias("loss_to"))


class _Digest:
    """Digests of one conversation, read back turn by turn from its ids and mask."""

    def __init__(self, conv_id: int | None, own: int | None):
        self.conv_id, self.own, self.turns, self.loss_chars, self.chars = conv_id, own, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, enc, ids: list[int], start: int, loss_from: int, loss_to: int) -> None:
        at = ids.index(TEXT)
        role, text = (enc.decode_bytes(x).decode() for x in (ids[1:at], ids[at + 1 : -1]))
        self.turns += 1
        self.chars += sum(map(len, MARKS)) + len(role) + len(text)
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        learnt = unescape(enc.decode_bytes(ids[loss_from - start : loss_to - start]).decode())
        self.loss_chars += len(learnt)
        self.loss.update(learnt.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(path: str):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, now = encoding(path), None
        for batch in batches:
            done = []
            keys = [batch.column(c).to_pylist() for c in ("conv_id", "own", "start", "loss_from", "loss_to")]
            ids, lengths = list_values(batch.column("ids"))
            for conv_id, own, start, loss_from, loss_to, n, end in zip(*keys, lengths, np.cumsum(lengths), strict=True):
                if now is None or (conv_id, own) != (now.conv_id, now.own):
                    done += [now.row()] if now else []
                    now = _Digest(conv_id, own)
                now.add(enc, ids[end - n : end].tolist(), start, loss_from, loss_to)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(now.row(), kinds, strict=True)], names)

    return run


def read_back(turns: DataFrame, ranks: str) -> DataFrame:
    """One row per conversation of :func:`format_turns`' output, with digests of what its ids and mask hold.

    A conversation's turns are read one after the other, however many it has.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return turns.repartition("conv_id", "own").sortWithinPartitions("conv_id", "own", "start").mapInArrow(tidy(_digests(ranks)), schema)
