"""Language identification: multinomial naive Bayes over hashed character n-grams.

The matrix of log probabilities has a row a language and a column a bucket.
Up to 256 languages share 65,536 buckets; beyond, the buckets are halved until
the matrix has at most ``MATRIX`` numbers, but never below 1,024, so any number
of languages is learnt and the broadcast stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrowkit import annotate, field, list_array, list_values, tidy
from tessera.llm.shared import materialise, parts
from tessera.llm.wordhash import chunks, text_buffer

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MATRIX = 1 << 24
BLOCK = 1024
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code point -> itself for letters, a space for anything else."""
    global _letters
    if _letters is None:
        _letters = np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], dtype=np.uint32)
    return _letters


def buckets_for(languages: int) -> int:
    """Number of hash buckets, a power of two."""
    buckets = BUCKETS
    while buckets > BLOCK and buckets * languages > MATRIX:
        buckets //= 2
    return buckets


def ngram_buckets(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order (buckets, starts of the documents, numbers of letters); each document is padded by a space."""
    lowered = [f" {t.lower()} " for t in texts]
    lengths = np.array([len(t) for t in lowered])
    points = _letter_table()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    start = np.cumsum(lengths) - lengths
    letters = np.add.reduceat((points != 32).astype(np.int64), start)
    h = np.zeros(len(points), dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        # The gram that ends at i; those at a document's first places reach into its neighbour and go to the padding's bucket.
        h = (np.concatenate((h[:1] * 0, h[:-1])) + points) * np.uint32(0x9E3779B1) if order > 1 else points * np.uint32(0x9E3779B1)
        if order in ORDERS:
            bucket = (((h ^ np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)) >> np.uint32(33 - buckets.bit_length())).astype(np.int64)
            for j in range(order - 1):
                at = start + j
                bucket[at[j < lengths]] = 0
            yield bucket, start, letters


def _train(buckets: int):
    """Rows (lang, block, counts) of what a task has read; the last block of a language holds its number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            texts, langs = batch.column("text"), batch.column("lang").to_pylist()
            for a, b in chunks(off):
                names = langs[a:b]
                codes = {n: i for i, n in enumerate(dict.fromkeys(names))}
                code = np.array([codes[n] for n in names])
                for n in names:
                    docs[n] = docs.get(n, 0) + 1
                for bucket, start, _ in ngram_buckets(texts.slice(a, b - a).to_pylist(), buckets):
                    owner = np.repeat(code, np.diff(np.append(start, len(bucket))))
                    found = np.bincount(owner * buckets + bucket, minlength=len(codes) * buckets).reshape(-1, buckets)
                    for n, i in codes.items():
                        counts[n] = counts.get(n, 0) + found[i]
        for n, row in counts.items():
            blocks = np.append(row, [docs[n], *[0] * (BLOCK - 1)])
            many = len(blocks) // BLOCK
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * many), pa.array(range(many), pa.int32()), list_array(blocks, np.arange(many + 1) * BLOCK, pa.int64())], ["lang", "block", "counts"]
            )

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        flat, _ = list_values(batch.column("counts"))
        for key, row in zip(zip(batch.column("lang").to_pylist(), batch.column("block").to_pylist(), strict=True), flat.reshape(-1, BLOCK), strict=True):
            held[key] = held[key] + row if key in held else row.copy()
    for (lang, block), row in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([block], pa.int32()), list_array(row, np.array([0, BLOCK]), pa.int64())], ["lang", "block", "counts"])


class Model:
    """Languages, log priors and log probabilities (languages x buckets)."""

    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray):
        self.languages, self.buckets = languages, counts.shape[1]
        smooth = counts + SMOOTHING
        self.logp = (np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))).astype(np.float32)
        self.prior = np.log(docs / docs.sum())


def fit(docs: DataFrame) -> Model | None:
    """Counts of all rows (text, lang) without nulls, summed per task and then per language and block of buckets.

    The driver gets the finished matrix, of at most MATRIX numbers up to 16,384 languages and 1,024 a language beyond.
    """
    rows = docs.filter("text is not null and lang is not null").select("text", "lang")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())  # one row a language
    if not languages:
        return None
    buckets = buckets_for(len(languages))
    found = rows.mapInArrow(tidy(_train(buckets)), "lang string, block int, counts array<long>")
    summed = materialise(found.repartition(parts(docs.sparkSession), "lang", "block").mapInArrow(tidy(_add_up), found.schema), "langcounts")
    matrix = np.zeros((len(languages), buckets + BLOCK), dtype=np.int64)
    at = {n: i for i, n in enumerate(languages)}
    for r in summed.toLocalIterator():
        matrix[at[r.lang], r.block * BLOCK : (r.block + 1) * BLOCK] = r.counts
    return Model(languages, matrix[:, :buckets], matrix[:, buckets])


def _predict(model, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for batch in batches:
            column = field(batch, text)
            _, off = text_buffer(column)
            texts = pc.fill_null(column, "")
            for a, b in chunks(off):
                n = b - a
                total = np.tile(m.prior, (n, 1)) if m else np.zeros((n, 1))
                letters = np.zeros(n)
                for bucket, start, letters in ngram_buckets(texts.slice(a, n).to_pylist(), m.buckets if m else BUCKETS):
                    for i in range(len(m.languages) if m else 0):
                        total[:, i] += np.add.reduceat(m.logp[i][bucket], start, dtype=np.float64)
                best = total.argmax(axis=1)
                odds = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                known = (letters > 0) & (m is not None)
                names = np.array(m.languages if m else [UNKNOWN], dtype=object)
                lang = np.where(known, names[best], UNKNOWN)
                kept = [batch.column(c).slice(a, n) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(np.where(known, odds, 0.0))], [*keep, "lang_pred", "score"])

    return run


def _taught(docs: DataFrame, hold_out: tuple[int, int], id_col: str, text_col: str, lang_col: str):
    """(the model's broadcast, whether a row is held out)."""
    mod, rest = hold_out
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(True))
    rows = docs.filter(~held).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return docs.sparkSession.sparkContext.broadcast(fit(rows)), held


def identify(docs: DataFrame, hold_out: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from text and language of the rows with both whose crc32(id as
    text) mod ``hold_out[0]`` is not ``hold_out[1]``; a row with a null id
    counts as held out.  score is the posterior probability of lang_pred; a
    text that is null or has no letter gets ``und`` and score 0, and so does
    every text if there is nothing to learn from.  Ties go to the language
    first in the alphabet.  Any number of languages is learnt (see
    :func:`buckets_for`).  Texts are read whole; a very long one is held in
    memory by the one task that scores it, at some 50 bytes a character.  Ids
    may repeat; other columns are ignored; an empty table gives no rows.
    """
    model, held = _taught(docs, hold_out, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    return rows.mapInArrow(tidy(_predict(model, "text", ["doc_id", "held_out"])), "doc_id long, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, least_score: float, hold_out: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language :func:`identify` tells with a score of ``least_score`` or more.

    Each row is judged by its own text, so rows that share an id, or have none, don't decide about each other.
    """
    model, _ = _taught(docs, hold_out, id_col, text_col, lang_col)
    judged = annotate(docs, _predict(model, text_col, ["row"]), [text_col], "lang_pred string, score double")
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
