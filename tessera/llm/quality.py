"""Quality rules with thresholds learned per language and source from quantile sketches.

A sketch counts the values of a metric by logarithmic bins (1 % wide), so it is
mergeable, holds every quantile to the bin, and is the same in every run.  A
group's sketch is blended with its language's and that with all documents',
so small groups lean on larger ones without a switch at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrowkit import tidy
from tessera.llm.shared import materialise
from tessera.llm.wordhash import Words, chunks, mix, span_hashes, text_buffer

# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeats(h: np.ndarray, count: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each document that lie in a 3-word window found at least twice in it."""
    out = np.zeros(len(count), dtype=np.int64)
    if len(h) < 3:
        return out
    grams = mix(h[:-2] * np.uint64(3) + mix(h[1:-1]) * np.uint64(5) + mix(mix(h[2:])))
    for d in np.flatnonzero(count > 3):
        g = grams[bounds[d] : bounds[d + 1] - 2]
        order = np.argsort(g)
        same = g[order[1:]] == g[order[:-1]]
        if same.any():
            covered = np.zeros(count[d], dtype=bool)
            twice = np.concatenate((order[1:][same], order[:-1][same]))
            for j in range(3):
                covered[twice + j] = True
            out[d] = covered.sum()
    return out


def _line_counts(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and how many of them equal an earlier line."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    end = np.append(start[1:], len(data))
    newline = data[end - 1] == 10
    with_word = np.diff(np.append(np.searchsorted(words.start, start), len(words))) > 0
    doc = np.searchsorted(offsets, start, side="right") - 1
    h = span_hashes(data, start, end - newline)
    doc, h = doc[with_word], h[with_word]
    order = np.lexsort((h, doc))
    again = np.append(False, (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1]))
    return np.bincount(doc, minlength=n), np.bincount(doc[order][again], minlength=n)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_buffer(batch.column("text"))
        for a, b in chunks(off):
            raw, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
            words = Words(raw, o)
            sums = lambda x: np.diff(np.append(0, np.cumsum(x))[o])
            inside = np.zeros(len(raw) + 1, dtype=np.int64)
            np.add.at(inside, words.start, 1)
            np.add.at(inside, words.end, -1)
            chars = np.cumsum(inside)[:-1] * ((raw & 0xC0) != 0x80)
            lines, again = _line_counts(raw, o, words)
            repeat = _repeats(words.hashes(lower=False), words.count, words.bounds)
            numbers = [words.count, sums(chars), sums(_SYMBOL[raw]), lines, again, repeat]
            kept = [batch.column(c).slice(a, b - a) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in numbers)], ["doc_id", "lang", "source", *_COUNTS])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, lang, source and the counts the rules use.

    n_words, word_chars (characters in words), n_symbols, n_lines (lines with a
    word), n_dup_lines (such lines equal to an earlier one) and n_repeat_words
    (words in a 3-word window found twice or more).  A null text counts as empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return rows.mapInArrow(tidy(_features), f"doc_id long, lang string, source string, {counts}")


#: Each metric's numerator and denominator.
RATIOS = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
METRICS = {m: f"{n} / nullif({of}, 0)" for m, (n, of) in RATIOS.items()}
#: Metrics that count faults, with the most of them that are let pass in any text: one of each kind, or one repeated window.
SPARED = {"symbols": 2, "dup_lines": 1, "repeats": 6}
BIN = 1.01  # ratio of a bin's edges
ZERO = -100_000  # the bin of 0, below every other


def with_metrics(feats: DataFrame) -> DataFrame:
    return feats.withColumns({m: F.expr(e) for m, e in METRICS.items()})


def _keyed(df: DataFrame) -> DataFrame:
    """lang and source as keys that tell a null from an empty string."""
    return df.withColumns({c: F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("lang", "source")})


def quantile(bins: np.ndarray, weights: np.ndarray, q: float) -> int:
    """The bin (ascending) in which the share ``q`` of the weight is reached."""
    total = np.cumsum(weights)
    return int(bins[min(int(np.searchsorted(total, q * total[-1] * (1 - 1e-12))), len(bins) - 1)])


def fence(sketches: list[tuple[np.ndarray, np.ndarray]], fences: float, prior_docs: float) -> tuple[float, float]:
    """(low, high) of a metric, from the sketches of a group, of its language and of all documents.

    A level weighs as many documents as it has, the one above it ``prior_docs``.
    The fences lie ``fences`` spreads beyond the quartiles.  The spread on a
    side is the longest of the interquartile range, the way from the median to
    the outer tenth, and the mean of what lies beyond the quartile.  The last is
    above 0 as soon as any value is, and weighs values by their share: a metric
    that is 0 for most has a fence above 0.
    """
    bins = np.unique(np.concatenate([b for b, _ in sketches]))
    blend = np.zeros(len(bins))
    for b, n in reversed(sketches):
        above = blend / blend.sum() * prior_docs if blend.any() else blend
        blend = above + np.bincount(np.searchsorted(bins, b), weights=n, minlength=len(bins))
    at = [quantile(bins, blend, q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]
    edge = lambda b: np.where(b == ZERO, 0.0, BIN ** np.where(b == ZERO, 0.0, b).astype(float))
    low, high = edge(np.where(np.array(at) == ZERO, ZERO, np.array(at) - 1)), edge(np.array(at))
    between = lambda i, j: max(high[j] - low[i], 0.0) if at[i] != at[j] else 0.0
    beyond = lambda far: float(np.average(np.maximum(far, 0.0), weights=blend))
    middle, value = between(1, 3), edge(bins)
    below, above = max(middle, between(0, 2), beyond(low[1] - value)), max(middle, between(2, 4), beyond(value - high[3]))
    return float(low[1] - fences * below) * (1 - 1e-9), float(high[3] + fences * above) * (1 + 1e-9)


def thresholds(feats: DataFrame, fences: float = 3.0, prior_docs: float = 50.0) -> DataFrame:
    """Rows (lang, source, and low and high of each metric), lang and source as :func:`_keyed` has them."""
    known = _keyed(with_metrics(feats)).select("lang", "source", F.expr(f"stack({len(METRICS)}, {', '.join(f'{chr(39)}{m}{chr(39)}, {m}' for m in METRICS)}) as (metric, value)"))
    bins = F.when(F.col("value") == 0, ZERO).otherwise(F.ceil(F.log("value") / float(np.log(BIN)))).cast("int")
    own = known.filter("value is not null").groupBy("lang", "source", "metric", bins.alias("bin")).agg(F.count("*").alias("n"))
    own = materialise(own, "sketches")

    def sketch(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        """One row a group: its bins, of which a metric's range bounds the number."""
        return df.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias(name))

    every = F.broadcast(sketch(own, ["metric"], "all"))  # a row a metric
    levels = sketch(own, ["lang", "source", "metric"], "own").join(sketch(own, ["lang", "metric"], "language"), ["lang", "metric"]).join(every, "metric")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("own", "language", "all")]
            flat = [(c.values.field("bin").to_numpy(), c.values.field("n").to_numpy(), np.asarray(c.offsets)) for c in columns]
            rows = [fence([(b[o[i] : o[i + 1]], n[o[i] : o[i + 1]]) for b, n, o in flat], fences, prior_docs) for i in range(batch.num_rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "source", "metric")), *(pa.array(x, pa.float64()) for x in zip(*rows, strict=True))], ["lang", "source", "metric", "low", "high"])

    fenced = levels.select("lang", "source", "metric", "own", "language", "all").mapInArrow(tidy(found), "lang string, source string, metric string, low double, high double")
    sides = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in METRICS for side in ("low", "high")]
    return fenced.groupBy("lang", "source").agg(*sides)


def judge(docs: DataFrame, fences: float = 3.0, prior_docs: float = 50.0, **columns: str) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, kept and the metrics that failed it.

    base_failed: fewer than 50 words, or more than half of the words in
    repeated 3-word windows.  kept: not base_failed, and no metric outside the
    thresholds of the row's language and source; a null is a value of its own,
    other than the empty string.  A metric that counts faults isn't above its
    threshold for so few of them as ``SPARED`` says, whatever others do.
    ``fences`` and ``prior_docs`` are those of :func:`fence`.  Null and empty texts have no words and fail.  Ids may repeat
    or be null; other columns are ignored; an empty table gives no rows.  Texts
    are read whole, a very long one by one task at some 60 bytes a character.
    Two runs over the same rows give the same result, however they are dealt.
    """
    feats = materialise(features(docs, **columns), "features")
    known = materialise(thresholds(feats, fences, prior_docs), "thresholds")
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    above = {m: (F.col(m) > F.col(f"{m}_high")) & (F.col(n) > SPARED.get(m, 0)) for m, (n, _) in RATIOS.items()}
    outside = [F.when((F.col(m) < F.col(f"{m}_low")) | above[m], F.lit(m)) for m in METRICS]
    judged = _keyed(with_metrics(feats)).join(known, ["lang", "source"], "left").withColumns({"base_failed": base, "failed": F.concat_ws(",", *outside)})
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")
