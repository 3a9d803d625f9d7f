"""Language-model scores by a hidden Markov model over word classes.

Every word has a class, a hash of its last three bytes.  A text's
probability is that of its class sequence and an end sign under the hidden
Markov model, times that of each word within its class, (c + 1) / (C + V + 1)
with c, C and V the counts of the word, of its class's tokens and of its class's
distinct words in the training texts; unseen words of a class share one place.

* Word counts cover all training tokens.  The most frequent words, at most
  ``FREQUENT`` of them, are broadcast with their counts, and each text adds up
  its own; only the rest of its words, none of which is frequent, is shuffled
  to meet the counts.  So no word fills a task, however common it is.
* Baum-Welch rounds run over all training texts, each as one sequence whatever
  its length; a task returns expected counts of fixed size, and these are
  added up across tasks.
* Scores come from the scaled forward recursion over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrowkit import list_array, list_values, tidy
from tessera.llm.shared import materialise
from tessera.llm.wordhash import _LOWER, Words, chunks, mix, text_buffer

CLASSES = 4096
END = CLASSES
STATES = 8
ROUNDS = 4
SEEDS = 400
FREQUENT = 1 << 17
HELD_WORDS = 2_000_000  # most distinct words that a task holds before it sends their counts on
BLOCK = 256  # steps of a recursion that are in memory at once
GROUP_ROWS, GROUP_WORDS, LONG = 3000, 1_500_000, 2048


def word_classes(words: Words) -> np.ndarray:
    """A class for each word, from its last three bytes in lower case (fewer, if it is shorter)."""
    low = _LOWER[words.data].astype(np.uint64)
    tail = np.zeros(len(words), dtype=np.uint64)
    for j in (1, 2, 3):
        at = words.end - j
        tail = tail * np.uint64(256) + np.where(at >= words.start, low[np.maximum(at, 0)] if len(low) else np.uint64(0), np.uint64(0))
    return (mix(tail) % np.uint64(CLASSES)).astype(np.uint16)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, class, learnt, total): tokens of each word in the training texts and in all, of what the task has read."""
    held: list[np.ndarray] = []
    rows = 0

    def merged() -> np.ndarray:
        word, cls, learnt, total = np.concatenate(held, axis=1)
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(word[order]) != 0))
        return np.stack([word[order][first], cls[order][first], np.add.reduceat(learnt[order], first), np.add.reduceat(total[order], first)])

    def out(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, found.shape[1], 100_000):
            columns = [pa.array(np.ascontiguousarray(c[a : a + 100_000])) for c in found]
            yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.int32()), *columns[2:]], ["word", "class", "learnt", "total"])

    for batch in batches:
        data, off = text_buffer(batch.column("text"))
        trained = ~np.asarray(batch.column("held_out"))
        for a, b in chunks(off):
            words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
            if not len(words):
                continue
            word, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
            learnt = np.bincount(inverse, weights=trained[a:b][words.doc], minlength=len(word)).astype(np.int64)
            held.append(np.stack([word.view(np.int64), word_classes(words)[first].astype(np.int64), learnt, np.bincount(inverse)]))
            rows += len(word)
            if rows >= 2 * HELD_WORDS:
                held = [merged()]
                rows = held[0].shape[1]
                if rows >= HELD_WORDS:
                    yield from out(held[0])
                    held, rows = [], 0
    if held:
        yield from out(merged())


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes ascending, their training counts) of the words found in any text at least so often that there are ``most`` or fewer."""
    level = F.floor(8 * F.log2("total")).alias("level")
    levels = sorted(counts.groupBy(level).agg(F.count("*").alias("n")).collect(), reverse=True)  # some hundreds
    least, held = None, 0
    for r in levels:
        held += r.n
        if held > most:
            break
        least = r.level
    found = counts.filter(level >= least).select("word", "learnt").collect() if least is not None else []
    words, learnt = np.array([r.word for r in found], np.int64).view(np.uint64), np.array([r.learnt for r in found], np.int64)
    order = np.argsort(words)
    return words[order], learnt[order]


def _sequences(frequent):
    """Rows (doc_id, held_out, symbols, n_tokens, sum_log, n_known, rare, times): what frequent words add, and the other words with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, learnt = frequent.value
        logs = np.log10(learnt + 1.0)
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for a, b in chunks(off):
                n = b - a
                words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                h, doc = words.hashes(), words.doc
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                common = known[at] == h if len(known) else np.zeros(len(h), bool)
                inside, of = at[common], doc[common]
                sums = np.bincount(of, weights=logs[inside], minlength=n).astype(np.float64)
                seen = np.bincount(of, weights=learnt[inside] > 0, minlength=n).astype(np.int64)
                rare, owner = h[~common], doc[~common]
                order = np.lexsort((rare, owner))
                rare, owner = rare[order], owner[order]
                first = np.flatnonzero(np.append(True, (np.diff(rare) != 0) | (np.diff(owner) != 0))) if len(rare) else np.zeros(0, np.int64)
                bounds = np.searchsorted(owner[first], np.arange(n + 1))
                raw = word_classes(words).astype("<u2").tobytes()
                symbols = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * words.bounds).astype(np.int32).tobytes()), pa.py_buffer(raw)])
                kept = [batch.column(c).slice(a, n) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept,
                        symbols,
                        pa.array(words.count.astype(np.int64) + 1),
                        pa.array(sums),
                        pa.array(seen),
                        list_array(rare[first].view(np.int64), bounds, pa.int64()),
                        list_array(np.diff(np.append(first, len(rare))), bounds, pa.int64()),
                    ],
                    ["doc_id", "held_out", "symbols", "n_tokens", "sum_log", "n_known", "rare", "times"],
                )

    return run


class Hmm:
    """start (S), move (S x S) and emit (CLASSES + 1 x S) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        share = lambda x, a, axis: (x + a) / (x + a).sum(axis=axis, keepdims=True)
        return cls(share(start, 0.1, 0), share(move, 0.1, 1), share(emit, 0.02, 0))


def _split(symbols: pa.Array) -> list[np.ndarray]:
    """Class sequences with their end sign."""
    return [np.append(np.frombuffer(x, "<u2"), np.uint16(END)) for x in symbols.fill_null(b"").to_pylist()]


def groups(sequences: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sequences to be worked on together, of bounded size in all (or one longer one); long ones apart, since the longest sets the number of steps."""
    held: dict[bool, list[np.ndarray]] = {False: [], True: []}
    words = {False: 0, True: 0}
    for s in sequences:
        kind = len(s) > LONG
        held[kind].append(s)
        words[kind] += len(s)
        if len(held[kind]) >= GROUP_ROWS or words[kind] >= GROUP_WORDS:
            yield held[kind]
            held[kind], words[kind] = [], 0
    yield from filter(None, held.values())


def expected_counts(hmm: Hmm, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (start, move, emit) of whole sequences by scaled forward and backward recursions.

    BLOCK steps are in memory at once.  Of longer sequences a first pass keeps
    the forward values at the blocks' edges only, from which each block's are
    found again on the way back.
    """
    sequences = sorted(sequences, key=len, reverse=True)
    lengths = np.array([len(s) for s in sequences])
    flat, ends = np.concatenate(sequences), np.cumsum(lengths)
    first, last, steps, k = ends - lengths, ends - 1, int(lengths[0]), len(hmm.start)
    start, move, emit = (x.astype(np.float32) for x in (hmm.start, hmm.move, hmm.emit))
    back, ones = np.ascontiguousarray(move.T), np.ones(k, np.float32)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()

    def symbols(t0: int) -> np.ndarray:
        return flat[np.minimum(first[: active[t0]] + np.arange(t0, min(t0 + BLOCK, steps))[:, None], last[: active[t0]])]

    def forward(t0: int, alpha: np.ndarray | None, seen: np.ndarray, keep: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Forward values after a block; ``keep`` takes those of each step, and the scales."""
        for j in range(len(seen)):
            m = active[t0 + j]
            a = seen[j, :m] * start if alpha is None else (alpha[:m] @ move) * seen[j, :m]
            scale = a @ ones
            alpha = a / scale[:, None]
            if keep is not None:
                keep[0][j, :m], keep[1][j, :m] = alpha, scale
        return alpha

    begins = range(0, steps, BLOCK)
    edges: list[np.ndarray | None] = [None]
    for t0 in begins[:-1]:
        edges.append(forward(t0, edges[-1], emit[symbols(t0)]))
    starts, moves, emits, beta = None, np.zeros((k, k)), np.zeros((CLASSES + 1, k)), np.ones((len(sequences), k), np.float32)
    for t0, edge in zip(reversed(begins), reversed(edges), strict=True):
        symbol = symbols(t0)
        seen, n = emit[symbol], active[t0]
        alphas, scales = np.zeros_like(seen), np.ones(symbol.shape, np.float32)
        forward(t0, edge, seen, (alphas, scales))
        later = np.divide(seen, scales[:, :, None], out=seen)  # emission over scale, and below times the backward value
        betas = np.zeros_like(later)
        for j in range(len(symbol) - 1, -1, -1):
            m = active[t0 + j]
            betas[j, :m] = beta[:m]
            beta[:m] = (later[j, :m] * beta[:m]) @ back
        later *= betas
        if edge is not None:
            moves += edge[:n].T.astype(np.float64) @ later[0]
        for a in range(0, len(symbol) - 1, 32):  # a few steps at a time, summed in double
            b = min(a + 32, len(symbol) - 1)
            moves += alphas[a:b].reshape(-1, k).T.astype(np.float64) @ later[a + 1 : b + 1].reshape(-1, k)
        gamma = np.multiply(alphas, betas, out=alphas)
        emits += np.stack([np.bincount(symbol.ravel(), weights=gamma[:, :, j].ravel(), minlength=CLASSES + 1) for j in range(k)], axis=1)
        starts = gamma[0].sum(axis=0, dtype=np.float64)
    return starts, moves * hmm.move, emits


def forward_log10(hmm: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole sequence by the scaled forward recursion."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    flat, ends = np.concatenate([sequences[i] for i in order]), np.cumsum(lengths)
    first, total, ones = ends - lengths, np.zeros(len(order)), np.ones(len(hmm.start))
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()
    alpha = np.tile(hmm.start, (len(order), 1))
    for t, m in enumerate(active):
        alpha = (alpha[:m] if t == 0 else alpha[:m] @ hmm.move) * hmm.emit[flat[first[:m] + t]]
        scale = alpha @ ones
        alpha /= scale[:, None]
        total[:m] += np.log10(scale)
    out = np.empty(len(order))
    out[order] = total
    return out


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = [np.bincount(s[:-1], minlength=CLASSES) for s in _split(batch.column("symbols"))]
        if seen:
            yield pa.RecordBatch.from_arrays([list_array(np.concatenate(seen), np.arange(len(seen) + 1) * CLASSES, pa.int64())], ["seen"])


def _seed(seen: list[np.ndarray]) -> Hmm:
    """States that start from class shares of mutually distant texts out of a bounded sample."""
    seen = seen or [np.zeros(CLASSES)]
    root = np.array([np.sqrt(x / max(x.sum(), 1)) for x in seen])
    chosen = [int(np.argmax([x.sum() for x in seen]))]
    apart = 1 - root @ root[chosen[0]]
    while len(chosen) < STATES:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, 1 - root @ root[chosen[-1]])
    nearest = np.argmax(root @ root[chosen].T, axis=1)
    everyone = np.sum(seen, axis=0)
    emit = np.zeros((CLASSES + 1, STATES))
    for j in range(STATES):
        emit[:CLASSES, j] = sum((x for x, g in zip(seen, nearest, strict=True) if g == j), np.zeros(CLASSES))
    emit[:CLASSES] += 0.01 * (everyone[:, None] + 0.1) * (1 + 0.1 * np.arange(STATES))
    emit[END] = len(seen)
    return Hmm.from_counts(np.ones(STATES), np.full((STATES, STATES), 1.0) + 50 * np.eye(STATES), emit)


def _count_round(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, sums = model.value, None
        for group in groups(s for batch in batches for s in _split(batch.column("symbols"))):
            found = expected_counts(hmm, group)
            sums = found if sums is None else tuple(x + y for x, y in zip(sums, found, strict=True))
        if sums is not None:
            rows = np.vstack([sums[2].T, np.pad(np.vstack([sums[1], sums[0]]), ((0, 0), (0, CLASSES + 1 - STATES)))])
            lists = list_array(rows.ravel(), np.arange(len(rows) + 1) * (CLASSES + 1), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), lists], ["row", "counts"])

    return run


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        flat, _ = list_values(batch.column("counts"))
        for row, counts in zip(batch.column("row").to_pylist(), flat.reshape(-1, CLASSES + 1), strict=True):
            held[row] = held.get(row, 0) + counts
    for row, counts in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), list_array(counts, np.array([0, len(counts)]), pa.float64())], ["row", "counts"])


def train(sequences: DataFrame, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over all rows (row, symbols); SEEDS of them, chosen by a hash of their content, set where it starts."""
    spark = sequences.sparkSession
    chosen = [r.row for r in sequences.filter("length(symbols) > 0").select("row", F.xxhash64("symbols").alias("h")).orderBy("h", "row").limit(SEEDS).collect()]
    seen = sequences.filter(F.col("row").isin(chosen)).select("symbols").mapInArrow(tidy(_histograms), "seen array<long>").collect() if chosen else []
    hmm = _seed([np.array(r.seen) for r in sorted(seen)])
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(hmm)
        rows = sequences.select("symbols").mapInArrow(tidy(_count_round(model)), "row int, counts array<double>")
        summed = rows.repartition(2 * STATES + 1, "row").mapInArrow(tidy(_add_rows), rows.schema).collect()  # of fixed size
        if not summed:
            break
        counts = np.zeros((2 * STATES + 1, CLASSES + 1))
        for r in summed:
            counts[r.row] = r.counts
        hmm = Hmm.from_counts(counts[2 * STATES, :STATES], counts[STATES : 2 * STATES, :STATES], counts[:STATES].T)
    return hmm


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, room = model.value
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("symbols")), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(np.append(0, np.cumsum(lengths, dtype=np.int64)), 4 * GROUP_WORDS):
                sequences = _split(batch.column("symbols").slice(a, b - a))
                inner = np.array([room[s].sum() for s in sequences])
                score = forward_log10(hmm, sequences) - inner
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.array(score)], ["row", "sequence_score"])

    return run


def score_texts(docs: DataFrame, hold_out: tuple[int, int] = (7, 2), frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z lower-cased, cut at U+0020 and U+0009..U+000D) and
    one end.  Rows whose crc32(id as text) mod ``hold_out[0]`` is
    ``hold_out[1]`` are held out, and so are rows with a null id; the others
    train.  base_score sums log10((c + 1) / (N + V + 1)) over the tokens; score is
    the model's log10 probability of the text.  A null text is empty: its one
    token is the end.  Rows may repeat, and each counts; other columns are ignored;
    an empty table gives no rows.  A very long text is one sequence: its task
    holds its words (some 60 bytes a character while they are found) and
    BLOCK steps of its recursion.  ``frequent`` bounds the words that are
    broadcast and changes no result.
    """
    spark = docs.sparkSession
    mod, rest = hold_out
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    counted = rows.select("text", "held_out").mapInArrow(tidy(_word_counts), "word long, class int, learnt long, total long")
    counts = counted.groupBy("word").agg(F.min("class").alias("class"), F.sum("learnt").alias("learnt"), F.sum("total").alias("total"))
    counts = materialise(counts, "counts")
    tokens, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.groupBy("class").agg(F.sum("learnt").alias("t"), F.count_if(F.col("learnt") > 0).alias("k")).collect():  # of fixed size
        tokens[r["class"]], kinds[r["class"]] = r.t, r.k

    table = spark.sparkContext.broadcast(_frequent(counts, frequent))
    schema = "doc_id long, held_out boolean, symbols binary, n_tokens long, sum_log double, n_known long, rare array<long>, times array<long>"
    sequences = materialise(rows.mapInArrow(tidy(_sequences(table)), schema).withColumn("row", F.monotonically_increasing_id()), "sequences")
    ends = sequences.filter("not held_out").count()
    n, v = int(tokens.sum()) + ends, int(kinds.sum()) + (ends > 0)
    others = sequences.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.times")
    others = others.join(counts.select("word", "learnt"), "word")
    more = [F.sum(F.col("times") * F.log10(F.col("learnt") + 1)).alias("more_log"), F.sum(F.when(F.col("learnt") > 0, F.col("times")).otherwise(0)).alias("more_known")]
    others = others.groupBy("row").agg(*more)

    hmm = train(sequences.filter("not held_out").select("row", "symbols"))
    room = np.append(np.log10(tokens + kinds + 1.0), 0.0)
    scored = sequences.select("row", "symbols").mapInArrow(tidy(_score(spark.sparkContext.broadcast((hmm, room)))), "row long, sequence_score double")
    out = sequences.drop("symbols", "rare", "times").join(scored, "row").join(others, "row", "left")
    sum_log = F.col("sum_log") + F.coalesce("more_log", F.lit(0.0))
    known = F.col("n_known") + F.coalesce("more_known", F.lit(0)) + (1 if ends else 0)
    base = sum_log + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(n + v + 1))
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("sequence_score") + sum_log).alias("score"))
