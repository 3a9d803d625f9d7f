"""Toxicity scores: a learned lexicon, its Levenshtein automaton, and the words around each hit.

Terms are learnt from a bounded sample of labelled rows (the parameter
``sample_rows``).  Every term that passes the test of :func:`fit` is kept,
however many there are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrowkit import annotate, field, list_array, list_values, tidy
from tessera.llm.shared import materialise
from tessera.llm.wordhash import Words, chunks, mix, shingles, text_buffer

SAMPLE_ROWS = 10_000
LEAST_TOXIC = 5
LEAST_RATIO = 25
STEM_LETTERS = (4, 5, 6)
WINDOW = 6
MEMO = 400_000
MOST_STATES = 200_000
NEAR_SHARE = 0.5
MARKS = 16  # minima of a text's shingles by which near copies in the sample are told

# Marks and words of reported speech, which make a hit a quotation.
QUOTE_MARKS = "\"“”„«»‘’‚‹›"
REPORTING = frozenset(
    "said says say wrote writes quote quoted quotes called calls word term dit disait écrit cité mot appelé "
    "sagte sagt schrieb zitat zitiert wort nannte dijo dice escribió cita citado palabra llamó".split()
)
# Words of address, which make a hit an attack.
ADDRESS = frozenset("you your you're yourself tu toi te vous votre du dich dein ihr euch tú te usted vosotros eres es-tu".split())
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    return _EDGE.sub("", word)


class Automaton:
    """Levenshtein automaton of all lexicon terms at once, intersected with their trie.

    A state is the set of (trie node, errors so far); the table of states is
    built as words ask for it, and anew beyond ``MOST_STATES``.  A whole term matches a whole word; a stem
    matches any word that starts with it.  ``match`` gives (errors, ends) or
    None; one error is allowed in terms of five letters or more, two in terms of
    ten or more.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word_errors, self.stem_errors = [-1], [-1]
        self.budget = [0]
        for term, ends in [*((w, self.word_errors) for w in words), *((s, self.stem_errors) for s in stems)]:
            allowed = (len(term) >= 5) + (len(term) >= 10)
            at = 0
            self.budget[0] = max(self.budget[0], allowed)
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word_errors.append(-1)
                    self.stem_errors.append(-1)
                    self.budget.append(0)
                at = self.next[at][c]
                self.budget[at] = max(self.budget[at], allowed)
            ends[at] = max(ends[at], allowed)
        self._begin()

    def _begin(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.word_hit: list[int] = []
        self.stem_hit: list[int] = []
        self.start = self._state({0: 0})

    def _state(self, errors: dict[int, int]) -> int:
        todo = list(errors.items())
        while todo:  # letters of the term that the word leaves out
            node, e = todo.pop()
            if e > errors[node]:
                continue
            for child in self.next[node].values():
                if e < self.budget[child] and e + 1 < errors.get(child, 99):
                    errors[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(errors.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            for hits, ends in ((self.word_hit, self.word_errors), (self.stem_hit, self.stem_errors)):
                hits.append(min((e for n, e in key if e <= ends[n]), default=-1))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        errors: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.next[node].items():
                cost = e + (letter != c)
                if cost <= self.budget[child] and cost < errors.get(child, 99):
                    errors[child] = cost
            if e < self.budget[node] and e + 1 < errors.get(node, 99):
                errors[node] = e + 1
        to = self._state(errors) if errors else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        if len(self.sets) > MOST_STATES:
            self._begin()
        state, stem = self.start, -1
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
            if (hit := self.stem_hit[state]) >= 0:
                stem = hit if stem < 0 else min(stem, hit)
        whole = self.word_hit[state] if state >= 0 else -1
        if whole >= 0 and (stem < 0 or whole <= stem):
            return whole, "word"
        return (stem, "stem") if stem >= 0 else None


FEATURES = ("exact", "exact_quoted", "near", "near_quoted", "near_stem", "addressed", "density")


class Scorer:
    """Features of texts by one lexicon; keeps what it found out about words, within a bound."""

    def __init__(self, words: list[str], stems: list[str]):
        self.automaton = Automaton(words, stems)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[int, str]] = {}

    def _look_up(self, word: str) -> tuple[int, str] | None:
        if len(self.clean) + len(self.hits) > MEMO:
            self.clean, self.hits = set(), {}
        found = self.automaton.match(bare(word))
        if found is None:
            self.clean.add(word)
        else:
            self.hits[word] = found
        return found

    def features(self, text: str) -> list[float]:
        words = text.lower().split()
        clean, out = self.clean, dict.fromkeys(FEATURES, 0.0)
        for i in [i for i, w in enumerate(words) if w not in clean]:
            found = self.hits.get(words[i]) or self._look_up(words[i])
            if found is None:
                continue
            errors, ends = found
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted = any(w[:1] in QUOTE_MARKS or w[-1:] in QUOTE_MARKS or bare(w) in REPORTING for w in around)
            kind = "exact" if errors == 0 else "near_stem" if ends == "stem" else "near"
            out[kind + "_quoted" if quoted and kind != "near_stem" else kind] += 1
            out["addressed"] += (not quoted) and errors == 0 and any(bare(w) in ADDRESS for w in around)
        out["density"] = 20 * out["exact"] / (len(words) + 20)
        out["exact"] += NEAR_SHARE * out["near"]  # so near ones weigh something before any were seen in labelled texts
        return [float(np.log1p(out[f])) for f in FEATURES]


class Model:
    """Lexicon and logistic weights; plain data that a broadcast carries."""

    def __init__(self, words: list[str], stems: list[str], weights: np.ndarray):
        self.words, self.stems, self.weights = words, stems, weights


_scorers: dict[tuple, Scorer] = {}


def _scorer(words: list[str], stems: list[str]) -> Scorer:
    key = (tuple(words), tuple(stems))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(words, stems)
    return _scorers[key]


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest shingle hash of each text, which near copies tend to share, and the minima of MARKS rehashes; drops wordless texts."""
    seeds = mix(np.arange(1, MARKS + 1, dtype=np.uint64))
    for batch in batches:
        data, off = text_buffer(batch.column("text"))
        for a, b in chunks(off):
            values, bounds = shingles(Words(data[off[a] : off[b]], off[a : b + 1] - off[a]))
            some = np.flatnonzero(np.diff(bounds))
            if not len(some):
                continue
            marks = np.stack([np.minimum.reduceat(mix(values ^ s), bounds[some]) for s in seeds], axis=1)
            kept = [batch.column(c).slice(a, b - a).take(pa.array(some)) for c in ("doc_id", "text", "toxic")]
            key = pa.array(values[bounds[some]].view(np.int64))
            lists = list_array(marks.ravel().view(np.int64), np.arange(len(some) + 1) * MARKS, pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, key, lists], ["doc_id", "text", "toxic", "key", "marks"])


def _unlike(group: pa.Table) -> pa.Table:
    """Of rows of one class with one smallest shingle: those that aren't near copies of a kept one before them, by id.

    Near copies agree in 11 or more of 16 minima.  Texts that share no more than a header stay apart.
    """
    group = group.sort_by("doc_id")
    flat, _ = list_values(group.column("marks"))
    marks, kept = flat.reshape(-1, MARKS), []
    for i, row in enumerate(marks):
        if not kept or (marks[kept] == row).sum(axis=1).max() < 11:
            kept.append(i)
    return group.take(pa.array(kept)).select(["text", "toxic"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and stems of each document with its label, counted per batch."""
    for batch in batches:
        toxic, plain = defaultdict(int), defaultdict(int)
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {bare(w) for w in text.lower().split()}
            found = {(w, False) for w in words if len(w) > 2} | {(w[:n], True) for w in words for n in STEM_LETTERS if len(w) >= n}
            for t in found:
                (toxic if label else plain)[t] += 1
        keys = list(toxic.keys() | plain.keys())
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([toxic.get(k, 0) for k in keys], pa.int64()), pa.array([plain.get(k, 0) for k in keys], pa.int64())],
                ["term", "is_stem", "toxic", "plain"],
            )


def choose_terms(rows: list[tuple[str, bool, int]]) -> tuple[list[str], list[str]]:
    """(whole words, stems) out of telling terms (term, is_stem, documents).

    A stem takes the place of its words if it is found in clearly more
    documents than the most frequent of them; of stems that begin each other, the
    longest that keeps nine tenths of the documents stays.
    """
    words = {t: n for t, stem, n in rows if not stem}
    stems = {t: n for t, stem, n in rows if stem}
    heads = lambda t, most: [t[:n] for n in STEM_LETTERS if n <= most]
    longest: dict[str, int] = {}  # documents of the most frequent stem that is one letter longer
    for t, n in stems.items():
        longest[t[:-1]] = max(n, longest.get(t[:-1], 0))
    stems = {t: n for t, n in stems.items() if longest.get(t, 0) < 0.9 * n}
    stems = {t: n for t, n in stems.items() if not any(u in stems for u in heads(t, len(t) - 1))}
    best: dict[str, int] = {}
    for w, n in words.items():
        for t in heads(w, len(w)):
            best[t] = max(n, best.get(t, 0))
    stems = {t: n for t, n in stems.items() if n >= 1.2 * best.get(t, 0)}
    return sorted(w for w in words if not any(t in stems for t in heads(w, len(w)))), sorted(stems)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.append(0, np.ones(len(w) - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), bounded to ``sample_rows`` ids of each class.

    The ids are those with the smallest hashes, so the sample is the same
    whatever the partitioning; near copies within a class count once, lest the
    words of a copied document pass for telling ones, and texts without words
    don't count.  A term (a word, or the first 4 to 6 letters of words) is telling if
    LEAST_TOXIC toxic texts have it and its share among toxic texts, with half
    a text more on either side, is LEAST_RATIO times that among others; with as
    many texts of both classes that is 12 to none.  All telling terms are kept.
    Without rows of both classes the lexicon is empty and every score is the
    share of toxic labels (0.01 without any).
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for c in (1, 0)]
    chosen = materialise(sample[0].unionByName(sample[1]), "labelled")
    rows = docs.filter("text is not null").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample_rows rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.mapInArrow(tidy(_with_key), "doc_id long, text string, toxic int, key long, marks array<long>")
    rows = materialise(rows.groupBy("toxic", "key").applyInArrow(_unlike, "text string, toxic int"), "labelled")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = min(max(n1 / max(n1 + n0, 1), 0.01), 0.99)
        return Model([], [], np.append(np.log(share / (1 - share)), np.zeros(len(FEATURES))))
    counted = rows.mapInArrow(tidy(_terms), "term string, is_stem boolean, toxic long, plain long")
    counted = counted.groupBy("term", "is_stem").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    telling = counted.filter((F.col("toxic") >= LEAST_TOXIC) & ((F.col("toxic") + 0.5) / (n1 + 1) >= LEAST_RATIO * (F.col("plain") + 0.5) / (n0 + 1)))
    words, stems = choose_terms([(r.term, r.is_stem, r.toxic) for r in telling.collect()])  # of the sample's words only

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(words, stems)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(tidy(measure), "x array<double>, toxic int").collect()
    return Model(words, stems, fit_logistic(np.array([r.x for r in found]), np.array([r.toxic for r in found], float)))


def _score(model, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        scorer = _scorer(m.words, m.stems)
        for batch in batches:
            column = field(batch, text)
            _, off = text_buffer(column)
            texts = pc.fill_null(column, "")
            for a, b in chunks(off, 1 << 22):
                x = np.array([scorer.features(t) for t in texts.slice(a, b - a).to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(m.weights[0] + x @ m.weights[1:], -30, 30)))
                kept = [batch.column(c).slice(a, b - a) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return run


def _taught(docs: DataFrame, labels: DataFrame, hold_out: tuple[int, int], sample_rows: int, id_col: str, text_col: str):
    """(the model's broadcast, whether a row is held out)."""
    mod, rest = hold_out
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % mod != rest)
    return docs.sparkSession.sparkContext.broadcast(fit(rows, known, sample_rows)), held


def score_toxicity(docs: DataFrame, labels: DataFrame, hold_out: tuple[int, int] = (5, 0), sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    ``labels`` has the ids and ``toxic`` (0 or 1; other values and nulls are no
    label, of several labels of an id the largest counts).  Only ids whose
    crc32 as text mod ``hold_out[0]`` is not ``hold_out[1]`` are learnt from,
    and of these at most ``sample_rows`` of each class, chosen by a hash of the
    id and, where hashes tie, the id; a row with a null id counts as held out,
    and of several texts of an id the first in order is learnt from.  A null or
    empty text scores as a text without hits.  Texts are scored whole, a very
    long one by one task that holds it in memory as words.  Ids may repeat; other
    columns are ignored; an empty table gives no rows.
    """
    model, held = _taught(docs, labels, hold_out, sample_rows, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    return rows.mapInArrow(tidy(_score(model, "text", ["doc_id", "held_out"])), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, hold_out: tuple[int, int] = (5, 0), sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`score_toxicity` doesn't predict to be toxic, each judged by its own text."""
    model, _ = _taught(docs, labels, hold_out, sample_rows, id_col, text_col)
    return annotate(docs, _score(model, text_col, ["row"]), [text_col], "score double, predicted int").filter("predicted = 0").select("row.*")
