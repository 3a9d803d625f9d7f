"""Language ID, toxicity and the hidden Markov model: held-out results, exact parts and odd rows."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import sentence, table_of
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import hmm, langid, toxicity
from tessera.llm.wordhash import Words, text_buffer


@pytest.fixture(scope="module")
def labelled(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    return docs, spark.read.parquet(f"{medium}/labels.parquet")


def test_language_of_held_out_documents(labelled):
    docs, _ = labelled
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    known = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    assert set(got) == set(known) and all(r.held_out == brute.held_out(i, 4, 2) for i, r in got.items())
    with_letters = [i for i, (_, t) in known.items() if any(c.isalpha() for c in t or "")]
    assert all(got[i].lang_pred == "und" for i in set(known) - set(with_letters))
    tested = [i for i in with_letters if got[i].held_out and known[i][0]]
    assert len(tested) > 100 and np.mean([got[i].lang_pred == known[i][0] for i in tested]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_ignores_labels_of_held_out_rows(spark, labelled):
    docs, _ = labelled
    other = docs.withColumns({"lang": docs["lang"].substr(1, 0), "source": docs["source"]}).selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'zz', null) as l").join(docs.select("doc_id", "lang"), "doc_id").selectExpr("doc_id", "text", "coalesce(l, lang) as lang")
    one, two = ({(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(d).collect()} for d in (docs, other))
    assert one == two


def test_language_odd_rows(spark, odd, odd_rows, nothing):
    got = langid.identify(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in odd_rows)
    for r in got:
        if r.doc_id in (1, 2, 3, 11):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.identify(nothing).collect() == []
    unlabelled = table_of(spark, [(i, t, None, None) for i, t, *_ in odd_rows])
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_bayes_equals_brute_force(spark):
    rows = [(i, t, lang, None) for i, (t, lang) in enumerate([("abc abd", "x"), ("Abe", "x"), ("zzy zyx", "y"), ("yz", "y"), ("ab zy", None), ("b", None)] * 3)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(table_of(spark, rows)).collect()}

    def grams(text):
        """Buckets of 1- to 3-grams, written apart from the module."""
        letters = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
        out = []
        for n in langid.ORDERS:
            for i in range(len(letters)):
                h = 0
                for c in letters[max(i - n + 1, 0) : i + 1]:
                    h = (h + c) * 0x9E3779B1 % 2**32
                out.append(0 if i < n - 1 else ((h ^ n * 0x85EBCA6B % 2**32) * 0xC2B2AE35 % 2**32) * langid.BUCKETS >> 32)
        return out

    taught = [r for r in rows if r[2] and not brute.held_out(r[0], 4, 2)]
    counts = {lang: Counter(int(g) for r in taught if r[2] == lang for g in grams(r[1])) for lang in ("x", "y")}
    for i, text, *_ in rows:
        logs = []
        for lang, c in counts.items():
            total = sum(c.values()) + langid.SMOOTHING * langid.BUCKETS
            prior = math.log(sum(r[2] == lang for r in taught) / len(taught))
            logs.append((prior + sum(math.log((c[int(g)] + langid.SMOOTHING) / total) for g in grams(text)), lang))
        best = max(logs)
        assert got[i][0] == best[1] and abs(got[i][1] - 1 / sum(math.exp(x - best[0]) for x, _ in logs)) < 1e-3


def test_any_number_of_languages(spark):
    rows = [(4 * i + r, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} {chr(0x4E00 + i)}", f"lang{i:03}", None) for i in range(300) for r in range(4)]
    got = langid.identify(table_of(spark, rows)).collect()
    taught = {r[2] for r in rows if not brute.held_out(r[0], 4, 2)}
    known = {r[0]: r[2] for r in rows}
    assert len(taught) > 256 and langid.buckets_for(len(taught)) < langid.BUCKETS
    assert np.mean([r.lang_pred == known[r.doc_id] for r in got if known[r.doc_id] in taught]) > 0.97


def test_rows_are_kept_by_their_own_text(spark):
    rows = [(i, f"the {'cat dog bird'.split()[i % 3]} is here", "en", None) for i in range(40)] + [(i + 100, "der hund ist nicht dort", "de", None) for i in range(40)]
    rows += [(None, "the dog is here", None, None), (None, "123", None, None), (None, None, None, None), (7, "!!", None, None)]
    kept = langid.in_known_language(table_of(spark, rows), 0.5)
    assert kept.columns == table_of(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r[:2] for r in rows[:-3])


WORDS = st.text("abcde", min_size=1, max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), st.lists(st.text("abcde", min_size=4, max_size=6), max_size=2), WORDS)
def test_automaton_finds_what_edit_distance_finds(terms, stems, word):
    allowed = lambda t: (len(t) >= 5) + (len(t) >= 10)
    whole = min((d for t in terms if (d := brute.levenshtein(word, t)) <= allowed(t)), default=None)
    start = min((d for s in stems for n in range(len(word) + 1) if (d := brute.levenshtein(word[:n], s)) <= allowed(s)), default=None)
    best = min((x for x in (whole, start) if x is not None), default=None)
    found = toxicity.Automaton(terms, stems).match(word)
    assert (found[0] if found else None) == best


def plain_features(text, terms, stems):
    """The features of a text by edit distances, without automaton or memory."""
    split, out = text.lower().split(), dict.fromkeys(toxicity.FEATURES, 0.0)
    strip = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w)
    allowed = lambda t: (len(t) >= 5) + (len(t) >= 10)
    for i, w in enumerate(map(strip, split)):
        whole = min((d for t in terms if (d := brute.levenshtein(w, t)) <= allowed(t)), default=99)
        start = min((d for t in stems for n in range(len(w) + 1) if (d := brute.levenshtein(w[:n], t)) <= allowed(t)), default=99)
        if min(whole, start) == 99:
            continue
        around = split[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1]
        quoted = any(x[0] in toxicity.QUOTE_MARKS or x[-1] in toxicity.QUOTE_MARKS or strip(x) in toxicity.REPORTING for x in around)
        exact, stem = min(whole, start) == 0, start < whole
        name = "exact" if exact else "near_stem" if stem else "near"
        out[name + ("_quoted" if quoted and name != "near_stem" else "")] += 1
        out["addressed"] += not quoted and exact and any(strip(x) in toxicity.ADDRESS for x in around)
    out["density"] = 20 * out["exact"] / (len(split) + 20)
    out["exact"] += toxicity.NEAR_SHARE * out["near"]
    return [math.log1p(out[f]) for f in toxicity.FEATURES]


def test_scores_equal_features_and_weights(spark):
    """The lexicon by its definition, the features by edit distance, the score by the fitted weights."""
    rng = random.Random(14)
    bad, rows, labels = ["grobnik", "snarfling", "vlek", "mumpitzerei"], [], []
    for i in range(500):
        words = sentence(rng, 20).split()
        if i % 4 == 0:
            for w in rng.sample(bad, 2):
                words.insert(rng.randrange(20), rng.choice([w, w, w.upper(), f'"{w}"', w[:-1] + "x", f"you {w}"]))
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(i % 4 == 0)))
    docs, known = table_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, known).collect()}
    m = toxicity.fit(docs.select("doc_id", "text"), known.filter("crc32(cast(doc_id as string)) % 5 <> 0"))
    assert all(b in m.words or any(b.startswith(t) for t in m.stems) for b in bad) and not any(w[-1].isdigit() for w in m.words)
    for i, text, *_ in rows:
        x = m.weights[0] + float(np.dot(m.weights[1:], plain_features(text, m.words, m.stems)))
        assert abs(got[i] - 1 / (1 + math.exp(-x))) < 1e-9
    other = spark.createDataFrame([(i, 1 - t if brute.held_out(i, 5, 0) else t) for i, t in labels], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(docs, other).collect()} == got


def test_many_rare_terms_are_all_learnt(spark):
    """600 terms in 13 toxic texts each, far below a half per cent of them."""
    rng = random.Random(15)
    terms = [f"t{rng.randrange(10**6)}{'abcdefghij'[k % 10]}z" for k in range(600)]
    rows = [(i, f"{sentence(rng, 12)} {terms[i % 600]}" if i < 7800 else sentence(rng, 12), "en", "a") for i in range(15_600)]
    known = spark.createDataFrame([(i, int(i < 7800)) for i in range(15_600)], "doc_id long, toxic int")
    m = toxicity.fit(table_of(spark, rows).select("doc_id", "text"), known)
    assert all(t in m.words or any(t.startswith(x) for x in m.stems) for t in terms) and len(m.words) + len(m.stems) > 400


def test_texts_that_share_a_header_stay_apart():
    rng = random.Random(16)
    head = sentence(rng, 12)
    texts = [f"{head} {sentence(rng, 40)}" for _ in range(20)] + ["", "  "]
    texts += [texts[0] + " end", texts[0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([1] * len(texts), pa.int32())], ["doc_id", "text", "toxic"])
    keyed = pa.Table.from_batches(list(toxicity._with_key(iter([batch]))))
    assert len(keyed) == len(texts) - 2
    assert sorted(toxicity._unlike(keyed).column("text").to_pylist()) == sorted(texts[:20])


def test_rows_are_judged_by_their_own_text(spark):
    rng = random.Random(17)
    rows = [(i, f"{sentence(rng, 20)} {'you grobnik' if i % 2 else 'you friend'} {sentence(rng, 20)}", "en", "a") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    more = [(None, "you grobnik " * 3, None, None), (None, "you friend here", None, None), (None, None, None, None), (4, "you grobnik grobnik", None, None)]
    kept = Counter((r.doc_id, r.text) for r in toxicity.without_toxic(table_of(spark, rows + more), labels).collect())
    assert kept == Counter([r[:2] for r in rows if r[0] % 2 == 0] + [r[:2] for r in more[1:3]])


def auc(scores, labels):
    pairs = [(s, t) for s, x in zip(scores, labels, strict=True) if x for t, y in zip(scores, labels, strict=True) if not y]
    return np.mean([(s > t) + 0.5 * (s == t) for s, t in pairs])


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    assert all(r.held_out == brute.held_out(i, 5, 0) for i, r in got.items())
    tested = [i for i in known if i in got and got[i].held_out]
    assert len(tested) > 200
    assert auc([got[i].score for i in tested], [known[i] for i in tested]) >= 0.95
    assert np.mean([got[i].predicted == known[i] for i in tested]) >= 0.97
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_misspelt_terms_and_quotations(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"{sentence(rng, 30)} {'you are a grobnik' if bad else 'you are a friend'} {sentence(rng, 30)}", "en", "a"))
        labels.append((i, int(bad)))
    new = {9001: "you grobnlk leave " + sentence(rng, 30), 9002: "you grobnik leave " + sentence(rng, 30), 9003: sentence(rng, 40), 9004: ""}
    rows += [(i, t, None, None) for i, t in new.items()]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[9002] > 0.5 > got[9003] and got[9001] > got[9003] and got[9004] < 0.5
    scorer = toxicity.Scorer(["grobnik"], [])
    said = dict(zip(toxicity.FEATURES, scorer.features('he said "grobnik" to me'), strict=True))
    assert said["exact"] == 0 and said["exact_quoted"] > 0


def test_toxicity_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(6, 1), (7, 0), (None, 1), (8, None), (9, 5), (10, 0), (10, 1), (777, 1)], "doc_id long, toxic int")
    for df in (labels, labels.limit(0)):
        got = toxicity.score_toxicity(odd, df).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in odd_rows)
        assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(nothing, labels).collect() == []


def base_scores(rows):
    """doc_id -> (n_tokens, n_known, base score), and the number of training tokens."""
    count: Counter = Counter()
    for i, t in rows:
        if not brute.held_out(i, 7, 2):
            count.update([*brute.words(t), None])
    n, v = sum(count.values()), len(count)
    out = {}
    for i, t in rows:
        tokens = [*brute.words(t), None]
        out[i] = len(tokens), sum(count[w] > 0 for w in tokens), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
    return out, n


def test_scores_against_brute_force(documents, document_rows):
    got = {r.doc_id: r for r in hmm.score_texts(documents).collect()}
    expected, n = base_scores(document_rows)
    assert set(got) == set(expected)
    for i, (tokens, known, score) in expected.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, brute.held_out(i, 7, 2))
        assert abs(r.base_score - score) <= 1e-6 * abs(score)
    tested = [r for r in got.values() if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)


def test_scores_of_odd_rows(odd, odd_rows, nothing):
    got = hmm.score_texts(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in odd_rows)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert hmm.score_texts(nothing).collect() == []


def test_rare_words_meet_their_counts(documents, document_rows):
    """With no broadcast words, few and all of them the results are the same."""
    found = [{(r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in hmm.score_texts(documents, frequent=n).collect()} for n in (0, 50, hmm.FREQUENT)]
    assert found[0] == found[1] == found[2]


def test_a_word_of_every_text_is_not_shuffled(spark):
    counts = spark.createDataFrame([(w, 0, 1000 if w == 7 else 1, 1000 if w == 7 else 1) for w in range(100)], "word long, class int, learnt long, total long")
    words, learnt = hmm._frequent(counts, 10)
    assert words.tolist() == [7] and learnt.tolist() == [1000] and len(hmm._frequent(counts, 100)[0]) == 100


def test_scores_equal_a_plain_form(spark):
    """The whole score, with the model's own probabilities, by a recursion in plain Python; held-out texts don't change it."""
    rng = random.Random(12)
    rows = [(i, sentence(rng, rng.randrange(0, 40)), None, None) for i in range(60)]
    got = {r.doc_id: r.score for r in hmm.score_texts(table_of(spark, rows)).collect()}
    changed = [(i, t + " zebra zebra" if brute.held_out(i, 7, 2) else t, a, b) for i, t, a, b in rows]
    again = {r.doc_id: r.score for r in hmm.score_texts(table_of(spark, changed)).collect()}
    assert all(abs(again[i] - s) < 1e-6 * abs(s) for i, s in got.items() if not brute.held_out(i, 7, 2))

    def symbols(text):
        return hmm.word_classes(Words(*text_buffer(pa.array([text])))).tolist()

    taught = [t for i, t, *_ in rows if not brute.held_out(i, 7, 2)]
    stored = spark.createDataFrame([(k, b"".join(int(x).to_bytes(2, "little") for x in symbols(t))) for k, t in enumerate(taught)], "row long, symbols binary")
    m = hmm.train(stored)
    count = Counter(w for t in taught for w in brute.words(t))
    in_class, kinds = Counter(), Counter()
    for w, c in count.items():
        in_class[symbols(w)[0]] += c
        kinds[symbols(w)[0]] += 1
    for i, text, *_ in rows:
        log, alpha = 0.0, None
        for x in [*symbols(text), hmm.END]:
            alpha = [(m.start[j] if alpha is None else sum(alpha[k] * m.move[k, j] for k in range(hmm.STATES))) * m.emit[x, j] for j in range(hmm.STATES)]
            log += math.log10(sum(alpha))
            alpha = [a / sum(alpha) for a in alpha]
        for w, x in zip(brute.words(text), symbols(text), strict=True):
            log += math.log10((count[w] + 1) / (in_class[x] + kinds[x] + 1))
        assert abs(got[i] - log) < 1e-5 * max(abs(log), 1)


@pytest.fixture()
def model():
    rng = np.random.default_rng(1)
    share = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    s = hmm.STATES
    return hmm.Hmm(share(rng.random(s), 0), share(rng.random((s, s)), 1), share(rng.random((hmm.CLASSES + 1, s)), 0))


def test_forward_is_the_sum_over_all_paths(model):
    sequences = [np.array([3, 5, hmm.END]), np.array([hmm.END]), np.array([7, 3, 3, hmm.END])]
    for seq, got in zip(sequences, hmm.forward_log10(model, sequences), strict=True):
        total = 0.0
        for path in itertools.product(range(hmm.STATES), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, x in zip(path[:-1], path[1:], seq[1:], strict=True):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert abs(got - math.log10(total)) < 1e-9


def test_blocks_give_the_counts_of_whole_sequences(model, monkeypatch):
    rng = np.random.default_rng(5)
    sequences = [np.append(rng.integers(0, 40, int(n)), hmm.END) for n in (0, 1, 6, 7, 8, 20, 21, 100, 333)]
    whole = hmm.expected_counts(model, sequences)
    monkeypatch.setattr(hmm, "BLOCK", 7)
    for x, y in zip(whole, hmm.expected_counts(model, sequences), strict=True):
        assert np.allclose(x, y, rtol=1e-3, atol=1e-4)
    k, seq = hmm.STATES, sequences[3]  # and of one sequence by plain forward and backward values
    fwd, bwd = [model.start * model.emit[seq[0]]], [np.ones(k)]
    for x in seq[1:]:
        fwd.append(fwd[-1] @ model.move * model.emit[x])
    for x in seq[:0:-1]:
        bwd.insert(0, model.move @ (model.emit[x] * bwd[0]))
    total = fwd[-1].sum()
    gamma = [f * b / total for f, b in zip(fwd, bwd, strict=True)]
    moves = sum(np.outer(fwd[t], model.emit[seq[t + 1]] * bwd[t + 1]) * model.move / total for t in range(len(seq) - 1))
    start, move, emit = hmm.expected_counts(model, [seq])
    assert np.allclose(start, gamma[0], atol=1e-4) and np.allclose(move, moves, atol=1e-4)
    assert all(np.allclose(emit[x], sum(g for g, y in zip(gamma, seq, strict=True) if y == x), atol=1e-4) for x in set(seq.tolist()))


def test_groups_hold_every_sequence_once():
    lengths = [1, 5000, 3, 2049, 2048, 10, 600_000, 7] * 5
    found = list(hmm.groups(np.zeros(n, np.uint16) for n in lengths))
    assert sorted(len(s) for g in found for s in g) == sorted(lengths)
    assert all(len({len(s) > hmm.LONG for s in g}) == 1 for g in found)


def test_baum_welch_counts_are_expectations_and_raise_the_likelihood(model):
    rng = np.random.default_rng(2)
    sequences = [np.append(rng.integers(0, 12, int(n)), hmm.END) for n in rng.integers(0, 30, 40)]
    start, move, emit = hmm.expected_counts(model, sequences)
    tokens = sum(map(len, sequences))
    assert abs(start.sum() - len(sequences)) < 1e-2 and abs(emit.sum() - tokens) < 1e-2 and abs(move.sum() - (tokens - len(sequences))) < 1e-2
    before, now = -math.inf, model
    for _ in range(5):
        after = hmm.forward_log10(now, sequences).sum()
        assert after > before - 1e-3
        before = after
        s, m, e = hmm.expected_counts(now, sequences)
        now = hmm.Hmm(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))
