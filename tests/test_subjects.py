"""Many questions at once against one at a time in plain Python."""

from __future__ import annotations

import random

from tessera.operators import subjects
from tessera.plans import checks
from tessera.queries import subjects as queries


def has(title, word):
    return len(word) >= 3 and word[: max(4, len(word) - 2)] in (title or "").lower()


def slow_covered(rows, asked):
    """rows (key, title, score) of one question."""
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))[: subjects.CANDIDATES]
    if not rows or rows[0][2] < 3:
        return []
    best = rows[0][2]
    chosen = [r for r in rows if r[2] >= best * 0.8][:4]
    for word in asked:
        if len(chosen) >= 4:
            break
        if len(word) < 4 or any(has(r[1], word) for r in chosen):
            continue
        chosen += [r for r in rows if r[2] >= max(3, best * 0.5) and r not in chosen and has(r[1], word)][:1]
    return [(r[0], r[2], i + 1) for i, r in enumerate(chosen)]


def slow_subject(entries, asked):
    held = []
    for key, title, body in entries:
        t, b = (title or "").split(), (body or "").split()
        hit = [w for w in dict.fromkeys(asked) if w in t or w in b]
        if hit:
            held.append((key, title, 2 * sum(w in t for w in hit) + len(hit), len(hit), sum((t + b).count(w) for w in hit)))
    every = [(k, t, n) for k, t, _, h, n in held if h == len(set(asked))]
    every = sorted((r for r in every if r[2] >= 0.3 * max(x[2] for x in every)), key=lambda r: (-r[2], r[0]))[:4]
    exact = [(k, n, i + 1, "all words") for i, (k, _, n) in enumerate(every)]
    if len(set(asked)) < 2 or any(has(t, w) for _, t, _ in every for w in asked):
        return exact
    return [(*r, "most words") for r in slow_covered([r[:3] for r in held], asked)] or exact


def test_questions_equal_one_at_a_time(spark):
    rng = random.Random(4)
    pool = ["theft", "bail", "bond", "murder", "notice", "arrest", "police", "court", "appeals", "order", "tax", "land"]
    some = lambda n: " ".join(rng.choices(pool, k=n))
    entries = [(i, None if i % 17 == 0 else some(rng.randrange(3)), None if i % 13 == 0 else some(rng.randrange(14))) for i in range(120)]
    questions = [(q, rng.choices(pool + ["absent"], k=rng.randrange(6))) for q in range(80)] + [(90, None), (91, ["theft", "bail", "absent"]), (92, ["tax"])]
    df = spark.createDataFrame(entries, "key int, title string, body string")
    asked = spark.createDataFrame(questions, "q int, asked array<string>")
    got = {}
    for r in subjects.on_subject(asked, df, "q", "asked", "key", "title", "body").collect():
        got.setdefault(r.q, []).append((r.key, r.score, r.place, r.way))
    expected = {q: slow_subject(entries, a or []) for q, a in questions}
    assert {q: sorted(v, key=lambda r: r[2]) for q, v in got.items()} == {q: v for q, v in expected.items() if v}
    assert {r[3] for v in got.values() for r in v} == {"all words", "most words"} and any(len(v) == 4 for v in got.values())
    assert subjects.on_subject(asked.limit(0), df, "q", "asked", "key", "title", "body").count() == 0


def test_an_uncovered_word_adds_the_entry_titled_with_it(spark):
    rows = [(1, 1, "Bail bonds", 9), (1, 2, "Appeals", 5), (1, 3, "Theft of goods", 5), (1, 4, "Theft", 4), (2, 5, "Bail", 2)]
    scored = spark.createDataFrame(rows, "q int, key int, title string, score int")
    asked = spark.createDataFrame([(1, ["bail", "theft", "appeal", "of"]), (2, ["bail"])], "q int, asked array<string>")
    got = subjects.most_covered(scored, asked, "q", "asked", "key", "title").collect()
    assert sorted((r.q, r.place, r.key) for r in got) == [(1, 1, 1), (1, 2, 3), (1, 3, 2)]


def test_entries_are_dealt_once_and_titles_come_last(spark, small):
    entries = spark.createDataFrame([(1, "Theft", "theft of goods"), (1, None, "goods"), (2, "Bail", None)], "k long, title string, body string")
    asked = spark.createDataFrame([("a", ["goods", "bail"]), ("b", ["theft", "nothing"])], "q string, asked array<string>")
    met = subjects.coverage(asked, entries, "q", "asked", "k", "title", "body")
    real = subjects.coverage(queries._questions(spark, small), queries._entries(spark, small), "item_id", "asked", "doc_id", "title", "text")
    moved = [line for line in checks.plan(real).splitlines() if line.startswith("Arguments: hashpartitioning") and "doc_id#" in line]
    assert len(moved) == 1 and "hashpartitioning(doc_id#" in moved[0]
    assert sorted((r.q, r.k, r.title_hits, r.hits, r.occurrences, r.asked) for r in met.collect()) == [("a", 1, 0, 1, 2, 2), ("a", 2, 1, 1, 1, 2), ("b", 1, 1, 1, 2, 2)]
