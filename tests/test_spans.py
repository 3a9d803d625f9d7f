"""Places, release points, references by place, and differences, each against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import legal, spans
from tessera.operators import answers, differences


def rows_of(spark, texts, column, name="t"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {name} string")
    return [r[1] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def plain(found):
    return None if found is None else [tuple(x) for x in found]


def test_places_equal_finditer(spark):
    rng = random.Random(1)
    texts = ["", None, "ab12 ab", "12", "ñ 1 中2 😀33 end", *("".join(rng.choices("ab1 2\n(中é", k=40)) for _ in range(60))]
    forms = (r"\d+", r"[ab]+\d?", r"\(\s*\w")
    expected = [None if t is None else sorted(((m.start(), m.end(), m[0]) for p in forms for m in re.finditer(p, t, re.ASCII)), key=lambda x: (x[0], -x[1])) for t in texts]
    got = [plain(x) for x in rows_of(spark, texts, spans.places(F.col("t"), *forms))]
    assert [None if g is None else sorted(g) for g in got] == [None if e is None else sorted(e) for e in expected]
    kept = [plain(x) for x in rows_of(spark, texts, spans.maximal(spans.places(F.col("t"), *forms)))]
    inside = lambda x, all_: any(y != x and y[0] <= x[0] and y[1] >= x[1] and y[:2] != x[:2] for y in all_)
    assert kept == [None if e is None else sorted({x for x in e if not inside(x, e)}) for e in expected]


def test_strike_by_place(spark):
    (got,) = rows_of(spark, ["a ( 12 ) b 3 (x 4) 12"], spans.strike_places(F.col("t"), F.transform(spans.places(F.col("t"), r"\d+"), lambda p: spans.with_brackets(F.col("t"), p)), "#"))
    assert got == "a # b # (x #) #"


def slow_release(text, found, ahead=24):
    end = text.rfind("\n", 0, len(text) - ahead) + 1 if len(text) > ahead else 0
    while end > 0:
        across = next((x for x in found if x[0] < end <= x[1]), None)
        if across is None:
            return end
        end = text.rfind("\n", 0, across[0]) + 1
    return 0


def test_release_points_equal_the_backward_search(spark):
    rng = random.Random(2)
    texts = ["short", "one line without an end " * 3, "", *("".join(rng.choices(["See AIR 1973\nSC 14", "\n", "word ", "Section 3\n02 IPC ", "(2014) 2 SCC 1"], k=12)) for _ in range(60))]
    found = spans.places(F.col("t"), *legal.CITATION_FORMS, *legal.STATUTE_FORMS)
    at = [plain(x) for x in rows_of(spark, texts, found)]
    got = rows_of(spark, texts, spans.releasable_end(F.col("t"), found))
    assert got == [slow_release(t, x) for t, x in zip(texts, at, strict=True)] and len(set(got)) > 5
    assert rows_of(spark, [None], spans.releasable_end(F.col("t"), found)) == [None]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("sections 302 and 34 of the IPC", ["IPC 302", "IPC 34"]),
        ("u/s 302/34 IPC", ["IPC 302", "IPC 34"]),
        ("IPC 302, 304B r/w 34; BNS 103(1)", ["IPC 302", "IPC 304B", "IPC 34", "BNS 103(1)"]),
        ("IPC 326B BNS mein Section 124 ke saath", ["IPC 326B"]),
        ("IPC 302 and 103 of the BNS", ["IPC 302", "BNS 103"]),
        ("IPC 302, 304 BNS 103", ["IPC 302", "IPC 304", "BNS 103"]),
        ("under the BNS 2023 and BNS section 2023", ["BNS 2023"]),
        ("Sections 302 IPC and 498A IPC", ["IPC 302", "IPC 498A"]),
        ("Order 39 CPC, Article 21 COI", ["CPC 39", "COI 21"]),
        ("in 2023 IPC was gone", []),
        ("section 12 of nothing", []),
    ],
)
def test_statute_places(spark, text, expected):
    found = rows_of(spark, [text], legal.statute_places(F.col("t")))[0]
    assert [x.key for x in found] == expected and all(text[x.start : x.stop] == x.ref for x in found)


def test_recodified_references(spark):
    cases = {
        "CrPC 125 maintenance - which section in BNSS?": ("CRPC", "125"),
        "BNSS 144 in CrPC?": ("BNSS", "144"),
        "IPC 302 BNS mein": ("IPC", "302"),
        "IPC 302 vs BNS 103": None,
        "2023 mein 420 IPC, BNS?": ("IPC", "420"),
        "CrPC की धारा 133 BNSS": ("CRPC", "133"),
        "section 65 B of the Indian Evidence Act, now Bharatiya Sakshya Adhiniyam": None,
        "section 65B of the Indian Evidence Act, now Bharatiya Sakshya Adhiniyam": ("IEA", "65B"),
        "IPC 302": None,
        "what is bail": None,
    }
    got = rows_of(spark, [*cases, None], legal.recodified_reference(F.col("t")))
    assert [None if g is None else tuple(g) for g in got] == [*cases.values(), None]


def report(spark, texts, known, shown=(), **more):
    df = spark.createDataFrame([(i, t, "IPC 999") for i, t in enumerate(texts)], "id int, said string, asked string")
    refs = lambda rows: spark.createDataFrame([(r,) for r in rows], "ref string")
    found = answers.report(df, refs(known), refs(shown), "id", "said", legal.reference_places, legal.reference_key, note="", **more)
    return [found_row for found_row in sorted(found.collect(), key=lambda r: r.id)]


def test_report_by_place(spark):
    """A prefix of a real citation, blanks and line breaks in one, brackets, dots, and sections in the same answer."""
    texts = [
        "See (2014) 2 SCC 1 and (2014) 2 SCC 10.",
        "See (2014)  2 SCC 77 or (2014)\n2 SCC 77.",
        "*Case* (AIR 2019 SC 1234) and ( AIR 2019 SC 1235 )",
        "A.I.R. 1973 S.C. 1461 holds",
        "u/s 302/34 IPC and section 999 of the IPC, BNS 5000",
        "AIR 2018 SC 1234 stays whole",
    ]
    known = ["(2014) 2 SCC 10", "AIR 2019 SC 1234", "AIR 1973 SC 1461", "IPC 302", "AIR 2018 SC 1234"]
    got = report(spark, texts, known, known, asked="asked")
    assert [r.said for r in got] == [
        "See [unverified] and (2014) 2 SCC 10.",
        "See [unverified] or [unverified].",
        "*Case* (AIR 2019 SC 1234) and [unverified]",
        texts[3],
        "u/s 302/[unverified] IPC and section 999 of the IPC, [unverified]",
        texts[5],
    ]
    assert got[0].removed == ["(2014) 2 SCC 1"] and got[1].removed == ["(2014) 2 SCC 77"] and got[4].removed == ["34", "BNS 5000"] and got[4].verified == ["302"]
    assert not got[3].triggered and got[2].verified == ["AIR 2019 SC 1234"]


def test_reports_with_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "AIR 1990 SC 12"), (1, "AIR 1991 SC 13"), (None, "AIR 1991 SC 13"), (None, "none"), (None, None)], "id int, said string")
    known = spark.createDataFrame([("AIR 1990 SC 12",), (None,)], "ref string")
    found = answers.report(df, known, known, "id", "said", legal.reference_places, legal.reference_key, note="")
    assert sorted(((r.id, r.said) for r in found.collect()), key=repr) == sorted([(1, "AIR 1990 SC 12"), (1, "[unverified]"), (None, "[unverified]"), (None, "none"), (None, None)], key=repr)


def test_sections_shown_under_an_answer(spark):
    listed = [("BNS", "103(1)"), ("IPC", "302"), ("BSA", "65"), ("IPC", "65")]
    cases = {
        "Murder is Section 103 of the Bharatiya Nyaya Sanhita, 2023.": [("BNS", "103(1)")],
        "see section 103(2)": [("BNS", "103(1)")],
        "see section 65": [],  # of two acts
        "IPC 65 and IPC ki dhara 302": [("IPC", "302"), ("IPC", "65")],
        "CPC 9": [],
        "No number here": sorted(listed),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, said string")
    rows = spark.createDataFrame([(i, *x) for i in range(len(cases)) for x in listed], "id int, act string, section string")
    got = answers.statutes_shown(df, rows, "id", "said").collect()
    assert [sorted((r.act, r.section) for r in got if r.id == i) for i in range(len(cases))] == list(cases.values())


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


SMALL = st.lists(st.sampled_from("abcd"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(SMALL, SMALL)
def test_common_subsequence_is_longest_and_edits_replay(a, b):
    pairs = differences.common(a, b)
    assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
    assert all(x < y and p < q for (x, p), (y, q) in zip(pairs, pairs[1:]))  # noqa: B905
    out, at = [], 0
    for op, i, n, j, m in differences.edits(a, b):
        assert op == {(True, True): "replace", (True, False): "delete", (False, True): "insert"}[n > i, m > j]
        out += a[at:i] + b[j:m]
        at = n
    assert out + a[at:] == b


def test_differences_replay_and_ratios_of_tables(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(20_000)]
    other = list(base)
    for _ in range(300):
        at = rng.randrange(len(other))
        other[at : at + rng.randrange(3)] = [f"x{rng.randrange(50)}"] * rng.randrange(3)
    texts = [(1, " ".join(base), " ".join(other)), (2, "a b c", "a b c"), (3, None, "x y"), (4, "x", None), (5, "", ""), (6, "one two three four", "one 2 three")]
    df = spark.createDataFrame(texts, "id int, a string, b string")
    found = differences.differences(df, "id", "a", "b")
    back = {r.id: " ".join(r.words) for r in differences.replay(df, found, "id", "a").collect()}
    assert back == {i: (b or "") for i, _, b in texts}
    ratio = {r.id: r.ratio for r in differences.ratios(df, found, "id", "a", "b").collect()}
    assert ratio[2] == ratio[5] == 1 and ratio[3] == ratio[4] == 0 and ratio[6] == pytest.approx(4 / 7) and 0.97 < ratio[1] < 1
    assert [tuple(r)[:6] for r in found.filter("id = 6").collect()] == [(6, "replace", 1, 2, 1, 2), (6, "delete", 3, 4, 3, 3)]
    assert found.filter("id in (2, 5)").count() == 0 and differences.differences(df.limit(0), "id", "a", "b").count() == 0


def test_versions_of_one_beginning_are_dealt_evenly(spark, tmp_path):
    from tessera.queries import guard

    rows = [(i, f"The very same beginning of all texts {i % 7} and {i}") for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = guard._versions(spark, str(tmp_path))
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 1500, sizes  # one key; a task had all of them
    assert guard.version_differences(spark, str(tmp_path)).count() > 0
