"""Text and reference functions on small rows."""

from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import legal, scanners
from tessera.functions import text as tx


def values(spark, make, inputs):
    """make(column) for each input, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "make, cases",
    [
        (tx.citation_key, {"(2014) 8 SCC 273": "20148SCC273", "AIR 1973 SC 1461": "AIR1973SC1461", None: None, "": ""}),
        (tx.base_section, {"318(4)": "318", "498A": "498A", "": ""}),
        (tx.words, {"It's 2 o'Clock": ["it", "s", "2", "o", "clock"], "ज़मानत क्या है?": ["ज़मानत", "क्या", "है"], "Été, ÇA": ["été", "ça"], "": []}),
        (tx.trigrams, {"cat": ["  c", " ca", "cat", "at "], "": []}),
        (tx.strip_html, {"<p>a &amp; b</p><script>x < 1</script> c": "a & b c", "<!-- n --> t": "t", "": ""}),
        (tx.context_key, {"What is Bail?": "bail is what", "bail: what IS": "bail is what", "क्या है ज़मानत?": "क्या ज़मानत है", "धारा क्या है": "क्या धारा है"}),
        (tx.roman_value, {"XIV": 14, "xxxix": 39, "IIII": None, "": None, "MCMXC": 1990}),
        (lambda c: tx.clamp(c, 5), {"short": "short", "longer": "long…"}),
        (tx.mask_tail, {"9876543210": "******3210", "12": "12"}),
        (tx.requested_word_count, {"explain in 80 words": 80, "within 5 words": 10, "in 900 words": 300, "explain": None}),
        (legal.section, {"u/s 302 ipc": "302", "Section 156 (3)": "156(3)", "498a IPC": "498A", "धारा 420": "420", "IPC 65B": "65B", "nothing": None}),
        (legal.act_code, {"Indian Penal Code": "IPC", "Cr.P.C.": "CRPC", "bns": "BNS", "unknown": None}),
        (legal.named_act, {"under the Code of Criminal Procedure": "CRPC", "no act": None}),
        (legal.cnr, {"see DLCT01-000123-2024 today": "DLCT010001232024", "none": None}),
        (lambda c: legal.valid_cnr(c, 2026), {"DLCT010001232024": True, "DLCT010001231900": False, "DLCT01": False, None: False}),
        (legal.order_reference, {"Order XXXIX Rule 1": "Order 39 Rule 1", "order 7 rule 11": "Order 7 Rule 11", "order 99": None}),
        (legal.article_reference, {"Article 21A": "Article 21A", "art. 14": "Article 14", "article 900": None}),
        (legal.canonical_citation, {"(2014) 8 SCC 273": "SCC:2014:8:273", "2014 (8) SCC, 273": "SCC:2014:8:273", "AIR 1973 Supreme Court 1461": "AIR:1973:SC:1461", "2019 Supp (2) SCC 100": "SCC-SUPP:2019:2:100", "(2019) SCC (Supp) 2 100": "SCC-SUPP:2019:2:100", "2023 INSC 0045": "INSC:2023:45", "A.I.R. 1973 S.C. 1461": "AIR:1973:SC:1461", "ILR 5 Mad": "ilr5mad", None: None}),
        (legal.supreme_court_report, {"(2014) 8 SCC 273": True, "2020 SCC OnLine Del 5": False, "2020 SCC OnLine SC 5": True, "AIR 1990 Del 3": False, "A.I.R. 1973 S.C. 1461": True, "2023 INSC 45": True, "1999 (2) Scale 5": True, "ILR 5 Mad": False}),
        (legal.statute_refs, {"Section 302 of the IPC and BNS 103(1)": ["IPC 302", "BNS 103(1)"], "IPC 1860": [], "u/s 302 IPC, s. 65B of IEA; Order 39 CPC and 420 of the IPC": ["IPC 302", "IEA 65B", "CPC 39", "IPC 420"], "498A": [], None: None}),
    ],
)
def test_function(spark, make, cases):
    assert values(spark, make, list(cases)) == list(cases.values())


def test_citations_leave_out_parts_of_longer_ones(spark):
    found = values(spark, legal.citations, ["See AIR 1973  SC 1461 and (2014) 8 SCC 273.", "none"])
    assert sorted(found[0]) == ["(2014) 8 SCC 273", "AIR 1973 SC 1461"] and found[1] == []


def test_name_score(spark):
    rows = spark.createDataFrame([("Arnesh Kumar v State of Bihar", "Arnesh Kumar vs. State Of Bihar"), ("Arnesh Kumar v State", "Other v. Person"), ("no parties", "A v B")], "a string, t string")
    one, two, three = (r[0] for r in rows.select(legal.name_score(F.col("a"), F.col("t"))).collect())
    assert one == 1.0 and two < 0.2 and three == 0.0


TEXT = st.lists(st.sampled_from(["word ", "sentence ends. ", "\n\n", "(12) para ", "12. ", "x" * 50 + " ", "x" * 1500]), max_size=80).map("".join)


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_chunks_keep_to_their_size(text):
    chunks = scanners.chunk(text)
    assert [i for i, _, _ in chunks] == list(range(len(chunks)))
    assert all(scanners.CHUNK_LEAST <= len(c) <= 1.5 * scanners.CHUNK_TARGET + scanners.CHUNK_OVERLAP + 2 for _, c, _ in chunks)
    assert scanners.chunk(None) == [] and scanners.chunk("") == []


def test_chunks_are_slices_that_cover_the_paragraphs():
    numbered = [f"{n}. " + f"sentence {n} goes on. " * 12 for n in range(1, 9)]
    text = "\n\n".join(numbered) + "\n\n" + " ".join(f"tail{n}" for n in range(400))
    found = scanners.chunk(text)
    assert all(c in text for _, c, _ in found) and [n for _, _, n in found][:2] == [1, 5]
    places = [(text.find(c), text.find(c) + len(c)) for _, c, _ in found]
    assert places[0][0] == 0 and places[-1][1] == len(text.strip())
    assert all(b[0] <= a[1] + 3 for a, b in zip(places, places[1:]))  # no gap but a paragraph break
    windows = [p for p in places if p[0] >= text.index("tail")]
    assert all(scanners.CHUNK_OVERLAP - 1 <= a[1] - b[0] <= scanners.CHUNK_OVERLAP for a, b in zip(windows, windows[1:]))


def test_messages_break_after_a_danda():
    text = "यह एक वाक्य है। " * 30
    parts = scanners.split_message(text, 100)
    assert len(parts) > 3 and all(p.endswith("।") and len(p) <= 100 for p in parts)


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_message_parts_hold_the_whole_message(text):
    parts = scanners.split_message(text, 200)
    assert all(0 < len(p) <= 200 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_html_sections():
    html = "<h1>One</h1>a <b>b</b><script>no</script><h2>Two <i>x</i></h2>&amp; c"
    assert scanners.html_sections(html) == [(1, "One", "a b"), (2, "Two x", "& c")]
    assert scanners.html_sections(None) == []


def test_texts_are_scanned_a_few_at_a_time(spark):
    texts = [None, "", *(f"Paragraph {i} has words. " * 70 for i in range(300))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    schema = pa.schema([("chunk_index", pa.int32()), ("content", pa.string()), ("para_number", pa.int32())])
    made = list(scanners._scanned(iter([batch]), scanners.chunk, schema))
    assert max(len(set(b.column("k").to_pylist())) for b in made) <= scanners.STEP
    expected = [(k, *c) for k, t in enumerate(texts) for c in scanners.chunk(t)]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == expected
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(1)
    cut = scanners.chunk_documents(df, "k", "t")
    assert "MapInArrow" in cut._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r)[:4] for r in cut.collect()) == sorted(expected)
