from __future__ import annotations

import textwrap
from pathlib import Path

import duckdb
import pytest
from conftest import table_of

from tessera.llm import licences

LONG = {name: text for name, text in licences.KNOWN if len(text.split()) > 60}
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "BSD-3-Clause": "BSD 3-Clause License", "Apache-2.0": None}


def found(df, **options):
    return {tuple(r) for r in licences.scan_licences(df, **options).select("doc_id", "licence", "whole_text", "n_places").collect()}


def by_sql(rows):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    return set(con.sql(f"select doc_id, licence, whole_text, n_places from ({licences.oracle_sql()})").fetchall())


def test_documents_equal_the_sql(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{medium}/documents.parquet'")
    expected = set(con.sql(f"select doc_id, licence, whole_text, n_places from ({licences.oracle_sql()})").fetchall())
    assert found(docs) == expected and expected


def wrapped(text, width, prefix=""):
    return "\n\n".join(textwrap.fill(p, width, initial_indent=prefix, subsequent_indent=prefix) for p in text.split("\n"))


def test_layouts_and_blocks_inside_files(spark):
    """Every licence of some length at widths 60 to 100: as a file with title and copyright line, and as a comment inside code."""
    rows, expected = [], set()
    for k, (name, text) in enumerate(LONG.items()):
        for width in range(60, 101):
            i = 1000 * k + width
            title = f"{TITLES[name]}\n\n" if TITLES.get(name) else ""
            rows.append((i, f"{title}Copyright (c) 2021, The Authors\nAll rights reserved.\n\n{wrapped(text, width)}\n", None, None))
            rows.append((-i, f"#!/bin/sh\n#\n# Copyright 2019 Someone\n#\n{wrapped(text, width, '# ')}\n\nset -e\necho done\n", None, None))
            places = 1 + (name == "Unlicense")  # its first paragraph is a notice of its own
            expected |= {(i, name, True, places), (-i, name, False, places)}
    got = found(table_of(spark, rows))
    assert got == expected and by_sql(rows) == got


def test_every_known_text_at_every_width(spark):
    """Notices and licences of any length, wrapped from 10 characters on, plain, as a comment and with list marks on lines of their own."""
    rows, expected = [], set()
    for k, (name, text) in enumerate(licences.KNOWN):
        for width in range(10, 61):
            i = 1000 * (k + 1) + width
            prefix = ("", "# ", " * ")[width % 3]
            lines = [textwrap.wrap(p, width, initial_indent=prefix, subsequent_indent=prefix, break_long_words=False, break_on_hyphens=True) for p in text.split("\n")]
            rows.append((i, "code above\n" + "\n".join(x for part in lines for x in part) + "\ncode below", None, None))
            expected.add((i, name))
    got = found(table_of(spark, rows))
    assert expected <= {(i, name) for i, name, whole, _ in got if not whole}
    assert by_sql([r for r in rows if r[0] % 10 == 0]) == {r for r in got if r[0] % 10 == 0}


@pytest.mark.skipif(not Path("/usr/share/common-licenses").is_dir(), reason="no public licence texts on this machine")
def test_long_licences_by_digest(spark):
    """The whole texts, also wrapped anew, under a copyright line, and inside a file; one changed word is another text."""
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    rows, expected = [], set()
    for k, (name, file) in enumerate(files.items()):
        text = (Path("/usr/share/common-licenses") / file).read_text()
        paragraphs = "\n\n".join(textwrap.fill(" ".join(p.split()), 100) if "opyright" not in p else p for p in text.split("\n\n"))
        forms = [text, "Copyright (c) 2020 Someone\n" + text, paragraphs, "/*\n" + "\n".join(f" * {x}" for x in text.split("\n")) + "\n */\nint main() {}\n", text.replace(" this ", " thus ", 1)]
        rows += [(10 * k + j, f, None, None) for j, f in enumerate(forms)]
        expected |= {(10 * k + j, name, j < 3) for j in range(4)}
    got = {(i, name, whole) for i, name, whole, _ in found(table_of(spark, rows)) if name in files}
    assert {r for r in got if r[2] or r[0] % 10 == 3} >= expected and not {i for i, _, whole in got if i % 10 == 4 and whole}


def test_more_known_texts_than_a_block(spark, monkeypatch):
    """Known texts beyond a block are looked for in another pass; nothing is refused."""
    monkeypatch.setattr(licences, "BLOCK_KNOWN", 7)
    known = spark.createDataFrame([(f"L{i}", f"licence number {i} of the house,\nall of it") for i in range(60)], "licence string, text string")
    rows = [(i, f"before\nLicense number {i} of\nthe house, all of it\nafter", None, None) for i in range(60)]
    assert found(table_of(spark, rows), known=known) == {(i, f"L{i}", False, 1) for i in range(60)}
    assert found(table_of(spark, rows), known=licences.known_digests(known)) == {(i, f"L{i}", False, 1) for i in range(60)}


def test_spellings_case_marks_and_copyright_lines(spark):
    mit = LONG["MIT"]
    rows = [
        (1, mit, None, None),
        (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENSE").replace(",", " ;"), None, None),
        (3, "prose\nReleased under the MIT Licence!\nmore prose\nreleased UNDER the mit license", None, None),
        (4, "we talk about the MIT License here, licensed under the MIT License. Or not", None, None),
        (5, mit + " and more", None, None),
        (6, "Licensed under the Apache License, v2.0.\nSPDX-License-Identifier: MIT", None, None),
        (7, mit.replace("without restriction", "with restrictions"), None, None),
        (8, LONG["BSD-3-Clause"].replace("HOLDERS", "OWNERS").replace("1. ", " * (1) ").replace("2. ", "b) "), None, None),
    ]
    got = found(table_of(spark, rows))
    assert got == {(1, "MIT", True, 1), (2, "MIT", True, 1), (3, "MIT", False, 2), (6, "Apache-2.0", False, 1), (6, "MIT", False, 1), (8, "BSD-3-Clause", True, 1)}
    assert by_sql(rows) == got


def test_a_table_of_licences(spark):
    own = spark.createDataFrame([("House", "House licence one:\nall may read"), ("House", "house LICENSE one all may read"), ("None", "")], "licence string, text string")
    df = table_of(spark, [(1, "x\nHouse license\none: all may read.\ny", None, None), (2, "Released under the MIT License.", None, None)])
    assert found(df, known=own.filter("licence = 'House'")) == {(1, "House", False, 1)}
    assert found(df, known=own, markers=()) == {(1, "House", False, 1)}
    with pytest.raises(ValueError, match="inside a word"):
        licences.scan_licences(df, known=own, markers=("public domain",))
    with pytest.raises(ValueError, match="without any of"):
        licences.scan_licences(df, known=own)


def test_odd_rows(spark, odd, nothing):
    assert found(odd) == set() and found(nothing) == set()
    line = "SPDX-License-Identifier: MIT"
    rows = [(1, line, None, None), (1, line + "\nother", None, None), (None, line, None, None), (None, "no licence", None, None), (2, None, None, None), (3, "words\n" * 50_000 + line, None, None)]
    assert found(table_of(spark, rows)) == {(1, "MIT", True, 2), (None, "MIT", True, 1), (3, "MIT", False, 1)}
