"""Text scanners whose state no expression holds: chunking, message splitting, nested HTML sections."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Sizes in characters.
CHUNK_TARGET, CHUNK_OVERLAP, CHUNK_LEAST = 1200, 200, 100
MESSAGE_MOST = 4096
STEP = 64  # texts that a task scans at a time

_GAP = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE_END = re.compile(r"[.;।](?=\s)")
_NUMBERED = re.compile(r"[(]?([0-9]{1,4})[.)]\s")


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Spans of a text's paragraphs, without the white space around them."""
    edges = [0, *(x for gap in _GAP.finditer(text) for x in gap.span()), len(text)]
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        body = text[a:b]
        if kept := body.strip():
            first = a + len(body) - len(body.lstrip())
            yield first, first + len(kept)


def _last_in(places: list[int], low: float, high: float) -> int | None:
    """The largest of ascending places in (low, high]."""
    at = bisect.bisect_right(places, high) - 1
    return places[at] if at >= 0 and places[at] > low else None


def _cut_up(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Overlapping spans of a long paragraph: to the last sentence end of their second half, else the last blank, else the full size."""
    stops = [m.end() for m in _SENTENCE_END.finditer(text, a, b)]
    blanks = [a + m.start() for m in re.finditer(" ", text[a:b])]
    while b - a > CHUNK_TARGET:
        full = a + CHUNK_TARGET
        end = _last_in(stops, a + CHUNK_TARGET / 2, full) or _last_in(blanks, a + CHUNK_OVERLAP, full) or full
        yield a, end
        a = end - CHUNK_OVERLAP
    yield a, b


def chunk(text: str | None) -> list[tuple[int, str, int | None]]:
    """(index, content, paragraph number) of the chunks of a text; each is a slice of it.

    Paragraphs that follow each other share a chunk while their span keeps to
    the target size; it begins with the end of the chunk before.  A paragraph of
    half as much again is cut up by itself.  The number is the first that a
    paragraph of the chunk begins with.  Slices below the least size are left out.
    """
    text = (text or "").replace("\r\n", "\n")
    spans: list[list[int]] = []
    numbers: list[int | None] = []
    open_to = -1  # where the chunk that takes more paragraphs begins; -1 for none
    for a, b in _paragraphs(text):
        found = _NUMBERED.match(text, a, b)
        number = int(found[1]) if found else None
        if b - a > 1.5 * CHUNK_TARGET:
            for window in _cut_up(text, a, b):
                spans.append([*window])
                numbers.append(number)
            open_to = -1
        elif open_to >= 0 and b - open_to <= CHUNK_TARGET:
            spans[-1][1] = b
            numbers[-1] = number if numbers[-1] is None else numbers[-1]
        else:
            back = max(a - CHUNK_OVERLAP, spans[-1][0]) if open_to >= 0 else a
            spans.append([back, b])
            numbers.append(number)
            open_to = back if b - back <= CHUNK_TARGET else a
    sliced = [(text[a:b].strip(), n) for (a, b), n in zip(spans, numbers, strict=True)]
    return [(i, content, n) for i, (content, n) in enumerate(x for x in sliced if len(x[0]) >= CHUNK_LEAST)]


def _scanned(batches: Iterator[pa.RecordBatch], scan: Callable[[str | None], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows that ``scan`` finds in the second column, after the first; of STEP texts at a time, as a batch may hold many long ones."""
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            found = [scan(t) for t in batch.column(1).slice(a, STEP).to_pylist()]
            if rows := [row for of in found for row in of]:
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(a, a + len(found)), [*map(len, found)])))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([keys, *columns], [batch.schema.names[0], *schema.names])


def scanned(rows: DataFrame, key: str, text: str, scan: Callable[[str | None], list[tuple]], found: str, schema: pa.Schema) -> DataFrame:
    """Rows (key, ...) of what ``scan`` finds in each text; ``found`` are the added columns, ``schema`` the same for Arrow."""
    texts = rows.select(key, text)
    return texts.mapInArrow(lambda batches: _scanned(batches, scan, schema), StructType([StructField(key, texts.schema[0].dataType), *StructType.fromDDL(found).fields]))


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, chunk_index, content, para_number, token_count) of the chunks of every text."""
    schema = pa.schema([("chunk_index", pa.int32()), ("content", pa.string()), ("para_number", pa.int32())])
    rows = scanned(docs, key, text, chunk, "chunk_index int, content string, para_number int", schema)
    return rows.withColumn("token_count", F.ceil(F.length("content") / 4))


def split_message(text: str | None, most: int = MESSAGE_MOST) -> list[str]:
    """Parts of at most ``most`` characters.

    A part ends at a paragraph break in its last two fifths, else after a
    sentence (a full stop or danda) or at a blank in its second half, else at its full size.
    """
    out, rest = [], (text or "").strip()
    while len(rest) > most:
        head = rest[:most]
        ends = ((head.rfind("\n\n"), 0.6), (max(head.rfind(". "), head.rfind("।")) + 1, 0.5), (head.rfind(" "), 0.5))
        cut = next((at for at, least in ends if at > most * least), most)
        out.append(rest[:cut].rstrip())
        rest = rest[cut:].lstrip()
    return out + ([rest] if rest else [])


def message_parts(c: Column, most: int = MESSAGE_MOST) -> Column:
    @F.pandas_udf("array<string>")
    def parts_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_message(t, most))

    return parts_of(c)


class _Sections(HTMLParser):
    """Collects (level, heading, text) of h1..h6 headings and what follows them; scripts and styles are skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.hidden = 0
        self.level = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.level = int(tag[1])
            self.found.append([self.level, "", ""])

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.level = 0

    def handle_data(self, data) -> None:
        if self.hidden:
            return
        if self.level:
            self.found[-1][1] += data
        elif self.found:
            self.found[-1][2] += " " + data


def html_sections(html: str | None) -> list[tuple[int, str, str]]:
    parser = _Sections()
    parser.feed(html or "")
    parser.close()
    tidy = lambda s: " ".join(s.split())
    return [(level, tidy(head), tidy(body)) for level, head, body in parser.found]


def page_sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows (key, position, level, heading, body) of every page."""
    schema = pa.schema([("position", pa.int32()), ("level", pa.int32()), ("heading", pa.string()), ("body", pa.string())])
    placed = lambda page: [(i, *found) for i, found in enumerate(html_sections(page))]
    return scanned(pages, key, html, placed, "position int, level int, heading string, body string", schema)
