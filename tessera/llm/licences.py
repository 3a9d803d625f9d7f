"""Licence scans: digests of normalised texts, joined to those of known licences.

The canonical form of a text is its words line by line, without copyright
lines, list marks and punctuation, in lower case and one spelling.  A known
text is looked up wherever it may stand as whole lines, however they are
wrapped: at each line that begins with the first words of a known text, the run
of as many words as that has is taken if it ends with a line, and its digest is
joined to the known ones.  A text that is a licence from its first line to its
last is such a run too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tessera.llm.arrowkit import tidy
from tessera.llm.shared import materialise

# Short public licence texts and notices by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD2 = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{_DISCLAIMER}"""
_BSD3 = _BSD2.replace("THIS SOFTWARE IS", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS", 1)
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", _BSD2),
    ("BSD-3-Clause", _BSD3),
    ("Zlib", _ZLIB),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("0BSD", _0BSD),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Whole public licence texts, told by their canonical form: its first words, their number and its digest.
KNOWN_DIGESTS = (
    ("Apache-2.0", "apache license version", 1589, "8721befe6f5a6ff73ce51c6fc378ed7d23665ab2310b9ece2c38588897cca7d4"),
    ("Artistic-1.0-Perl", "the artistic license", 969, "7783c16796f207f4cab765dee131052ede7a3ae766fe1e4cc9e4a526eef22581"),
    ("CC0-1.0", "creative commons legal", 1075, "bcb34beb055cf5ea9667c444885536125c19225f7932496f5002d5ecac0d242f"),
    ("GFDL-1.2", "gnu free documentation", 3295, "04902c1629cdf711a4813ee016f3c6320d7ef1f07f401be74d9c3efd9a01c692"),
    ("GFDL-1.3", "gnu free documentation", 3707, "b001519fe012dc75744c57ffe2e5aedc0256b9d2d8d6d57c5690bb50b8c4bb05"),
    ("GPL-1.0", "gnu general public", 2047, "2d878304e2724b1ef4d84dfb37b2e91bd5ed897ca818ea9d76ddbd9d619387d0"),
    ("GPL-2.0", "gnu general public", 2955, "df1dbbcfefe2814a2912a76b4a8285f50b1cfb932a6ff4c24505e19ad119a515"),
    ("GPL-3.0", "gnu general public", 5633, "706f92f3252f1f04c84adb5d878045c34992b271e485703697d0da753f3b1881"),
    ("LGPL-2.0", "gnu library general", 4173, "d00ba603abae17ada13ff056197d683956220fcc32733d3650b9e333f8a816af"),
    ("LGPL-2.1", "gnu lesser general", 4371, "f440884fefee15ad019c3c63249e6aabec73d984e1be00e6cc7317bc8cd2b727"),
    ("LGPL-3.0", "gnu lesser general", 1211, "dd9d0b05045a0707717c8a564402d828c6b7a4e179bddaa594eb6442c9a128f1"),
    ("MPL-1.1", "mozilla public license", 3735, "1eec0b16f05af04c716ac17a5aa8f0a30ae4355d71b1d2e6125c10f218a54959"),
    ("MPL-2.0", "mozilla public license", 2397, "202cd6894c33b535a1e5cc5cb03acd86dd86e02584835c2b1eb92ac859b73824"),
)
# Words that count as equal; a hyphen parts words, so a line may end there.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "owner": "holder",
    "owners": "holders",
    "organisation": "organization",
    "favour": "favor",
    "https": "http",
    "sublicense": "sub license",
    "sublicence": "sub license",
    "noninfringement": "non infringement",
}
_COPYRIGHT = re.compile(r"[^a-z0-9(©]*(copyright[^a-z0-9]*(\(c\)|©)|\(c\)\s*copyright|(copyright|\(c\)|©).*((19|20)[0-9]{2}|<year>|\[year\]|\[yyyy\]))")
_RIGHTS = re.compile(r"[^a-z0-9]*all rights reserved[^a-z0-9]*")
_LIST_MARK = re.compile(r"\(?([0-9]{1,2}|[a-z])[.)]")
# A number that follows one of these is no list mark.
NUMBERED = ("version", "section")
_WORD = re.compile(r"[a-z0-9à-öø-ÿ]+")
HEAD_WORDS = 3
TITLE_WORDS = 6
BLOCK_KNOWN = 100_000  # known texts whose first words go to the tasks at once
#: Other texts need no digest.  Lower case, and each inside a word, which no wrapping parts; every known text has to hold one.
MARKERS = ("licen", "permission", "permitted", "domain")


def canonical(text: str) -> tuple[list[str], list[int]]:
    """(words, where each line with a word starts, and the number of words).

    Copyright lines (with a year or a sign) and "all rights reserved" have no
    words.  List marks go wherever they stand, so that it doesn't matter whether
    a line begins with one.
    """
    words, starts, before = [], [], ""
    for line in text.lower().split("\n"):
        if _COPYRIGHT.match(line) or _RIGHTS.fullmatch(line):
            continue
        first = len(words)
        for token in re.sub(r"\bv(?=[0-9])", "version ", line.replace("&", " and ")).split():
            if not _WORD.search(token):
                continue
            if before in NUMBERED or not _LIST_MARK.fullmatch(token):
                words += [x for w in _WORD.findall(token) for x in SPELLINGS.get(w, w).split()]
            before = re.sub("[^a-z0-9]+", "", token)
        if len(words) > first:
            starts.append(first)
    return words, [*starts, len(words)]


def _digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [canonical(t or "")[0] for t in batch.column("text").to_pylist()]
        rows = [(name, _digest(w), " ".join(w[:HEAD_WORDS]), len(w)) for name, w in zip(batch.column("licence").to_pylist(), forms, strict=True) if w]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["licence", "digest", "head", "n_words"])


def _runs(heads: dict[str, list[int]]):
    """Rows (doc_id, digest, whole) of the runs of whole lines that may be known texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").to_pylist(), strict=True):
                words, starts = canonical(text)
                ends = set(starts)
                title = starts[1] if len(starts) > 2 and starts[1] <= TITLE_WORDS and any(w.startswith("licen") for w in words[: starts[1]]) else 0
                for a in starts[:-1]:
                    for head in {" ".join(words[a : a + n]) for n in range(1, HEAD_WORDS + 1)}:
                        for n in heads.get(head, ()):
                            if a + n in ends:
                                rows.append((doc_id.as_py(), _digest(words[a : a + n]), a in (0, title) and a + n == len(words)))
            if rows:
                ids, digests, whole = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("doc_id").type), pa.array(digests), pa.array(whole)], ["doc_id", "digest", "whole"])

    return run


def known_digests(known: DataFrame) -> DataFrame:
    """Rows (licence, head, n_words, digest) of known texts (licence, text): the canonical form's first words, length and digest.

    Texts without words have none.
    """
    texts = known.select(F.col("licence").cast("string"), F.col("text").cast("string"))
    return texts.mapInArrow(tidy(_known), "licence string, digest string, head string, n_words long").select("licence", "head", "n_words", "digest")


def scan_licences(docs: DataFrame, known: DataFrame | None = None, markers: tuple[str, ...] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence found in it: doc_id, licence, whole_text, n_places.

    ``known`` has the columns licence and text, or those of
    :func:`known_digests`; by default it is the table of this module, of short
    licences and notices by their texts and of long ones by their digests.  Each
    known text holds one of ``markers``, which are parts of single words, so a
    line break doesn't hide one; for digests that is for the caller to see to.
    The first words of BLOCK_KNOWN known texts at a time go to the tasks; more
    of them are looked for in more passes over the documents.

    A licence is found where whole lines of a document, however wrapped between
    words, have the canonical form of a known text; n_places counts these places, and
    whole_text says whether one takes up the whole text, but for copyright
    lines and a title.  Null and empty texts have none; rows that repeat an id
    count as one document with the places of each, as do rows with a null id;
    of known texts with one canonical form the first licence in order is
    reported; other columns are ignored; an empty table gives no rows.  Texts
    are read whole; a very long one is held by its task as a list of words.
    """
    spark = docs.sparkSession
    if any(not m.isalnum() for m in markers):
        raise ValueError("a marker has to lie inside a word")
    holds = lambda c: F.expr(" or ".join(f"contains(lower(`{c}`), '{m}')" for m in markers)) if markers else F.lit(True)
    if known is None:
        known = known_digests(spark.createDataFrame([*KNOWN], "licence string, text string"))
        known = known.unionByName(spark.createDataFrame([*KNOWN_DIGESTS], "licence string, head string, n_words long, digest string"))
    elif "text" in known.columns:
        if known.filter(~holds("text")).limit(1).count():
            raise ValueError(f"a known text without any of {', '.join(markers)}")
        known = known_digests(known)
    table = materialise(known.groupBy("digest", "head", "n_words").agg(F.min("licence").alias("licence")), "known")
    listed = table.count()
    blocks = listed // BLOCK_KNOWN + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(holds("text"))
    schema = StructType([rows.schema["doc_id"], StructField("digest", StringType()), StructField("whole", BooleanType())])

    def runs(block: int) -> DataFrame:
        heads: dict[str, set[int]] = {}
        for r in table.filter(F.pmod(F.xxhash64("head", "n_words"), F.lit(blocks)) == block).select("head", "n_words").distinct().collect():
            heads.setdefault(r["head"], set()).add(r.n_words)
        return rows.mapInArrow(tidy(_runs({h: sorted(n) for h, n in heads.items()})), schema)

    digests = table.select("digest", "licence")
    met = reduce(DataFrame.unionByName, map(runs, range(blocks))).join(F.broadcast(digests) if listed <= BLOCK_KNOWN else digests, "digest")
    return met.groupBy("doc_id", "licence").agg(F.bool_or("whole").alias("whole_text"), F.count("*").alias("n_places"))


def oracle_sql() -> str:
    """The same over ``documents`` in DuckDB, by line runs of cumulative word counts; shares no code with the operator but the known texts."""
    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
    with texts as (
      select 'known ' || row_number() over () as rid, null::bigint as doc_id, licence, text from (values {known}) v(licence, text)
      union all
      select 'doc ' || row_number() over (), doc_id, null, text from documents),
    split as (select rid, doc_id, licence, unnest(string_split(lower(text), chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from texts),
    kept as (
      select rid, doc_id, licence, pos, regexp_replace(replace(line, '&', ' and '), '\\bv([0-9])', 'version \\1', 'g') as line from split
      where not regexp_full_match(line, '[^a-z0-9]*all rights reserved[^a-z0-9]*')
        and not regexp_matches(line, '^[^a-z0-9(©]*(copyright[^a-z0-9]*([(]c[)]|©)|[(]c[)][ \t]*copyright|(copyright|[(]c[)]|©).*(19[0-9][0-9]|20[0-9][0-9]|<year>|[[]year[]]|[[]yyyy[]]))')),
    cut as (select rid, doc_id, licence, pos, unnest(string_split_regex(line, '\\s+')) as token, unnest(range(len(string_split_regex(line, '\\s+')))) as nth from kept),
    told as (select *, regexp_replace(lag(token) over (partition by rid order by pos, nth), '[^a-z0-9]+', '', 'g') as before from cut where regexp_matches(token, '[a-z0-9à-öø-ÿ]')),
    plain as (select rid, doc_id, licence, pos, string_agg(token, ' ' order by nth) as line from told
      where coalesce(before, '') in ('version', 'section') or not regexp_full_match(token, '[(]?([0-9][0-9]?|[a-z])[.)]') group by rid, doc_id, licence, pos),
    worded as (
      select rid, doc_id, licence, pos, string_split(array_to_string(list_transform(list_filter(regexp_split_to_array(line, '[^a-z0-9à-öø-ÿ]+'), lambda w: w <> ''),
        lambda w: case w when 'licence' then 'license' when 'licences' then 'licenses' when 'licenced' then 'licensed' when 'owner' then 'holder' when 'owners' then 'holders'
          when 'organisation' then 'organization' when 'favour' then 'favor' when 'https' then 'http'
          when 'sublicense' then 'sub license' when 'sublicence' then 'sub license' when 'noninfringement' then 'non infringement' else w end), ' '), ' ') as words from plain
      where regexp_matches(line, '[a-z0-9à-öø-ÿ]')),
    placed as (select *, sum(len(words)) over (partition by rid order by pos) as finish, sum(len(words)) over (partition by rid order by pos) - len(words) as begin,
        row_number() over (partition by rid order by pos) as nth, sum(len(words)) over (partition by rid) as total from worded where len(words) > 0),
    forms as (select licence, string_agg(array_to_string(words, ' '), ' ' order by pos) as form, sum(len(words)) as n from placed where rid like 'known %' group by rid, licence),
    names as (select form, n, min(licence) as licence from forms group by form, n),
    docs as (select rid, flatten(list(words order by pos)) as every from placed where rid like 'doc %' group by rid),
    titled as (select rid, finish as title from placed where nth = 1 and finish < total and finish <= 6 and len(list_filter(words, lambda w: starts_with(w, 'licen'))) > 0),
    runs as (
      select a.doc_id, a.rid, a.begin, a.total, b.finish, names.licence, names.form from placed a join names on true join placed b on b.rid = a.rid and b.finish = a.begin + names.n
      where a.rid like 'doc %' and starts_with(names.form, a.words[1]))
    select runs.doc_id, licence, bool_or(runs.finish = runs.total and runs.begin in (0, coalesce(titled.title, 0))) as whole_text, count(*) as n_places
    from runs join docs using (rid) left join titled using (rid)
    where array_to_string(docs.every[runs.begin + 1 : runs.finish], ' ') = runs.form
    group by runs.doc_id, licence
    """
