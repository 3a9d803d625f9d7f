"""Token counts without ids: pieces once per distinct pre-token, joined to frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrowkit import tidy
from tessera.llm.pieces import piece_table
from tessera.llm.wordhash import chunks, text_buffer


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in chunks(off, 1 << 22):
                frequencies = [Counter(table.pretokens(text)) for text in texts.slice(a, b - a).to_pylist()]
                pieces = table.add_counts(set().union(*frequencies))
                tokens = [sum(n * pieces[w] for w, n in of.items()) for of in frequencies]
                n_bytes = (off[a + 1 : b + 1] - off[a:b]).copy()
                n_tokens = pa.array(tokens, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n_bytes, pa.int64()), n_tokens, pc.greater(n_tokens, limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is a path of a ``tokenizers`` JSON file, readable on every
    executor; files whose pieces depend on more than their pre-token are refused.  Counts are the
    library's for the whole text, without added special tokens; special strings
    in a text count as it counts them by default.  A null or empty text has 0
    bytes and 0 tokens; ids may repeat or be null and are passed on; other
    columns are ignored; an empty table gives no rows.  Texts are counted whole; a
    very long one is held in memory by its task as a list of pre-tokens.

    A chunk of documents (4 MB) is reduced to frequencies of its pre-tokens by
    document, which meet the pieces of the chunk's distinct pre-tokens.  The
    join is local to the chunk: shuffling (document, pre-token) rows would move
    more bytes than the texts themselves.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_count(tokenizer, limit), "pieces"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
