"""Ranked lexical search of stated items over all documents, by sort-based accumulation.

1. Postings.  A document is read once and becomes its number of terms and the
   (term, frequency) arrays of those terms that an item asks for.
2. Statistics.  Documents, terms and document frequencies are counted over all
   postings.
3. Accumulation.  A task takes some documents and concatenates the matched
   (item, document, impact) arrays; keys of item and document are packed and
   radix sorted, ``reduceat`` sums the impacts of equal keys, and each item keeps
   its best in a heap.
4. Selection.  What the tasks kept is dealt by range of (item, salt), then of
   item, and selected by heap again.

Items go to the tasks as arrays of at most BLOCK_TERMS terms; more items are
searched in several blocks, each over all documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrowkit import list_array, list_values, tidy
from tessera.llm.shared import materialise, parts
from tessera.llm.wordhash import Words, chunks, text_buffer

BLOCK_TERMS = 1_000_000  # terms of the items of one block, 8 bytes each
PAIRS = 1 << 21  # (item, document, impact) triples sorted at once
SALTS = 64
SCALE = 1_000_000_000

# Bytes of terms: digits, letters and everything beyond ASCII.
_TERM = np.zeros(256, dtype=bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


def _terms(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, hashes of the terms in order, bounds) of runs a..b-1 of texts."""
    data, off = text_buffer(text)
    for a, b in chunks(off):
        raw = data[off[a] : off[b]]
        words = Words(np.where(_TERM[raw], raw, np.uint8(32)), off[a : b + 1] - off[a])
        yield a, b, words.hashes().view(np.int64), words.bounds


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys, 16 bits at a time from the lowest."""
    order, top = np.arange(len(keys)), int(keys.max(initial=0))
    shift = 0
    while top >> shift:
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # a radix sort for 16-bit numbers
        shift += 16
    return order


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal non-negative keys begin."""
    return np.flatnonzero(np.diff(keys, prepend=-1))


def sum_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, sums of their values)."""
    if not len(keys):
        return keys, values
    order = radix_order(keys)
    keys = keys[order]
    start = run_starts(keys)
    return keys[start], np.add.reduceat(values[order], start)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, hashes, bounds in _terms(batch.column("text")):
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("row", "item_id")), list_array(hashes, bounds, pa.int64())], ["row", "item_id", "terms"])


def _postings(asked):
    """Rows (doc_id, n, terms, tfs): places in ``asked`` (ascending hashes) of a document's terms, and how often it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = asked.value
        for batch in batches:
            for a, b, hashes, bounds in _terms(batch.column("text")):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                doc = np.repeat(np.arange(b - a), np.diff(bounds))[hit]
                key, tf = sum_by_key(doc * len(known) + at[hit], np.ones(int(hit.sum()), np.int64))
                cuts = np.searchsorted(key, np.arange(b - a + 1) * len(known))
                columns = [pa.array(np.diff(bounds).astype(np.int64)), list_array(key % len(known), cuts, pa.int32()), list_array(tf, cuts, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], ["doc_id", "n", "terms", "tfs"])

    return run


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of each document: 25 + (75 * n * docs) div total, also where the product is beyond 64 bits."""
    if int(n.max(initial=0)) * 75 * docs < 1 << 63:
        return 25 + 75 * n * docs // total
    return np.array([25 + 75 * x * docs // total for x in n.tolist()], dtype=np.int64)


def best(heap: list[tuple], found: Iterator[tuple], k: int) -> None:
    """Keeps the ``k`` largest of ``found`` in ``heap``, the least of them first."""
    for entry in found:
        if len(heap) < k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def _entry(score: int, doc_id: int | None) -> tuple:
    """Larger is better: a higher score, then a smaller id, null last."""
    return score, doc_id is not None, -doc_id if doc_id is not None else 0


def _kept(heaps: dict[int, list[tuple]]) -> pa.RecordBatch:
    rows = [(item, -minus if has else None, score) for item, heap in heaps.items() for score, has, minus in heap]
    item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, doc, score)], ["item", "doc_id", "score"])


def _accumulate(index, docs: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, items, weights = index.value  # of each term: its items, and its weight times its repeats in them
        degree = np.diff(starts)
        heaps: dict[int, list[tuple]] = {}
        least = np.zeros(int(items.max(initial=-1)) + 1, dtype=np.int64)  # a score under this is in no item's best
        for batch in batches:
            terms, counts = list_values(batch.column("terms"))
            tfs, _ = list_values(batch.column("tfs"))
            ids, m = batch.column("doc_id"), lengths(batch.column("n").to_numpy(), docs, total)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            impact = SCALE * tfs // (1000 * tfs + 8 * m[owner])
            made = np.append(0, np.cumsum(np.bincount(owner, weights=degree[terms], minlength=batch.num_rows).astype(np.int64)))
            bounds = np.append(0, np.cumsum(counts))
            for a, b in chunks(made, PAIRS):
                part = slice(bounds[a], bounds[b])
                times = degree[terms[part]]
                each = np.repeat(np.arange(len(times)), times)
                place = starts[terms[part]][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                key = items[place] * (b - a) + (owner[part] - a)[each]
                key, score = sum_by_key(key, weights[place] * impact[part][each])
                item = key // (b - a)
                good = np.flatnonzero((score > 0) & (score >= least[item]))
                key, score, item = key[good], score[good], item[good]
                order = np.lexsort((-score, item))
                first = run_starts(item[order])
                rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                kth = np.full(len(least), -1, dtype=np.int64)
                kth[item[order][rank == k - 1]] = score[order][rank == k - 1]
                near = np.flatnonzero(score >= kth[item])  # the best k of each item here, and all that equal the last of them
                cut = run_starts(item[near])
                found_ids = ids.take(pa.array(a + key[near] % (b - a))).to_pylist()
                for x, y in zip(cut, np.append(cut, len(near))[1:], strict=True):
                    heap = heaps.setdefault(int(item[near[x]]), [])
                    best(heap, map(_entry, score[near[x:y]].tolist(), found_ids[x:y]), k)
                    least[item[near[x]]] = heap[0][0] if len(heap) == k else 0
        yield _kept(heaps)

    return run


def _select(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple]] = {}
        for batch in batches:
            for item, doc, score in zip(*(batch.column(c).to_pylist() for c in ("item", "doc_id", "score")), strict=True):
                best(heaps.setdefault(item, []), [_entry(score, doc)], k)
        yield _kept(heaps)

    return run


def _search_block(spark: SparkSession, rows: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    """Rows (item, doc_id, score) of the best of each item of a block of items, which is bounded."""
    held = block.select("row", "terms").toArrow()
    flat, sizes = list_values(held.column("terms"))
    if not len(flat):
        return None
    # Items are numbered within the block; a term's items lie together, each with the term's repeats in it.
    item = np.repeat(np.arange(held.num_rows), sizes)
    known, term = np.unique(flat, return_inverse=True)
    key, repeats = sum_by_key(term * held.num_rows + item, np.ones(len(term), np.int64))
    postings = rows.mapInArrow(tidy(_postings(spark.sparkContext.broadcast(known))), "doc_id long, n long, terms array<int>, tfs array<long>")
    postings = materialise(postings, "postings")
    docs, total = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not docs:
        return None
    df = np.zeros(len(known), dtype=np.int64)
    counted = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    starts = np.searchsorted(key, np.arange(len(known) + 1) * held.num_rows)
    index = spark.sparkContext.broadcast((starts, key % held.num_rows, weight[key // held.num_rows] * repeats))

    schema = "item long, doc_id long, score long"
    kept = postings.mapInArrow(tidy(_accumulate(index, docs, total, k)), schema)
    kept = materialise(kept.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))), "kept")
    salted = kept.repartitionByRange(parts(spark), "item", "salt").select("item", "doc_id", "score").mapInArrow(tidy(_select(k)), schema)
    found = materialise(salted, "kept").repartitionByRange(parts(spark), "item").mapInArrow(tidy(_select(k)), schema)
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(held.num_rows)), "row": held.column("row")}))
    return found.join(names, "item").select("row", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII digits and letters and of characters beyond ASCII,
    A-Z lower-cased.  A document's score sums, over the item's terms with their
    repeats, weight * ((10 ** 9 * tf) div (1000 * tf + 8 * m)): weight is
    floor(1000 * ln((2 N + 2) / (2 df + 1))) and m is 25 + (75 * n * N) div L,
    with N the documents that have a term, L all terms, n the document's.
    Scores have to be above 0; equal ones go by ascending id, a null id last.
    Every row is a document or an item of its own, also where ids repeat or are
    null, so repeated rows are found once each.  Null and empty texts have no
    terms, on either side, and neither find nor are found; other columns are
    ignored; empty tables give no rows.  Texts are read whole, a very long one
    by one task at some 60 bytes a character.  Terms are told apart by 64-bit
    hashes.
    """
    spark = docs.sparkSession
    listed = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    kind = listed.schema["item_id"].dataType.simpleString()
    listed = materialise(listed.mapInArrow(tidy(_item_terms), f"row long, item_id {kind}, terms array<long>"), "items")
    blocks = (listed.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    numbered = listed.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    found = [_search_block(spark, rows, numbered.filter(F.col("block") == b), k) for b in range(blocks)]
    found = [f for f in found if f is not None] or [spark.createDataFrame([], "row long, doc_id long, score long")]
    order = "row_number() over (partition by row order by score desc, doc_id nulls last) as rank"  # k rows an item
    return reduce(DataFrame.unionByName, found).join(listed.select("row", "item_id"), "row").select("item_id", F.expr(order), "doc_id", "score")


def oracle_sql() -> str:
    """DuckDB SQL for the default of :func:`search`, over tables documents and benchmark without repeated ids."""
    terms = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term"
    return f"""with asked as (select item_id, {terms} from benchmark),
held as (select doc_id, term, count(*) as tf from (select doc_id, {terms} from documents) group by all),
sizes as (select doc_id, cast(sum(tf) as bigint) as n from held group by doc_id),
alls as (select count(*) as docs, cast(sum(n) as bigint) as total from sizes),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from held, alls group by term, docs),
scored as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // total))))) as bigint) as score
  from asked join held using (term) join weights using (term) join sizes using (doc_id), alls group by item_id, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10"""
