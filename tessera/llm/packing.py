"""Best-fit decreasing packing of token sequences.

Best-fit decreasing sees only lengths, and there are at most ``capacity`` of
them.  So the plan is made from the histogram of lengths: for a length, the
tightest open bins are found in a segment tree over remaining capacities, and
all bins of that capacity are filled in one step.  A step is one plan row, so
the plan does not grow with the number of documents.  Pieces then find their
place by their rank among the pieces of their length, which needs no ordering
of the whole input: ranks are local to a written partition and are shifted by
the counts of the partitions before it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrowkit import tidy
from tessera.llm.pieces import piece_table
from tessera.llm.shared import materialise
from tessera.llm.wordhash import chunks, text_buffer


class OpenBins:
    """Segment tree over remaining capacities 0..capacity: how many bins are open at each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, need: int) -> int | None:
        """Smallest room >= need with an open bin."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first bin, offset) that place every piece.

    Pieces of a length with ranks first..first+count-1 go to bins
    first_bin, first_bin+1, .., each at ``offset``.
    """
    plan, bins = [], 0
    tree = OpenBins(capacity)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of bin numbers
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                per_bin = capacity // length
                full, rest = divmod(left, per_bin)
                # Alone among open bins, pieces of this length fill each new bin before the next is opened.
                if full:
                    for j in range(per_bin):
                        plan.append((length, rank, full, bins, j * length))
                        rank += full
                    if capacity - per_bin * length:
                        runs[capacity - per_bin * length].append((bins, full))
                        tree.add(capacity - per_bin * length, full)
                    bins += full
                for j in range(rest):
                    plan.append((length, rank, 1, bins, j * length))
                    rank += 1
                if rest:
                    runs[capacity - rest * length].append((bins, 1))
                    tree.add(capacity - rest * length, 1)
                    bins += 1
                left = 0
                continue
            first, n = runs[room].pop()
            # A bin just used is the tightest while it holds another piece, so each is filled before the next.
            per_bin = room // length
            full = min(n, left // per_bin)
            rest = left - full * per_bin if full < n else 0
            for at, take, each in ((first, full, per_bin), (first + full, int(rest > 0), rest)):
                if not take:
                    continue
                for j in range(each):
                    plan.append((length, rank, take, at, capacity - room + j * length))
                    rank += take
                if room > each * length:
                    runs[room - each * length].append((at, take))
                    tree.add(room - each * length, take)
                left -= take * each
            used = full + (rest > 0)
            tree.add(room, -used)
            if n > used:
                runs[room].append((first + used, n - used))
    return plan


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = piece_table(path), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        end, step = int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            texts = pc.fill_null(batch.column("text"), "")
            ids = batch.column("doc_id").to_pylist()
            for a, b in chunks(off, 1 << 20):
                split = [table.pretokens(t) for t in texts.slice(a, b - a).to_pylist()]
                known = table.add_ids(set().union(*split))
                rows = []
                for doc_id, words in zip(ids[a:b], split, strict=True):
                    raw = b"".join(map(known.__getitem__, words)) + end
                    for piece, at in enumerate(range(0, len(raw), step)):
                        cut = raw[at : at + step]
                        length = len(cut) // 4
                        rows.append((doc_id, piece, at // 4, length, zlib.crc32(cut), part, int(ranks[length])))
                        ranks[length] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _place(plan: np.ndarray):
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    length, rank, _, first, offset = plan[order].T
    span = 1 << 44

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = length * span + rank
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, n * span + r, side="right") - 1
            placed = [pa.array(first[at] + r - rank[at]), pa.array(offset[at].copy())]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, *placed], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids (the library's for the whole text, no added
    special tokens) and ``end_id``; only documents longer than ``capacity`` are
    cut, into pieces of ``capacity`` and a rest.  Pieces share sequences of at
    most ``capacity`` ids by best-fit decreasing and lie there without gaps from
    offset 0.  A null or empty text is the end id alone; ids may repeat or be
    null (each row is a document of its own); other columns are ignored; an
    empty table gives no rows.  ``ids_crc32`` is over little-endian uint32 ids.
    Texts are encoded whole; a very long one is held in memory by its task as its
    pre-tokens and ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
    pieces = materialise(rows.mapInArrow(tidy(_cut(tokenizer, capacity, end_id), "pieces"), schema), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = materialise(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")), "shift")
    histogram = {r.length: r.n for r in shift.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(best_fit_plan(histogram, capacity) or [(0, 0, 0, 0, 0)], dtype=np.int64)
    ranked = pieces.join(shift.drop("n"), ["length", "part"]).withColumn("rank", F.col("local") + F.col("shift"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(tidy(_place(plan)), out)
