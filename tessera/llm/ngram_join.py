"""N-gram Jaccard self-join: PartEnum candidates, exact links, components.

Passes over the texts, all linear in their words:

1. shingle sets -> one row a document (size, set hash, parity sketch) and a
   fixed-size count sketch of all shingles;
2. PartEnum signatures, shuffled as packed arrays of 32 bits by signature range; a range
   keeps the signatures that two different sets share (``buckets``);
3. inside a bucket, pairs whose parity sketches differ in more bits than linked
   sets can differ in elements are dropped, which loses no link.  Buckets with
   few remaining pairs send on all of them; of a bucket of many, a first round
   sends on a forest, and once its links are known a last round whatever still
   joins two components.  A bucket of more than SPLIT sets is dealt into
   sub-buckets, each looked at by itself; then one set of each component is, and
   what is still apart meets in cells of two sub-buckets, each in a task's reach;
4. the pairs sent on are checked on their whole shingle sets.

Nodes are sets, told apart by a 64-bit hash of their shingles, and ids are met
only at the end; so it doesn't matter whether ids repeat or are null.  Copies
with equal sets are one node throughout: a group of thousands of exact copies
costs as much as one document, and a group of near copies sends on about one
pair a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import partenum
from tessera.llm.arrowkit import annotate, field, list_array, list_values, tidy, whole_groups
from tessera.llm.components import connected_components
from tessera.llm.shared import materialise, parts
from tessera.llm.wordhash import Words, chunks, mix, shingles, text_buffer

SKETCH_CELLS = 1 << partenum.SKETCH_BITS
SKETCH_BLOCK = 4096
FLUSH = 1_200_000
RANGE_SHINGLES = 4_000_000
PAIR_ROWS = 250_000
SPLIT = 8192
HUB_CHUNKS = 64
NO_ID = (1 << 63) - 1  # stands in for a null id, so that it sorts last
BITMAP_BITS = 1 << 23
WITHIN, LEFT, RIGHT = 0, 1, 2  # sides of a deal
_SET_SEED = np.uint64(0x632BE59BD9B4E019)


def _sets(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, shingle hashes, bounds) of runs a..b-1 of texts."""
    data, off = text_buffer(text)
    for a, b in chunks(off):
        yield a, b, *shingles(Words(data[off[a] : off[b]], off[a : b + 1] - off[a]))


def _set_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ _SET_SEED), dtype=np.uint64)))
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def parity(values: np.ndarray) -> np.ndarray:
    """Bit j: parity of the number of elements that hash to j; 2 to 4 bits an element, a power of two.

    Every element in one of two sets only flips one bit, so sketches cut to
    equal length differ in no more bits than the sets differ in elements.
    """
    bits = 64
    while bits < 2 * len(values):
        bits *= 2
    at = ((values >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).view(np.int64)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH_CELLS, dtype=np.int32)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32())]
    names = ["doc_id", "n_shingles", "node", "parity", "block", "counts"]
    for batch in batches:
        for a, b, values, bounds in _sets(batch.column("text")):
            counts += np.bincount((values & np.uint64(SKETCH_CELLS - 1)).astype(np.int64), minlength=SKETCH_CELLS).astype(np.int32)
            sizes, n = np.diff(bounds), b - a
            sketches = [parity(values[x:y]) if y > x else values[:0].view(np.int64) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            lengths = np.concatenate(([0], np.cumsum([len(s) for s in sketches])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, n),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(_set_hashes(values, bounds), mask=sizes == 0),
                    list_array(np.concatenate(sketches) if n else values.view(np.int64), lengths, pa.int64()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.list_(pa.int32())),
                ],
                names,
            )
    blocks = SKETCH_CELLS // SKETCH_BLOCK
    used = np.flatnonzero(counts.reshape(blocks, -1).any(axis=1))
    if len(used):
        flat = counts.reshape(blocks, -1)[used].ravel()
        lists = list_array(flat, np.arange(len(used) + 1) * SKETCH_BLOCK, pa.int32())
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), k) for k in kinds[:4]), pa.array(used.astype(np.int32)), lists], names)


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        flat, _ = list_values(batch.column("counts"))
        for block, row in zip(batch.column("block").to_pylist(), flat.reshape(-1, SKETCH_BLOCK), strict=True):
            held[block] = held[block] + row if block in held else row.astype(np.int64)
    for block, row in held.items():
        top = np.minimum(row, np.iinfo(np.int32).max)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), list_array(top, np.array([0, len(row)]), pa.int32())], ["block", "counts"])


def _count_sketch(profile: DataFrame) -> np.ndarray:
    """The merged count sketch; 4 MB on the driver whatever the input."""
    blocks = profile.filter("block is not null").select("block", "counts").repartition(parts(profile.sparkSession), "block")
    sketch = np.zeros(SKETCH_CELLS, dtype=np.uint32)
    for row in blocks.mapInArrow(tidy(_merge_blocks), "block int, counts array<int>").toLocalIterator():
        sketch[row.block * SKETCH_BLOCK : (row.block + 1) * SKETCH_BLOCK] = row.counts
    return sketch


def _signature_rows(sketch, ranges: int):
    """Signatures by range, of which 32 bits travel: other bits than those that tell the range.

    As a range holds a bounded number of them, few unlike ones come to be alike,
    and these make buckets larger; a bucket that is too large loses no pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, first = sketch.value, partenum.bands(1 << 40)
        sigs: list[np.ndarray] = []
        nodes: list[int] = []
        total, seen = 0, set()

        def flush() -> pa.RecordBatch:
            all_sigs = np.concatenate(sigs)
            owner = np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
            part = ((all_sigs >> np.uint64(40)) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            all_sigs, owner, part = all_sigs[order], owner[order], part[order]
            used, start = np.unique(part, return_index=True)
            run_start = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(part, prepend=-1))
            run_len = np.diff(np.append(run_start, len(owner)))
            run_bounds = np.append(np.searchsorted(run_start, start), len(run_start))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(used.astype(np.int32)),
                    list_array(all_sigs.astype(np.uint32).view(np.int32), np.append(start, len(owner)), pa.int32()),
                    list_array(np.array(nodes, np.int64)[owner[run_start]], run_bounds, pa.int64()),
                    list_array(run_len, run_bounds, pa.int32()),
                ],
                ["part", "sigs", "nodes", "runs"],
            )

        for batch in batches:
            for _, _, values, bounds in _sets(batch.column("text")):
                for node, a, b in zip(_set_hashes(values, bounds).tolist(), bounds[:-1], bounds[1:], strict=True):
                    if b > a and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sigs.append(partenum.signatures(values[a:b], count, first))
                        total += len(sigs[-1])
                        if total >= FLUSH:
                            yield flush()
                            sigs, nodes, total, seen = [], [], 0, set()
        if nodes:
            yield flush()

    return run


def _shared(part: pa.Table) -> pa.Table:
    """Signatures of one range that two or more nodes have; equal member lists count once."""
    sig, _ = list_values(part.column("sigs"))
    node, _ = list_values(part.column("nodes"))
    runs, _ = list_values(part.column("runs"))
    node = np.repeat(node, runs)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
    sig, node = sig[fresh], node[fresh]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(sig)))
    code = np.add.reduceat(mix(node.view(np.uint64)), start) if len(sig) else np.zeros(0, np.uint64)
    many = np.flatnonzero(size > 1)
    _, pick = np.unique(code[many], return_index=True)
    pick = many[pick]
    rows = np.repeat(start[pick], size[pick]) + np.arange(size[pick].sum()) - np.repeat(np.cumsum(size[pick]) - size[pick], size[pick])
    return pa.table({"bucket": np.repeat(code[pick], size[pick]).view(np.int64), "node": node[rows].astype(np.int64)})


def _near(comp: np.ndarray, size: np.ndarray, sketch: np.ndarray, side: np.ndarray, forest: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places j) of one deal: pairs over two components that the sketches can't rule out.

    side is 0 throughout, or ascends from LEFT to RIGHT, and pairs are of both.
    forest: only enough of them to join those components, if all were links.
    """
    comp, right = comp.copy(), int(np.searchsorted(side, RIGHT))
    for i in range(right if side[0] else len(comp) - 1):
        after = right if side[0] else i + 1
        j = after + np.flatnonzero(comp[after:] != comp[i])
        if not len(j):
            continue
        small, big = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
        j = j[4 * small >= 3 * big]
        if len(j):
            bits = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            j = j[7 * bits <= size[j] + size[i]]
        if forest and len(j):
            met, at = np.unique(comp[j], return_index=True)
            j = j[at]
            comp[np.isin(comp, met)] = comp[i]
        if len(j):
            yield i, j


def _deals(members: DataFrame, large: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows (deal, side, node, n_shingles, parity) of the sets of each bucket, and of each cell of two sub-buckets.

    ``large`` has the buckets that are cut, (bucket, subs).  Each pair of a
    bucket's sets is in exactly one deal, which holds some SPLIT sets.
    """
    columns = ["node", "n_shingles", "parity"]
    if large is None:
        return members.select(F.col("bucket").alias("deal"), F.lit(WITHIN).alias("side"), *columns), None
    cut = members.join(large, "bucket", "left").withColumn("sub", F.expr("pmod(xxhash64(node), subs)"))
    own = F.when(F.col("subs").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "sub"))
    within = cut.select(own.alias("deal"), F.lit(WITHIN).alias("side"), *columns)
    met = cut.filter("subs is not null").withColumn("other", F.expr("explode(sequence(0L, subs - 1))")).filter("other <> sub")
    cell = F.xxhash64("bucket", F.least("sub", "other"), F.greatest("sub", "other"))
    return within, met.select("bucket", cell.alias("deal"), F.when(F.expr("sub < other"), LEFT).otherwise(RIGHT).alias("side"), *columns)


def _bucket_pairs(last: bool):
    """Rows (a, b) of nodes to check; but for the last round also (deal) of each deal that the last round has to see.

    Rows leave in batches of some PAIR_ROWS, however many a deal has.
    """

    def out(pairs: list[np.ndarray], again: list[int]) -> pa.RecordBatch:
        ab = np.concatenate([*pairs, np.zeros((0, 2), np.int64)])
        ab = np.unique(np.sort(ab, axis=1), axis=0)
        pads = pa.nulls(len(again), pa.int64())
        columns = [pa.array(np.ascontiguousarray(ab[:, i])) for i in (0, 1)] + [pa.nulls(len(ab), pa.int64())]
        more = [pads, pads, pa.array(again, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(columns, more, strict=True)], ["a", "b", "deal"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, again, rows = [], [], 0
        for group in whole_groups(batches, "deal"):
            deal = group.column("deal").to_numpy()
            node, comp, size, side = (group.column(c).to_numpy() for c in ("node", "comp", "n_shingles", "side"))
            flat, lengths = list_values(group.column("parity"))
            ends = np.cumsum(lengths)
            starts = np.append(np.flatnonzero(np.append(True, deal[1:] != deal[:-1])), len(deal))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if (comp[a:b] == comp[a]).all():
                    continue
                words = int(lengths[a:b].min())
                sketch = np.stack([fold(flat[e - n : e], words) for e, n in zip(ends[a:b], lengths[a:b], strict=True)])
                sketch = sketch.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
                found, many = [], 0
                if not last:
                    for i, j in _near(comp[a:b], size[a:b], sketch, side[a:b]):
                        found.append((i, j))
                        many += len(j)
                        if many > 4 * (b - a):
                            again.append(int(deal[a]))
                            break
                for i, j in _near(comp[a:b], size[a:b], sketch, side[a:b], forest=not last) if last or many > 4 * (b - a) else found:
                    pairs.append(np.column_stack((np.full(len(j), node[a + i]), node[a + j])))
                    rows += len(j)
                    if rows >= PAIR_ROWS:
                        yield out(pairs, again)
                        pairs, again, rows = [], [], 0
        if rows or again:
            yield out(pairs, again)

    return run


def _bitmap(ids: DataFrame):
    """Bits of the ids' hashes, in a broadcast of 1 MB whatever the input; false hits only cost work."""
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS))
    words = ids.select(cell.alias("c")).groupBy(F.shiftright("c", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(c & 63 as int)))").alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    for row in words.collect():
        bitmap[row.w] = row.bits
    return ids.sparkSession.sparkContext.broadcast(bitmap)


def _chosen_sets(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            hit = (bitmap.value[cell >> 6] >> (cell & 63)) & 1
            batch = batch.filter(pa.array(hit.astype(bool)))
            for a, b, values, bounds in _sets(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(_set_hashes(values, bounds)), list_array(values.view(np.int64), bounds, pa.int64())],
                    ["doc_id", "node", "items"],
                )

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) out of rows (hub, chunk, node, items) in this order: a hub's own set comes before those it is to meet."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        items, lengths = list_values(batch.column("items"))
        items, ends = items.view(np.uint64), np.cumsum(lengths)
        hubs, nodes = (batch.column(c).to_numpy() for c in ("hub", "node"))
        own_rows = batch.column("own").to_numpy(zero_copy_only=False)
        links = []
        for i in range(batch.num_rows):
            found = items[ends[i] - lengths[i] : ends[i]]
            if own_rows[i]:
                hub, own = hubs[i], found.copy()
            elif hub == hubs[i]:
                small, big = (found, own) if len(found) < len(own) else (own, found)
                at = np.searchsorted(big, small)
                inter = int((big[np.minimum(at, len(big) - 1)] == small).sum())
                if partenum.linked(inter, len(own), len(found)):
                    links.append((hub, nodes[i]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])


def _verify(texts: DataFrame, reps: DataFrame, pairs: DataFrame, ranges: int) -> DataFrame:
    """The pairs (a, b of nodes) whose whole shingle sets are linked.

    The first node of a pair is its hub (the centre, where a forest is a star).
    A hub's partners are dealt over HUB_CHUNKS chunks, and its set travels once
    to each chunk, not once to each partner.
    """
    pairs = pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.lit(HUB_CHUNKS)).cast("int"))
    roles = pairs.select(F.col("b").alias("node"), F.col("a").alias("hub"), "chunk", F.lit(False).alias("own"))
    roles = roles.unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("hub"), "chunk", F.lit(True).alias("own")).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(reps.join(ends, "node", "left_semi").select("node", F.col("doc").alias("doc_id")), "wanted")
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)).alias("cell")
    found = texts.select("doc_id", "text", cell).mapInArrow(tidy(_chosen_sets(_bitmap(wanted))), "doc_id long, node long, items array<long>")
    met = found.join(wanted.withColumnRenamed("doc_id", "wanted"), "node").filter("doc_id <=> wanted")
    sets = materialise(met.dropDuplicates(["node"]).select("node", "items"), "sets")
    dealt = roles.join(sets, "node").repartition(ranges, "hub", "chunk").sortWithinPartitions("hub", "chunk", F.desc("own"))
    return dealt.select("hub", "chunk", "own", "node", "items").mapInArrow(tidy(_meet), "a long, b long")


def _classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, n_shingles, node) of the texts, rows (node, root_doc, root_node) of the sets).

    A set's root is the least (id, set) it can reach by links; a null id counts
    as the largest.  Texts without words have a null node.
    """
    spark = texts.sparkSession
    schema = "doc_id long, n_shingles long, node long, parity array<long>, block int, counts array<int>"
    profile = materialise(texts.mapInArrow(tidy(_profile), schema), "profile")
    own = profile.filter("block is null").select("doc_id", "n_shingles", "node", "parity")
    reps = materialise(own.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc")), "reps")

    # Ranges hold a bounded part of the signatures, however many the shuffle partitions.
    ranges = max(parts(spark), int((own.agg(F.sum("n_shingles")).first()[0] or 0) // RANGE_SHINGLES) + 1)
    sketch = spark.sparkContext.broadcast(_count_sketch(profile))
    packed = texts.mapInArrow(tidy(_signature_rows(sketch, ranges)), "part int, sigs array<int>, nodes array<long>, runs array<int>")
    buckets = packed.groupBy("part").applyInArrow(_shared, "bucket long, node long").dropDuplicates(["bucket", "node"])
    buckets = materialise(buckets, "buckets")
    needed = buckets.select("node").distinct().join(reps, "node")
    sketches = own.join(needed, "node").filter("doc_id <=> doc").dropDuplicates(["node"]).select("node", "n_shingles", "parity")
    members = materialise(buckets.join(sketches, "node").select("bucket", "node", "n_shingles", "parity"), "members")

    subs = F.expr(f"cast(ceil(2 * count / {SPLIT}) as long)").alias("subs")
    large = materialise(members.groupBy("bucket").count().filter(F.col("count") > SPLIT).select("bucket", subs), "large")
    large = None if large.isEmpty() else large
    key = lambda c: F.struct(F.coalesce(f"{c}_doc", F.lit(NO_ID)).alias("doc"), F.col(c).alias("node"))
    links: DataFrame | None = None
    roots: DataFrame | None = None

    def with_comp(rows: DataFrame) -> DataFrame:
        known = rows if roots is None else rows.join(roots.select("node", F.col("root_node").alias("comp")), "node", "left")
        return known.withColumn("comp", F.coalesce("comp", "node") if roots is not None else F.col("node"))

    def settle(dealt: DataFrame, last: bool = False) -> DataFrame:
        """Finds the links of the deals' pairs and joins their components; the deals that the last round has to see."""
        nonlocal links, roots
        dealt = dealt if "comp" in dealt.columns else with_comp(dealt)
        dealt = dealt.select("deal", "side", "node", "comp", "n_shingles", "parity").repartition(ranges, "deal").sortWithinPartitions("deal", "side", "node")
        found = materialise(dealt.mapInArrow(tidy(_bucket_pairs(last)), "a long, b long, deal long"), "found")
        pairs = materialise(found.filter("deal is null").select("a", "b").distinct(), "pairs")
        if not pairs.isEmpty():
            more = _verify(texts, reps, pairs, parts(spark))
            for c in ("a", "b"):
                more = more.join(reps.select(F.col("node").alias(c), F.col("doc").alias(f"{c}_doc")), c)
            more = more.select(key("a").alias("a"), key("b").alias("b"))
            links = materialise(more if links is None else links.unionByName(more), "links")
            roots = materialise(connected_components(links).select("node.node", F.col("component.doc").alias("root_doc"), F.col("component.node").alias("root_node")), "components")
        return found.filter("deal is not null").select("deal").distinct()

    within, across = _deals(members, large)
    left = within.join(settle(within), "deal", "left_semi")
    if across is not None:
        # One set of each component first: where copies link, they are one component by then.
        apart = with_comp(members.join(large, "bucket")).groupBy("bucket", "comp").agg(*(F.min_by(c, "node").alias(c) for c in ("node", "n_shingles", "parity")))
        apart = materialise(apart, "apart")
        several = apart.groupBy("bucket").count().withColumn("subs", F.expr(f"cast(ceil(count / {SPLIT}) as long)"))
        leaders = apart.join(several, "bucket").withColumns({"deal": F.expr("xxhash64(bucket, pmod(xxhash64(comp, 1), subs))"), "side": F.lit(WITHIN)})
        settle(leaders)
        still = with_comp(members.join(large, "bucket", "left_semi")).groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
        across = materialise(across.join(still, "bucket", "left_semi").drop("bucket"), "across")
        left = left.unionByName(across.join(settle(across), "deal", "left_semi"))
    if not left.isEmpty():
        settle(left, last=True)

    if roots is None:
        roots = spark.createDataFrame([], "node long, root_doc long, root_node long")
    root_doc = F.nullif(F.coalesce("root_doc", "doc"), F.lit(NO_ID)).alias("root_doc")
    return own.drop("parity"), reps.join(roots, "node", "left").select("node", root_doc, F.coalesce("root_node", "node").alias("root_node"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are runs of characters other than U+0020, U+0009..U+000D of the text
    with A-Z lower-cased.  Sets of 5-word shingles (the whole sequence, if
    shorter) are linked if 100 * intersection >= 75 * union; component_id is the
    smallest doc_id reachable by links.  A null, empty or wordless text has no
    shingles and is linked with nothing.  Each row is a document of its own,
    also where ids repeat with other texts or are null; a null id takes part
    like any other, but is a component_id only where no id is reached.  Equal
    texts share a component; an empty table gives no rows; other columns are
    ignored.  Texts are read whole: a very long one is held in memory by one
    task, at some 60 bytes a character, and its set travels whole to where it
    is checked.  Shingles are told apart by 64-bit hashes.
    """
    own, classes = _classes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    out = own.join(classes, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("root_doc")).alias("component_id"))


def _nodes(text: str):
    """Rows (row, node, rank) of those whose rank is below all before them in the task with their set and id: of n copies in any order some log n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, int | None], int] = {}
        for batch in batches:
            docs, ranks = batch.column("doc").to_pylist(), batch.column("rank").to_pylist()
            for a, b, values, bounds in _sets(field(batch, text)):
                nodes, kept = _set_hashes(values, bounds), []
                for i, (key, rank) in enumerate(zip(zip(nodes.tolist(), docs[a:b], strict=True), ranks[a:b], strict=True)):
                    if rank < least.get(key, 1 << 63):
                        least[key] = rank
                        kept.append(i)
                at = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a).take(at), pa.array(nodes).take(at), batch.column("rank").slice(a, b - a).take(at)], ["row", "node", "rank"])

    return run


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` from each component of :func:`jaccard_components`, and all rows without words.

    The row that stays has the component's smallest id (a null id only where
    there is no other); of rows with that id it is one with the least set hash,
    and of several with that set too the text with the least hash.  Only this
    operator's last step moves whole rows, and it moves them once; rows without
    words stay where they are.
    """
    _, classes = _classes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    roots = classes.filter("node = root_node").select(F.xxhash64("node", "root_doc").alias("key"), F.col("node").alias("kept"), F.col("root_doc").alias("kept_doc"))
    has_word = F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Copies of one id and set are cut down where they are; those that go on are few in any task.
    rows = annotate(docs.filter(has_word), _nodes(text_col), [text_col], "node long, rank long", doc=F.col(f"`{id_col}`").cast("long"), rank=F.xxhash64(F.col(f"`{text_col}`")))
    doc = F.col("row").getField(id_col).cast("long")
    met = rows.withColumns({"doc": doc, "key": F.xxhash64("node", doc)}).join(roots, "key").filter("node = kept and doc <=> kept_doc")
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("rank"))).filter("nth = 1")
    return first.select("row.*").unionByName(docs.filter(~has_word))
