"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

1. Windows.  A window is as long as a benchmark text.  Of a text's m shingles,
   any window with similarity t or more holds at least one of m - ceil(t * m) + 1
   fixed ones, its anchors (the rarest of the benchmark).  So windows without an
   anchor of a text of their length need no fingerprint; it doesn't matter whose
   anchor a window holds.
2. Fingerprints.  Each of these windows gets a SimHash of 128 bits.  It is cut
   into eight blocks of 16 bits, and every benchmark text is listed under all
   block values up to ``radius`` / 8 bits from its own; so a window meets, by
   equal values, all texts of its length within the radius.  These pairs are all
   candidates there are.  At similarity 0.75 two fingerprints are 22 bits apart
   on average, with a standard deviation of 4, so radius 31 reaches 98 % of such
   windows and practically all of those that are more similar.
3. Check.  Candidates are verified by the weighted Jaccard similarity of their
   shingles (weight: multiplicity).

Ids and fingerprints alone go through the join; shingles are fetched last.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise

SHINGLE = 5
SIMILARITY_PERCENT = 75
BLOCKS = 8
RADIUS = 31
BROADCAST_ANCHORS = 100_000
BROADCAST_LEAKS = 1_000_000


def shingle_hashes(text: str) -> Column:
    """Hashes of the 5-word shingles of a text in order; null for fewer words or a null text."""
    hashed = f"transform(filter(split(lower(`{text}`), '[ \\t-\\r]+'), w -> w <> ''), w -> xxhash64(w))"
    window = ", ".join(f"h[i + {j}]" for j in range(SHINGLE))
    made = f"if(size(h) >= {SHINGLE}, transform(sequence(0, size(h) - {SHINGLE}), i -> xxhash64({window})), null)"
    return F.expr(f"get(transform(array({hashed}), h -> {made}), 0)")


def _simhash(items: str) -> str:
    """SQL for the 64-bit SimHash of an array of hashes: bit b is set if more than half of them have it.

    Bits are counted several at a time, in lanes of a long wide enough for the array's size.
    """

    def by_lanes(width: int) -> str:
        ones = sum(1 << at for at in range(0, 64, width))
        sums = ", ".join(f"aggregate({items}, 0L, (c, h) -> c + (shiftrightunsigned(h, {k}) & {ones}L))" for k in range(width))
        votes = f"2 * (shiftrightunsigned(c[b % {width}], b - b % {width}) & {(1 << width) - 1}L)"
        return f"get(transform(array(array({sums})), c -> aggregate(sequence(0, 63), 0L, (fp, b) -> fp | if({votes} > size({items}), shiftleft(1L, b), 0L))), 0)"

    # The highest lane's count stays below half its range, lest the sum overflow.
    return f"case when size({items}) < 128 then {by_lanes(8)} when size({items}) < 32768 then {by_lanes(16)} else {by_lanes(32)} end"


def simhash(items: str) -> Column:
    """64-bit SimHash of an array of hashes."""
    return F.expr(_simhash(items))


def fingerprint(items: str) -> Column:
    """128-bit SimHash of an array of hashes: a struct of lo, by the hashes' own bits, and hi, by those of their hashes."""
    again = f"transform({items}, h -> xxhash64(h))"
    return F.struct(simhash(items).alias("lo"), F.expr(f"get(transform(array({again}), again -> {_simhash('again')}), 0)").alias("hi"))


def block_values(fp: str, bits: int = 0, blocks: range = range(BLOCKS)) -> Column:
    """Array of (block, value): the values of each 16-bit block of a fingerprint up to ``bits`` bits away."""
    masks = [sum(1 << b for b in chosen) for n in range(bits + 1) for chosen in combinations(range(16), n)]
    listed, wanted = f"array({', '.join(map(str, masks))})", f"array({', '.join(map(str, blocks))})"
    value = f"cast(shiftrightunsigned(if(b < 4, {fp}.lo, {fp}.hi), 16 * (b % 4)) & 65535L as int)"
    return F.expr(f"flatten(transform({wanted}, b -> transform({listed}, x -> struct(b as block, {value} ^ x as value))))")


def near_texts(windows: DataFrame, texts: DataFrame, radius: int = RADIUS, blocks: range = range(BLOCKS)) -> DataFrame:
    """``windows`` (m, fp and more columns) with the item of each of ``texts`` (item, m, ifp) of length m within ``radius`` bits.

    All of them are met if ``blocks`` are all blocks: of two fingerprints within
    the radius one of the blocks differs in at most radius / BLOCKS bits.

    An item has 5,576 rows here, of which the planner's estimate knows nothing:
    left to it, they all go through the driver.  So both sides are shuffled; a
    fingerprint goes once, however many windows have it.
    """
    prints = windows.select("m", "fp").distinct()
    left = prints.withColumn("b", F.explode(block_values("fp", 0, blocks))).select("*", "b.*").drop("b")
    right = texts.select("item", "m", "ifp", F.explode(block_values("ifp", radius // BLOCKS, blocks)).alias("b")).select("item", "m", "ifp", "b.*")
    apart = F.bit_count(F.expr("fp.lo ^ ifp.lo")) + F.bit_count(F.expr("fp.hi ^ ifp.hi"))
    near = left.join(right.hint("merge"), ["m", "block", "value"]).filter(apart <= radius).select("m", "fp", "item").distinct()
    others = [c for c in windows.columns if c != "fp"]
    return windows.join(near, ["m", "fp"]).select(*others, "item")


def _common(a: str, b: str) -> str:
    """SQL for the size of the multiset intersection of two arrays."""
    counted = f"aggregate(array_distinct({a}), 0, (c, h) -> c + least(size(filter({a}, x -> x = h)), size(filter({b}, x -> x = h))))"
    plain = f"size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b})"
    return f"if({plain}, size(array_intersect({a}, {b})), {counted})"


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """The rows whose weighted Jaccard similarity c / u of xs and ys is at least ``percent`` / 100."""
    # As a generator the costly count is made once; a filter on a column would repeat it wherever it is used.
    kept = f"inline(filter(array(named_struct('c', {_common('xs', 'ys')})), s -> s.c * 100 >= (size(xs) + size(ys) - s.c) * {percent}))"
    return pairs.select("*", F.expr(kept)).withColumn("u", F.size("xs") + F.size("ys") - F.col("c"))


def _benchmark_texts(benchmark: DataFrame, text_col: str, item_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows (item_id, item), rows (item, m, ys, ifp)): ids may repeat or be null, and a repeated text is one."""
    listed = benchmark.select(F.col(item_col).alias("item_id"), shingle_hashes(text_col).alias("ys")).filter("ys is not null")
    listed = listed.withColumns({"item": F.xxhash64("ys"), "m": F.size("ys")})
    texts = listed.dropDuplicates(["item"]).select("item", "m", "ys", fingerprint("ys").alias("ifp"))
    return listed.select("item_id", "item").distinct(), materialise(texts, "items")


def _anchors(texts: DataFrame, percent: int) -> DataFrame:
    """Rows (h, lengths): the lengths of texts that have an anchor with hash h, ranked per text by rarity in the benchmark."""
    places = texts.select("item", "m", F.posexplode("ys").alias("at", "h"))
    rarity = places.groupBy("h").agg(F.countDistinct("item").alias("df"))
    ranked = places.join(rarity, "h").groupBy("item", "m").agg(F.array_sort(F.collect_list(F.struct("df", "h", "at"))).alias("a"))
    need = F.expr(f"m - cast(ceil(m * {percent} / 100D) as int) + 1")
    anchors = ranked.select("m", F.explode(F.slice("a", F.lit(1), need)).alias("x")).select("m", "x.h")
    return materialise(anchors.groupBy("h").agg(F.collect_set("m").alias("lengths")), "anchors")


def _matches(rows: DataFrame, keys: list[str], texts: DataFrame, percent: int, radius: int) -> DataFrame:
    """Rows (keys, item, first, c, u): each window of ``rows`` (keys, text) that is similar to a benchmark text.

    Rows with equal keys have equal texts.
    """
    anchors = _anchors(texts, percent)
    least = f"cast(ceil(m * {percent} / 100D) as int)"
    # The exploded rows hold a place and a hash only: with the array beside them a long text would cost its length squared.
    # outer: the filter that Spark derives for an inner explode would compute the shingles twice
    places = rows.select(*keys, F.posexplode_outer(shingle_hashes("text")).alias("pos", "h"))
    hits = places.join(F.broadcast(anchors) if anchors.count() <= BROADCAST_ANCHORS else anchors, "h").select(*keys, "pos", F.explode("lengths").alias("m"))
    met = materialise(hits.groupBy(*keys, "m").agg(F.collect_set("pos").alias("places")), "met")
    some = met.select(*keys).distinct()
    some = F.broadcast(some) if met.count() <= BROADCAST_LEAKS else some
    held = _beside(rows, some, keys, "left_semi").dropDuplicates(keys).select(*keys, shingle_hashes("text").alias("xs"))
    held = materialise(held, "held")

    # Every start at which a window of length m holds an anchor; windows cut to less than percent of m can't match.
    starts = f"array_distinct(flatten(transform(places, pos -> sequence(greatest(pos - m + 1, {least} - m), least(pos, size(xs) - {least})))))"
    inside = "slice(xs, greatest(first, 0) + 1, greatest(m + least(first, 0), 1))"
    windows = _beside(met, held, keys).filter(f"size(xs) >= {least}").select(*keys, "m", "xs", F.explode(F.expr(starts)).alias("first"))
    printed = windows.select(*keys, "m", "first", F.expr(inside).alias("xs")).select(*keys, "m", "first", fingerprint("xs").alias("fp"))
    found = near_texts(materialise(printed, "windows"), texts, radius)
    full = _beside(found, held, keys).withColumn("xs", F.expr(inside)).join(texts.select("item", "ys"), "item")
    return _similar(full, percent).select(*keys, "item", F.greatest("first", F.lit(0)).alias("first"), "c", "u")


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on keys, of which any but the last may be null."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.col(keys[-1]) == F.col(f"_{keys[-1]}")
    for k in keys[:-1]:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, same, how).drop(*(f"_{k}" for k in keys))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = SIMILARITY_PERCENT,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, first_shingle, n_windows, similarity.

    Texts are lower-cased and cut at U+0020 and U+0009..U+000D.  A match is a
    window of a document as long as the item (cut where the document begins or
    ends), whose SimHash lies within ``radius`` bits of the item's and whose
    weighted Jaccard similarity of 5-word shingles with the item is at least
    ``percent`` / 100; the row has the best one, the first of equals, and
    n_windows counts all of them.  Null and empty texts and those of fewer than
    five words match nothing, on either side.  Rows that repeat an id count as
    one document or item, as do rows with a null id, but each text is looked at
    by itself, and repeated ones count once.  Other columns are ignored; an
    empty table gives no rows.  Texts are looked at whole; a very long one is
    an array of its shingles in one row, at 8 bytes a word and a few copies.
    """
    listed, texts = _benchmark_texts(benchmark, text_col, item_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    found = _matches(rows, ["doc_id", "text_key"], texts, percent, radius).join(listed, "item").distinct()
    found = found.withColumn("similarity", F.col("c") / F.col("u"))
    best = F.min_by("first", F.struct(-F.col("similarity"), "first")).alias("first_shingle")
    return found.groupBy("doc_id", "item_id").agg(best, F.count("*").alias("n_windows"), F.max("similarity").alias("similarity"))


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, percent: int = SIMILARITY_PERCENT, radius: int = RADIUS, text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """The rows of ``docs`` in whose text :func:`find_leaks` finds no benchmark item, whatever their ids.

    Texts with a leak are known by hash and length.  Up to BROADCAST_LEAKS of
    them are broadcast, so the rows stay where they are; more are joined by shuffle.
    """
    _, texts = _benchmark_texts(benchmark, text_col, item_col)
    known = {"text_hash": F.xxhash64(text_col), "text_length": F.length(text_col)}
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), *(c.alias(n) for n, c in known.items()))
    found = materialise(_matches(rows, [*known], texts, percent, radius).select(*known).distinct(), "leaks")
    bad = F.broadcast(found) if found.count() <= BROADCAST_LEAKS else found
    return docs.join(bad, (F.xxhash64(docs[text_col]) == bad["text_hash"]) & (F.length(docs[text_col]) == bad["text_length"]), "left_anti")
