"""Merkle manifest of a dataset: a tree a group, a tree over the groups, and a proof for every row.

1. Leaves.  A row is read once and becomes the digest of its fields (and of its
   fields after tampering, where that changes any); texts go no further.
2. Places.  Leaves are dealt by range of (group, id, leaf); a partition's first
   place is the sum of the sizes before it, so no group is sorted in one task.
3. Nodes.  Blocks of 512 consecutive leaves are hashed up three levels in place;
   their tops are the leaves of the next three levels, and so on.  All nodes
   above the blocks are written as a table by (tree, level, place).
4. Proofs.  From its place and the size of its group follow the places of the
   siblings a leaf needs.  Those inside its block lie in its own row.  Those
   above are the same for the whole block: they are exploded, joined to the
   table of nodes, put in order and concatenated, and every leaf is folded
   through them.  A node is asked for by more blocks the higher it lies, and
   stands in the table as many times more often, by a salt; so no key is hot.

The tree over the groups is one more tree, whose leaves are the groups' roots.
All digests are lowercase hex and are joined as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, parts

FAN = 8  # children of a node; LEVELS and the shifts by 3 bits follow from it
LEVELS = 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_RUNS = 100_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the columns, concatenated."""
    return F.sha2(F.concat(*columns).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def lower_case_thirds(columns: dict[str, Column]) -> dict[str, Column]:
    """A tampering: the text's A-Z in small letters where 3 divides the CRC-32 of the decimal id."""
    hit = F.crc32(columns["doc_id"].cast("string").cast("binary")) % 3 == 0
    return columns | {"text": F.when(hit, F.translate(columns["text"], CAPITALS, SMALL)).otherwise(columns["text"])}


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id", tampering=lower_case_thirds) -> DataFrame:
    """One row per input row: row (any distinct number), doc_id, grp (the group, ``-`` if null, else ``=`` and its value), leaf, changed.

    changed: the digest after ``tampering``, which takes and returns columns by name; null where it is the same.
    """
    plain = {c: F.col(f"`{c}`") for c in fields}
    grp = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    made = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        grp.alias("grp"),
        digest(*map(field, plain.values())).alias("leaf"),
        digest(*map(field, tampering(plain).values())).alias("changed"),
    )
    return made.withColumn("changed", F.nullif("changed", F.col("leaf")))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with tree (place of the first row of the group), n (rows of the group) and idx (place in it, from 0).

    Places are by ``group`` and then ``order``, nulls first.  The order has to
    tell all rows apart, so that a partition holds no more than its range.
    """
    by = [F.asc_nulls_first(c) for c in (group, *order)]
    dealt = rows.repartitionByRange(parts(rows.sparkSession), *by).sortWithinPartitions(*by)
    # The number's upper bits are the partition, the lower 33 the place in it.
    dealt = materialise(dealt.withColumn("at", F.monotonically_increasing_id()).withColumns({"part": F.shiftright("at", 33), "at": F.expr("at & 8589934591")}), "ordered")
    runs = materialise(dealt.groupBy("part", group).agg(F.min("at").alias("low"), F.count("*").alias("k")), "runs")
    sizes = runs.groupBy("part").agg(F.sum("k").alias("size"))
    sizes = sizes.select("part", F.expr("coalesce(sum(size) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("before"))  # a row a partition
    runs = runs.join(F.broadcast(sizes), "part").withColumn("first", F.col("before") + F.col("low"))
    groups = runs.groupBy(group).agg(F.min("first").alias("tree"), F.sum("k").alias("n"))
    runs = materialise(runs.join(groups, group).select("part", group, "tree", "n", (F.col("before") - F.col("tree")).alias("shift")), "runs")
    # A group of many rows lies in many partitions, so this key isn't hot.
    joined = dealt.join(F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs, ["part", group])
    return joined.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def depth(n: str = "n") -> str:
    """SQL for the levels above ``n`` leaves: the least d with 8 ** d >= n."""
    return f"size(filter(sequence(0, 20), d -> shiftleft(1L, {FAN.bit_length() - 1} * d) < {n}))"


def _up(nodes: str) -> str:
    """SQL for the next level of an array of digests."""
    return f"transform(sequence(0, (size({nodes}) - 1) div {FAN}), i -> sha2(array_join(slice({nodes}, {FAN} * i + 1, {FAN}), ''), 256))"


def _blocks(nodes: DataFrame, level: int) -> DataFrame:
    """Rows (tree, n, block, items, l0, l1, l2, top) of nodes (tree, n, idx, item with its digest) of a level.

    l0 to l2 are the block's nodes of the three levels from this one, as far as
    the tree goes on; top is its node above them, or the tree's root.
    """
    held = nodes.groupBy("tree", "n", F.shiftright("idx", 3 * LEVELS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "item"))).alias("items"))
    held = held.withColumn("items", F.expr("transform(items, x -> x.item)")).withColumns({"l0": F.expr("transform(items, x -> x.digest)"), "left": F.expr(f"{depth()} - {level}")})
    for k in range(1, LEVELS + 1):
        held = held.withColumn(f"l{k}", F.when(F.col("left") >= k, F.expr(_up(f"l{k - 1}"))))
    return held.withColumn("top", F.coalesce(*(F.col(f"l{k}") for k in range(LEVELS, -1, -1)))[0]).drop("left", f"l{LEVELS}")


def forest(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks of leaves, nodes above them, roots) of leaves (tree, n, idx, item with its digest).

    Nodes are rows (tree, level, idx, digest) of levels from LEVELS on, roots rows (tree, n, root).
    """
    lowest = blocks = materialise(_blocks(nodes, 0), "blocks")
    above, roots, level = [], [], 0
    highest = nodes.agg(F.expr(depth("max(n)"))).first()[0]  # one number
    while True:
        roots.append(blocks.filter(f"{depth()} <= {level + LEVELS}").select("tree", "n", F.col("top").alias("root")))
        level += LEVELS
        if level >= (highest or 0):
            break
        tops = blocks.filter(f"{depth()} > {level}").select("tree", "n", F.col("block").alias("idx"), F.struct(F.col("top").alias("digest")).alias("item"))
        blocks = materialise(_blocks(tops, level), "blocks")
        for k in range(LEVELS):
            place = F.col("block") * (BLOCK >> 3 * k) + F.col("pos")
            above.append(blocks.select("tree", "block", F.posexplode(f"l{k}").alias("pos", "digest")).select("tree", F.lit(level + k).alias("level"), place.alias("idx"), "digest"))
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    table = union(above) if above else nodes.select("tree", F.lit(0).alias("level"), "idx", F.lit("").alias("digest")).limit(0)
    return lowest, materialise(table, "nodes"), materialise(union(roots), "roots")


def _salts(level: str) -> str:
    """SQL for the times a node stands in the table: about a block in 448 asks for one of them."""
    return f"shiftleft(1L, 3 * greatest({level} - 5, 0))"


def _above(blocks: DataFrame, nodes: DataFrame, beyond: DataFrame | None) -> DataFrame:
    """Rows (tree, block, above): for each block the siblings (left, right) of every level above it.

    ``beyond`` has rows (tree, n, path) and more columns: what follows on each
    tree's root, and columns that are passed on.
    """
    headers = blocks.select("tree", "n", "block", F.expr(depth()).alias("depth"))
    asked = headers.filter(f"depth > {LEVELS}").select("*", F.expr(f"explode(sequence({LEVELS}, depth - 1)) as level"))
    asked = asked.withColumn("own", F.expr(f"shiftright(block, 3 * (level - {LEVELS}))"))
    last = f"least(own - own % {FAN} + {FAN - 1}, shiftright(n - 1, 3 * level))"
    asked = asked.select("tree", "block", "level", "own", F.expr(f"explode(filter(sequence(own - own % {FAN}, {last}), i -> i != own)) as idx"), F.expr(f"block % {_salts('level')} as salt"))
    salted = nodes.select("*", F.expr(f"explode(sequence(0L, {_salts('level')} - 1)) as salt"))
    found = asked.join(salted, ["tree", "level", "idx", "salt"])
    sides = found.groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("level", "idx", (F.col("idx") < F.col("own")).alias("before"), "digest"))).alias("siblings"))
    side = lambda test: f"array_join(transform(filter(siblings, s -> s.level = l and {test}), s -> s.digest), '')"
    path = f"if(depth > {LEVELS}, transform(sequence({LEVELS}, depth - 1), l -> named_struct('left', {side('s.before')}, 'right', {side('not s.before')})), cast(array() as array<struct<left: string, right: string>>))"
    known = headers.join(sides, ["tree", "block"], "left").withColumn("siblings", F.expr("coalesce(siblings, cast(array() as array<struct<level: int, idx: bigint, before: boolean, digest: string>>))"))
    known = known.select("tree", "n", "block", F.expr(path).alias("above"))
    if beyond is not None:
        salts = f"(n - 1) div {BLOCK * BLOCK} + 1"
        many = beyond.select("tree", "path", *_more(beyond), F.expr(f"explode(sequence(0L, {salts} - 1)) as salt"))
        known = known.withColumn("salt", F.expr(f"block % ({salts})")).join(many, ["tree", "salt"]).withColumn("above", F.concat("above", "path"))
    return known.select("tree", "block", "above", *_more(beyond))


def _more(beyond: DataFrame | None) -> list[str]:
    return [c for c in beyond.columns if c not in ("tree", "n", "path")] if beyond is not None else []


def paths(blocks: DataFrame, nodes: DataFrame, beyond: DataFrame | None = None) -> DataFrame:
    """The items of all leaves with path, an array of (left, right): the joined siblings of each level up to the root, and on through ``beyond``."""

    def local(k: int) -> str:
        first, own = f"(shiftright(i, {3 * k}) - shiftright(i, {3 * k}) % {FAN})", f"shiftright(i, {3 * k})"
        left, right = f"slice(l{k}, {first} + 1, {own} - {first})", f"slice(l{k}, {own} + 2, {first} + {FAN - 1} - {own})"
        return f"named_struct('left', array_join({left}, ''), 'right', array_join({right}, ''))"

    inside = f"slice(array({', '.join(f'if(depth > {k}, {local(k)}, null)' for k in range(LEVELS))}), 1, depth)"
    told = blocks.withColumn("depth", F.expr(f"cast(least({depth()}, {LEVELS}) as int)")).join(_above(blocks, nodes, beyond), ["tree", "block"])
    items = told.select("tree", "above", *_more(beyond), F.expr(f"inline(transform(items, (x, i) -> named_struct('item', x, 'inside', {inside})))"))
    return items.select("tree", "item.*", *_more(beyond), F.concat("inside", "above").alias("path"))


def fold(start: Column, path: str = "path") -> Column:
    """The root that ``start`` leads to along a path of siblings."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def prove(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id", tampering=lower_case_thirds) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the row's ``fields``, null as ``-``, others with
    their length.  In each group leaves ascend by id and then digest, nulls
    first, a null group being one of its own and the first; runs of eight nodes
    become the digest of them, a last run of fewer too, until one is left: the
    subroot.  Subroots by group in the order of UTF-8 bytes likewise give root.
    proof_sha256 is the digest of all siblings on the way, level by level and
    from left to right.  folded_root is what ``tampering``'s row leads to with
    the untampered siblings; verified is whether that is root.  Rows that repeat
    an id, or all of a row, are leaves of their own; a null id isn't tampered
    with; other columns are ignored; an empty table gives no rows.  Texts are
    read whole and once, and only digests are shuffled.
    """
    read = materialise(leaves(docs, fields, group, id_col, tampering), "leaves")
    item = F.struct(F.col("leaf").alias("digest"), "doc_id", "changed")
    placed = numbered(read, "grp", ["doc_id", "leaf", "row"]).select("tree", "n", "idx", item.alias("item"))
    blocks, nodes, roots = forest(placed)

    tree, size = F.col("tree").alias("group_tree"), F.col("n").alias("size")
    tops = numbered(roots.select(F.lit("").alias("all"), tree, size, "root"), "all", ["group_tree"])
    top_blocks, top_nodes, root = forest(tops.select("tree", "n", "idx", F.struct(F.col("root").alias("digest"), "group_tree", "size").alias("item")))
    first = root.first()  # one row, or none of an empty table
    beyond = paths(top_blocks, top_nodes).select(F.col("group_tree").alias("tree"), F.col("size").alias("n"), "path", F.col("digest").alias("subroot"))
    beyond = materialise(beyond.withColumn("root", F.lit(first.root if first else None)), "beyond")

    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
    proven = paths(blocks, nodes, beyond).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("changed", "digest")).alias("folded_root")
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """DuckDB SQL for the default of :func:`prove`: levels and proofs by recursion over the levels."""
    made = " || ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in FIELDS)
    changed = made.replace("cast(text as varchar)", f"translate(cast(text as varchar), '{CAPITALS}', '{SMALL}')")
    # CRC-32 bit by bit over the digits of the id
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    digits = "list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], {digits}), lambda c, b: {bits}), 4294967295)"
    tree = """{name}(grp, level, idx, d, n) as (
  select grp, 0, row_number() over (partition by grp order by {order}) - 1, {digest}, count(*) over (partition by grp) from {source}
  union all
  select grp, level + 1, idx // 8, sha256(string_agg(d, '' order by idx)), (n + 7) // 8 from {name} where n > 1 group by grp, level, n, idx // 8)"""
    walk = """{name}_way as (
  select grp, idx as own, level, idx, '' as lefts, '' as rights, n from {name} where level = 0
  union all
  select grp, own, level + 1, idx // 8, '', '', (n + 7) // 8 from {name}_way where n > 1),
{name}_path as (
  select p.grp, p.own, list({{'l': {left}, 'r': {right}}} order by p.level) as path from {name}_way p where n > 1 group by p.grp, p.own)"""

    def both(name: str, order: str, digest: str, source: str) -> str:
        sides = {s: f"coalesce(list_aggregate(list_transform(list_filter(runs.nodes, lambda x: x.idx {sign} p.idx), lambda x: x.d), 'string_agg', ''), '')" for s, sign in (("left", "<"), ("right", ">"))}
        runs = f"{name}_runs as (select grp, level, idx // 8 as run, list({{'idx': idx, 'd': d}} order by idx) as nodes from {name} group by all)"
        way = walk.format(name=name, **sides).replace(f"from {name}_way p where n > 1", f"from {name}_way p join {name}_runs runs on runs.grp = p.grp and runs.level = p.level and runs.run = p.idx // 8 where n > 1")
        return ",\n".join([tree.format(name=name, order=order, digest=digest, source=source), runs, way])

    return f"""with recursive leaves as (
  select doc_id, coalesce('=' || lang, '-') as grp, sha256({made}) as leaf,
    case when {crc} % 3 = 0 then sha256({changed}) else sha256({made}) end as seen from documents),
placed as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as place from leaves),
{both("low", "doc_id nulls first, leaf", "leaf", "leaves")},
subroots as (select grp as name, d as subroot from low where n = 1),
{both("high", "encode(name)", "subroot", "(select '' as grp, * from subroots)")},
named as (select name, subroot, row_number() over (order by encode(name)) - 1 as place from subroots),
ways as (
  select doc_id, leaf, seen, subroot, (select d from high where n = 1) as root, coalesce(a.path, []) || coalesce(b.path, []) as path
  from placed join named on grp = name left join low_path a on a.grp = placed.grp and a.own = placed.place left join high_path b on b.own = named.place),
folded as (
  select *, list_reduce(list_prepend({{'l': seen, 'r': ''}}, path), lambda acc, s: {{'l': sha256(s.l || acc.l || s.r), 'r': ''}}).l as folded_root from ways)
select doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda s: s.l || s.r), 'string_agg', ''), '')) as proof_sha256, folded_root, folded_root = root as verified
from folded"""
