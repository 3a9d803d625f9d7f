"""Lookup, verification and join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import lookup, retrieval
from tessera.session import table

_WORDS = ["the", "stupid", "license", "ciónue", "und"]
_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIM = lambda a, b: f"(len(list_intersect({_TRI.format(a)}, {_TRI.format(b)}))::double / len(list_distinct(list_concat({_TRI.format(a)}, {_TRI.format(b)}))))"


def _statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand in for statutes: the type is the act, the number after # of the brand the section."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("act"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("section"), F.col("p_name").alias("title"))


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size 1..25 of a brand maps to size + 25."""
    part = table(spark, sf_dir, "part").filter("p_size <= 10").select("p_type", "p_brand", "p_size").distinct()
    number = F.split_part("p_brand", F.lit("#"), F.lit(2))
    return part.select(F.col("p_type").alias("old_act"), number.alias("old_section"), F.col("p_type").alias("new_act"), (F.col("p_size") + 25).cast("string").alias("new_section"))


LOOKUPS = {"a": ("small ring", "23"), "b": ("blue bolt", "30"), "c": ("red widget", "99")}


def multi_strategy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number that is a section, one that only a mapping has, and one that nothing has, so that the titles decide."""
    entries, mapping = _statutes(spark, sf_dir), _mapping(spark, sf_dir)
    found = [lookup.lookup(entries, text, section, None, mapping, 80).withColumn("asked", F.lit(k)) for k, (text, section) in LOOKUPS.items()]
    return lookup.union_all(found).select("asked", "id", "section", "strategy", F.round("score", 6).alias("score"))


def trigram_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    scored = supplier.select("s_suppkey", tx.trigram_similarity(F.col("s_name"), F.lit("Supplier 000000012")).alias("s"))
    return scored.filter("s > 0.3").select("s_suppkey", F.round("s", 6).alias("similarity"))


def coverage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("title", F.split("text", "\n")[0])
    return lookup.covering(docs, _WORDS, "title", "text", "doc_id")


def verify_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("known"))
    found = lookup.verify_citations(items, docs, "line", "known", "doc_id")
    return found.select("item_id", "line_no", "found", "match")


def citation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("t"))
    every = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("t")).unionByName(p)
    return every.select("k", tx.citation_key(F.col("t")).alias("key"), tx.base_section(F.replace(F.col("t"), F.lit("#"), F.lit("("))).alias("base"))


def section_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _statutes(spark, sf_dir).select("act", "section").distinct()
    refs = own.select("act", F.concat("section", F.lit("(1)")).alias("section")).unionByName(own).unionByName(own.select(F.lit("none").alias("act"), "section"))
    return lookup.verify_references(refs, own, _mapping(spark, sf_dir))


def or_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").filter("s_acctbal > 8000")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("left_key"), (24 - F.col("n_nationkey")).alias("right_key"), "n_name")
    return lookup.pairs_touching(supplier, nation, "s_nationkey", "left_key", "right_key")


def year_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    known = spark.createDataFrame([("A", 1993), ("B", 1996), ("C", 2010)], "name string, decided int")
    return lookup.within_band(orders, known, "year", "decided").select("o_orderkey", "year", "name", "decided")


def topn_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    top = retrieval.ranked(docs, [F.desc("n_chars"), F.asc("doc_id")], 20, "rank")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("vector_label"))
    near = F.broadcast(top).join(labels, "doc_id", "left").join(vectors, "doc_id", "left")  # 20 rows
    first = F.col("rank") <= 5
    return near.select("doc_id", "source", "rank", F.when(first, F.coalesce("quality", F.lit(-1))).alias("quality"), F.when(first, F.col("vector_label")).alias("vector_label"))


def unique_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").unionByName(spark.createDataFrame([(99, "ONLY")], "c_nationkey int, c_mktsegment string"))
    return lookup.unique_match(pages, "c_nationkey", "c_mktsegment")


def as_of_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    found = lookup.latest_earlier(events, ["user_id"], "ts", F.col("event_type") == "view", F.col("ts"), "last_view")
    return found.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_view").cast("timestamp"))).alias("micros_since_view"))


def exists_and_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    big = customer.join(orders.filter("o_totalprice > 300000"), "c_custkey", "left_semi")
    return big.join(orders.filter("o_orderstatus = 'P'"), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


QUERIES = {
    f.__name__: f
    for f in (multi_strategy_lookup, trigram_matches, coverage_rank, verify_refs, citation_key, section_references, or_join_pairs, year_band_join, topn_enrich, unique_only, as_of_previous, exists_and_not)
}
_STATUTES = "(select p_partkey as id, p_type as act, split_part(p_brand, '#', 2) as section, p_name as title from part)"
_MAP = "(select distinct p_type as old_act, split_part(p_brand, '#', 2) as old_section, p_type as new_act, (p_size + 25)::varchar as new_section from part where p_size <= 10)"
ORACLES = {
    "multi_strategy_lookup": " union all ".join(
        f"""
        select '{k}' as asked, * from (
        with s as {_STATUTES}, m as {_MAP},
        u as (
            select id, section, 'EXACT' as strategy, 1000.0::double as score from s where section = '{section}' union all
            select id, section, 'EXACT', 990 from s where split_part(section, '(', 1) = '{section}' union all
            select id, section, 'RECODIFIED', 950 from s where (act, section) in (select (new_act, new_section) from m where old_section = '{section}') union all
            select id, section, 'RECODIFIED', 900 from s where (act, section) in (select (old_act, old_section) from m where new_section = '{section}') union all
            select id, section, 'FULLTEXT', 20 from s where list_has_all(string_split_regex(lower(title), '[\\s.,;:!?]+'), string_split('{text}', ' ')) union all
            select id, section, 'FUZZY', sim from (select *, {_SIM('title', repr(text))} as sim from s) where sim > 0.3)
        select id, section, strategy, round(score, 6) as score from
            (select * from u qualify row_number() over (partition by id order by score desc, strategy) = 1) order by score desc, id limit 80)"""
        for k, (text, section) in LOOKUPS.items()
    ),
    "trigram_matches": f"select s_suppkey, round(s, 6) as similarity from (select s_suppkey, {_SIM('s_name', chr(39) + 'Supplier 000000012' + chr(39))} as s from supplier) where s > 0.3",
    "coverage_rank": """
        with d as (select doc_id, string_split_regex(lower(split_part(text, chr(10), 1)), '[\\s.,;:!?]+') as t, string_split_regex(lower(text), '[\\s.,;:!?]+') as b from documents),
        w as (select unnest(['the', 'stupid', 'license', 'ciónue', 'und']) as w),
        s as (select doc_id, count(*) filter (list_contains(t, w)) as title_hits, count(*) filter (list_contains(t, w) or list_contains(b, w)) as hits from d, w group by doc_id)
        select doc_id, title_hits, hits, 2 * title_hits + hits as score from s where hits > 0 order by score desc, doc_id limit 12
    """,
    "verify_refs": """
        with l as (select item_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10)))))::int as line_no from benchmark),
        i as (select item_id, line_no, upper(regexp_replace(line, '[^A-Za-z0-9]', '', 'g')) as k from l),
        d as (select upper(regexp_replace(line, '[^A-Za-z0-9]', '', 'g')) as k, min(doc_id) as m from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1)
        select item_id, line_no, m is not null as found, m as match from i left join d on i.k = d.k and d.k <> ''
    """,
    "citation_key": """
        with e as (select s_suppkey as k, s_name as t from supplier union all select p_partkey, p_brand from part)
        select k, upper(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) as key, split_part(replace(t, '#', '('), '(', 1) as base from e
    """,
    "section_references": f"""
        with own as (select distinct act, section from {_STATUTES}), m as {_MAP},
        refs as (select act, section || '(1)' as section from own union select act, section from own union select 'none', section from own),
        p as (select r.act, r.section, case
            when exists (select 1 from own o where o.act = r.act and o.section = r.section) then 1
            when exists (select 1 from own o where o.act = r.act and o.section = split_part(r.section, '(', 1)) then 2
            when exists (select 1 from m where (m.old_act = r.act and m.old_section = r.section) or (m.new_act = r.act and m.new_section = r.section)) then 3 end as preference from refs r)
        select act, section, preference, preference is not null as found from p
    """,
    "or_join_pairs": """
        with n as (select n_nationkey as left_key, 24 - n_nationkey as right_key, n_name from nation), s as (select distinct s_nationkey as k from supplier where s_acctbal > 8000)
        select * from n where left_key in (select k from s) or right_key in (select k from s)
    """,
    "year_band_join": """
        select o_orderkey, year(o_orderdate) as year, name, decided from orders, (values ('A', 1993), ('B', 1996), ('C', 2010)) k(name, decided)
        where abs(year(o_orderdate) - decided) <= 1
    """,
    "topn_enrich": """
        with t as (select doc_id, source, row_number() over (order by n_chars desc, doc_id) as rank from documents qualify rank <= 20)
        select t.doc_id, source, rank, case when rank <= 5 then coalesce(quality, -1) end as quality, case when rank <= 5 then label end as vector_label
        from t left join labels l on l.doc_id = t.doc_id left join embeddings e on e.vec_id = t.doc_id
    """,
    "unique_only": """
        with c as (select c_nationkey, c_mktsegment from customer union all select 99, 'ONLY')
        select c_nationkey, case when count(distinct c_mktsegment) = 1 then min(c_mktsegment) end as c_mktsegment from c group by 1
    """,
    "as_of_previous": """
        select event_id, user_id, epoch_us(ts) - max(case when event_type = 'view' then epoch_us(ts) end) over (partition by user_id order by ts range between unbounded preceding and current row) as micros_since_view from events
    """,
    "exists_and_not": """
        select c_custkey, c_mktsegment from customer c where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)
        and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')
    """,
}
