"""Reporting queries over events, customers, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import reporting
from tessera.session import table

AS_OF = "2024-01-31 00:00:00"
# Sums of whole hundredths don't depend on the order of rows.
_CENTS = "sum(cast(round(value * 100) as long))"
_MEAN = f"{_CENTS} / count(*) / 100"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def time_series_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {
        "searches": F.count("*"),
        "users": F.count_distinct("user_id"),
        "errors": F.count_if(F.col("event_type") == "error"),
        "mean_value": F.expr(_MEAN),
    }
    found = reporting.daily_series(_events(spark, sf_dir), "ts", "2023-12-25", "2024-02-05", measures)
    return found.withColumn("day", F.col("day").cast("string"))


def event_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = _events(spark, sf_dir).filter(f"ts >= timestamp_ntz '{AS_OF}' - interval 14 days")
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.expr(f"{_CENTS} / 100").alias("total")).orderBy(F.desc("n"), "event_type")


def platform_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, users = _events(spark, sf_dir), table(spark, sf_dir, "customer")
    one = events.agg(
        F.count("*").alias("events"),
        F.count_distinct("user_id").alias("active_users"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "refund", F.col("value"))), F.lit(0.0)).alias("refunds"),
        F.expr(_MEAN).alias("mean_value"),
    )
    return one.crossJoin(users.agg(F.count("*").alias("users")))  # two rows of aggregates


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reporting.percentiles(_events(spark, sf_dir), "event_type", "value", (0.5, 0.9, 0.95, 0.99))
    return found.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99", "largest")))


def nearest_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.nearest_rank(_events(spark, sf_dir), "user_id", "value", (0.5, 0.95))


def top_customers_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by name with their orders of the last day, second page of ten."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max(F.date_trunc("day", "o_orderdate")).alias("today"))
    today = orders.crossJoin(F.broadcast(last)).filter("o_orderdate >= today")  # one row
    counts = today.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders_today"))
    found = table(spark, sf_dir, "customer").filter(F.lower("c_name").contains("customer") & F.col("c_acctbal").isNotNull())
    return found.join(counts, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("orders_today", F.lit(0)).alias("orders_today")).orderBy(F.desc("orders_today"), "c_custkey").offset(10).limit(10)


def corpus_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("embedded"))
    every = docs.select("doc_id", "source", "lang", "n_chars").join(vectors, "doc_id", "left").join(labels, "doc_id", "left")
    return every.groupBy("source").agg(F.count("*").alias("docs"), F.count("embedded").alias("embedded"), F.count_distinct("lang").alias("langs"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.max("n_chars").alias("longest"))


def star_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and year; only nation is small enough to be sent to every task, and Spark sees that from its size."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("cast(cast(l_extendedprice as decimal(15, 2)) * (1 - cast(l_discount as decimal(5, 2))) as decimal(20, 4))").alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_order = line.groupBy("o_orderkey").agg(F.sum("r").alias("r"), F.count("*").alias("n"))
    joined = per_order.join(orders, "o_orderkey").join(customer, "c_custkey").join(nation, "n_nationkey")
    return joined.groupBy("n_name", "year").agg(F.sum("r").cast("decimal(25, 4)").cast("double").alias("revenue"), F.sum("n").alias("lines"))


def rollup_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    found = line.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))
    return found


def cube_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, name: df.select("k", F.lit(name).alias("op"))
    return tag(customers.intersect(suppliers), "intersect").unionByName(tag(customers.subtract(suppliers), "except")).unionByName(tag(customers.union(suppliers).distinct(), "union"))


def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("region", "nation", "customer", "orders")
    found = [reporting.checksum(table(spark, sf_dir, n).select([c for c, kind in table(spark, sf_dir, n).dtypes if kind in ("int", "bigint", "string")])).withColumn("name", F.lit(n)) for n in names]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def count_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))
    return reporting.unequal_counts(docs, labelled, "source", "n")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.max(k).alias("largest"), F.count_if(k.isNull()).alias("missing"))


def tax_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross in hundredths, 18 % tax inside: net is rounded half up, tax is the rest."""
    gross = F.round(F.col("o_totalprice") * 100).cast("long")
    net = F.floor((gross * 10000 * 2 + 11800) / (2 * 11800)).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", gross.alias("gross"), net.alias("net"), (gross - net).alias("tax"))


def settings_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.lit(" ")).otherwise(F.col("n_name")).alias("o"), F.when(F.col("n_regionkey") > 2, F.concat(F.lit("env"), F.col("n_regionkey"))).alias("e"))
    return rows.select("n_nationkey", reporting.setting(F.col("o"), F.col("e"), F.lit("default")).alias("value"))


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a check, a unique key or a foreign key, counted."""
    orders, line, docs = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "documents")
    found = [
        orders.groupBy("o_orderkey").agg(F.count("*").alias("c")).filter("c > 1").agg(F.count("*").alias("n")).withColumn("rule", F.lit("orders_key")),
        line.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count("*").alias("n")).withColumn("rule", F.lit("line_order")),
        line.filter("not (l_discount between 0 and 0.05)").agg(F.count("*").alias("n")).withColumn("rule", F.lit("line_discount")),
        docs.groupBy(F.sha2("text", 256)).agg(F.count("*").alias("c")).filter("c > 1").agg(F.count("*").alias("n")).withColumn("rule", F.lit("document_text")),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


QUERIES = {
    f.__name__: f
    for f in (
        time_series_gapfill,
        event_mix,
        platform_stats,
        latency_percentiles,
        nearest_rank_pct,
        top_customers_today,
        corpus_breakdown,
        star_join_agg,
        rollup_extra,
        cube_extra,
        set_operations,
        checksum,
        count_differences,
        json_fields,
        tax_split,
        settings_layers,
        constraint_violations,
    )
}


def _checksum_sql(name: str, columns: str) -> str:
    row = " || '|' || ".join(f"coalesce({c}::varchar, '~')" for c in columns.split())
    return f"select count(*) as n, coalesce(sum(('0x' || substr(md5({row}), 1, 12))::bigint), 0)::varchar as digest, '{name}' as name from {name}"


ORACLES = {
    "time_series_gapfill": """
        with d as (select unnest(generate_series(date '2023-12-25', date '2024-02-05', interval 1 day))::date as day),
        e as (select ts::date as day, count(*) as searches, count(distinct user_id) as users, count(*) filter (event_type = 'error') as errors, sum(round(value * 100)::bigint)::double / count(*) / 100 as mean_value from events group by 1)
        select d.day::varchar as day, coalesce(searches, 0) as searches, coalesce(users, 0) as users, coalesce(errors, 0) as errors, coalesce(mean_value, 0) as mean_value from d left join e on d.day = e.day
    """,
    "event_mix": f"select event_type, count(*) as n, sum(round(value * 100)::bigint)::double / 100 as total from events where ts >= timestamp '{AS_OF}' - interval 14 days group by 1",
    "platform_stats": """
        select count(*) as events, count(distinct user_id) as active_users, count(*) filter (event_type = 'error') as errors,
               coalesce(sum(value) filter (event_type = 'refund'), 0) as refunds, sum(round(value * 100)::bigint)::double / count(*) / 100 as mean_value, (select count(*) from customer) as users from events
    """,
    "latency_percentiles": """
        select event_type, count(value) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95,
               round(quantile_cont(value, 0.99), 6) as p99, round(max(value), 6) as largest from events group by 1
    """,
    "nearest_rank_pct": """
        with r as (select user_id, value, row_number() over (partition by user_id order by value) as rn, count(*) over (partition by user_id) as n from events)
        select user_id, max(value) filter (rn = ceil(0.5 * n)) as p50, max(value) filter (rn = ceil(0.95 * n)) as p95 from r group by 1
    """,
    "top_customers_today": """
        with t as (select max(date_trunc('day', o_orderdate)) as today from orders),
        o as (select o_custkey, count(*) as n from orders, t where o_orderdate >= today group by 1)
        select c_custkey, c_name, coalesce(n, 0) as orders_today from customer left join o on o_custkey = c_custkey
        where c_name ilike '%customer%' and c_acctbal is not null order by orders_today desc, c_custkey limit 10 offset 10
    """,
    "corpus_breakdown": """
        select source, count(*) as docs, count(vec_id) as embedded, count(distinct lang) as langs, coalesce(sum(toxic), 0)::bigint as toxic, max(n_chars) as longest
        from documents d left join embeddings e on e.vec_id = d.doc_id left join labels l on l.doc_id = d.doc_id group by 1
    """,
    "star_join_agg": """
        select n_name, year(o_orderdate) as year, sum((l_extendedprice::decimal(15, 2) * (1 - l_discount::decimal(5, 2)))::decimal(20, 4))::double as revenue, count(*) as lines
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2
    """,
    "rollup_extra": "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, grouping_id(l_returnflag, l_linestatus) as level from lineitem group by rollup (l_returnflag, l_linestatus)",
    "cube_extra": "select o_orderstatus, o_orderpriority, count(*) as n, grouping_id(o_orderstatus, o_orderpriority) as level from orders group by cube (o_orderstatus, o_orderpriority)",
    "set_operations": """
        select k, 'intersect' as op from (select c_nationkey as k from customer intersect select s_nationkey from supplier) union all
        select k, 'except' from (select c_nationkey as k from customer except select s_nationkey from supplier) union all
        select k, 'union' from (select c_nationkey as k from customer union select s_nationkey from supplier)
    """,
    "checksum": " union all ".join(
        _checksum_sql(n, c)
        for n, c in (
            ("region", "r_regionkey r_name"),
            ("nation", "n_nationkey n_name n_regionkey"),
            ("customer", "c_custkey c_name c_nationkey c_mktsegment"),
            ("orders", "o_orderkey o_custkey o_orderstatus o_orderpriority"),
        )
    ),
    "count_differences": """
        with a as (select source, count(*) as n from documents group by 1), b as (select source, count(*) as n from documents join labels using (doc_id) group by 1)
        select coalesce(a.source, b.source) as source, a.n as left_count, b.n as right_count from a full join b on a.source = b.source where a.n is distinct from b.n
    """,
    "json_fields": "with e as (select (props->>'$.k')::bigint as k from events) select k % 10 as bucket, count(*) as n, max(k) as largest, count(*) filter (k is null) as missing from e group by 1",
    "tax_split": """
        with g as (select o_orderkey, round(o_totalprice * 100)::bigint as gross from orders), n as (select *, floor((gross * 20000 + 11800) / 23600)::bigint as net from g)
        select o_orderkey, gross, net, gross - net as tax from n
    """,
    "settings_layers": """
        select n_nationkey, coalesce(nullif(trim(case when n_nationkey % 3 = 0 then ' ' else n_name end), ''), case when n_regionkey > 2 then 'env' || n_regionkey end, 'default') as value from nation
    """,
    "constraint_violations": """
        select count(*) as n, 'orders_key' as rule from (select o_orderkey from orders group by 1 having count(*) > 1) union all
        select count(*), 'line_order' from lineitem where l_orderkey not in (select o_orderkey from orders) union all
        select count(*), 'line_discount' from lineitem where not (l_discount between 0 and 0.05) union all
        select count(*), 'document_text' from (select text from documents group by 1 having count(*) > 1)
    """,
}
