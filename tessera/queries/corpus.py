"""Queries of sections, judgments, grounded references, delayed and revived jobs, and charges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import corpus
from tessera.session import table

AS_OF = "2024-01-20 00:00:00"
LISTED = ["ECONOMY ANODIZED BRASS", "STANDARD PLATED TIN"]


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.expr("concat(p_size, if(p_partkey % 3 = 0, 'A', ''), if(p_partkey % 5 = 0, '(1)', ''))")
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("act"), named.alias("section"))


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _sections(spark, sf_dir).withColumnsRenamed({"act": "old_act", "section": "old_section"})
    return made.select("old_act", "old_section", F.expr("if(length(old_section) > 2, 'NEWER', 'NEW')").alias("new_act"), F.expr("regexp_extract(old_section, '^[0-9]+', 0)").alias("new_section")).distinct()


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.expr("case event_id % 4 when 0 then 'QUEUED' when 1 then 'ACTIVE' when 2 then 'DEAD' else 'DONE' end")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("job_id"), F.expr("concat('u', user_id)").alias("dedupe"), state.alias("state"), F.expr("concat('w', user_id % 3)").alias("worker"), F.expr("cast(event_id % 5 as int)").alias("attempts"), F.col("ts").cast("timestamp_ntz").alias("lease_until"))


def section_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.numbered_sections(_sections(spark, sf_dir).distinct(), "act", "section")


def shared_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))
    return corpus.having_any(tagged, "tags", ["ring", "red"]).select("p_partkey", F.array_join("tags", " ").alias("tags"))


def leading_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 50_000).alias("cited"), F.year("o_orderdate").alias("year"), "o_orderkey")
    return corpus.leading(rows, "o_custkey", "cited", "year", 1995, "o_orderkey")


def recodified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.recodified_from(_mapping(spark, sf_dir))


def other_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.laws_with_section(_sections(spark, sf_dir), LISTED).select("section", F.array_join("acts", "; ").alias("acts"))


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = _mapping(spark, sf_dir).select(F.col("new_act").alias("act"), F.col("new_section").alias("section"))
    return corpus.grounded_refs(_sections(spark, sf_dir), mapped)


def delayed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir).withColumn("state", F.expr("case job_id % 191 when 0 then 'QUEUED' when 1 then 'ACTIVE' else state end")).filter("job_id % 191 <= 1 or state in ('DEAD', 'DONE')")
    new = table(spark, sf_dir, "events").select("event_id", F.expr("if(event_id % 10 = 0, null, concat('u', user_id))").alias("dedupe"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return corpus.enqueue(new, jobs, "dedupe", "ts", ["ts", "event_id"], "30 seconds").select("event_id", "dedupe", "state", "attempts", "run_at")


def renewed_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.renew(_jobs(spark, sf_dir), "w1", AS_OF, "120 seconds").select("job_id", "lease_until")


def revived_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _jobs(spark, sf_dir).filter("worker = 'w2'")
    return corpus.requeue_dead(_jobs(spark, sf_dir), chosen, "job_id").select("job_id", "state", "attempts", "lease_until")


def unverified_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spends = table(spark, sf_dir, "events").filter("event_type = 'click'").select("user_id", F.lit("SPEND").alias("kind"), (-2 - F.col("event_id") % 3).alias("delta"), F.col("event_id").cast("string").alias("reference"))
    return corpus.unverified_charges(spends, "reference")


QUERIES = {
    f.__name__: f
    for f in (section_positions, shared_tags, leading_orders, recodified, other_laws, grounded, delayed_jobs, renewed_leases, revived_jobs, unverified_answers)
}
_S = "(select p_type as act, p_size || case when p_partkey % 3 = 0 then 'A' else '' end || case when p_partkey % 5 = 0 then '(1)' else '' end as section from part)"
_M = f"(select distinct act as old_act, section as old_section, case when length(section) > 2 then 'NEWER' else 'NEW' end as new_act, regexp_extract(section, '^[0-9]+') as new_section from {_S})"
_J = """(select event_id as job_id, 'u' || user_id as dedupe, case event_id % 4 when 0 then 'QUEUED' when 1 then 'ACTIVE' when 2 then 'DEAD' else 'DONE' end as state,
    'w' || (user_id % 3) as worker, (event_id % 5)::int as attempts, ts::timestamp as lease_until from events)"""
ORACLES = {
    "section_positions": f"select act, section, row_number() over (partition by act order by regexp_extract(section, '^[0-9]+')::bigint, section)::int as position from (select distinct * from {_S})",
    "shared_tags": "select p_partkey, p_name as tags from part where list_has_any(string_split(p_name, ' '), ['ring', 'red'])",
    "leading_orders": """
        select o_custkey, floor(o_totalprice / 50000)::bigint as cited, year(o_orderdate)::int as year, o_orderkey from orders
        qualify row_number() over (partition by o_custkey order by floor(o_totalprice / 50000) desc, abs(year(o_orderdate) - 1995), o_orderkey) = 1
    """,
    "recodified": f"""
        select old_act, regexp_extract(old_section, '^[0-9]+') as base, new_act, new_section, old_section, not contains(old_section, '(') as whole from {_M}
        qualify row_number() over (partition by old_act, base, new_act, new_section order by contains(old_section, '('), old_section) = 1
    """,
    "other_laws": f"select section, string_agg(distinct act, '; ' order by act) as acts from {_S} where act not in ({', '.join(repr(x) for x in LISTED)}) group by section",
    "grounded": f"select act, split_part(section, '(', 1) as section from {_S} union select new_act, new_section from {_M}",
    "delayed_jobs": f"""
        with n as (select event_id, case when event_id % 10 = 0 then null else 'u' || user_id end as dedupe, ts::timestamp as ts from events),
        live as (select dedupe from {_J} where job_id % 191 <= 1)
        select event_id, dedupe, 'QUEUED' as state, 0 as attempts, ts + interval 30 seconds as run_at from n where dedupe is null or dedupe not in (select dedupe from live)
        qualify dedupe is null or row_number() over (partition by dedupe order by ts, event_id) = 1
    """,
    "renewed_leases": f"""
        select job_id, case when state = 'ACTIVE' and worker = 'w1' and lease_until >= timestamp '{AS_OF}' then timestamp '{AS_OF}' + interval 120 seconds else lease_until end as lease_until from {_J}
    """,
    "revived_jobs": f"""
        with j as (select *, state = 'DEAD' and worker = 'w2' as again from {_J})
        select job_id, case when again then 'QUEUED' else state end as state, case when again then 0 else attempts end as attempts, case when not again then lease_until end as lease_until from j
    """,
    "unverified_answers": """
        with s as (select user_id, 2 + event_id % 3 as cost, event_id::varchar as r from events where event_type = 'click')
        select user_id, 'REFUND' as kind, cost as delta, 'refund:' || r as reference from s union all select user_id, 'SPEND', -1, 'unverified:' || r from s
    """,
}
