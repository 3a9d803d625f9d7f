"""Event, queue and ledger queries; events stand in for messages, jobs and credit entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import events as ev
from tessera.operators import ledger
from tessera.session import table

AS_OF = "2024-01-20 00:00:00"
_STATES = {"signup": "QUEUED", "view": "DONE", "click": "ACTIVE", "error": "DEAD", "purchase": "DONE"}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.create_map(*(F.lit(x) for pair in _STATES.items() for x in pair))
    e = _events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("job_id"),
        F.col("user_id").alias("lock_key"),
        F.element_at(state, F.col("event_type")).alias("state"),
        F.col("ts").alias("run_at"),
        F.expr("ts + interval 1 hour").alias("done_at"),
        F.expr("ts + interval 2 days").alias("lease_until"),
        (F.col("event_id") % 6).cast("int").alias("attempts"),
    )


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """purchase grants, click and view spend, error refunds; value in hundredths."""
    kind = F.when(F.col("event_type") == "purchase", "GRANT").when(F.col("event_type").isin("click", "view"), "SPEND").when(F.col("event_type") == "error", "REFUND")
    e = _events(spark, sf_dir).withColumn("kind", kind).filter("kind is not null")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select("event_id", "user_id", "ts", "kind", F.when(F.col("kind") == "SPEND", -cents).otherwise(cents).alias("delta"))


def claim_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.claim_first(_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latest_state(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


def upsert_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderdate", "o_orderkey")
    return ev.upsert(customer, changes, ["c_custkey"], ["o_orderdate", "o_orderkey"])


def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("new").alias("origin"))
    return ev.insert_absent(left, new, ["k"])


def retention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    kept = [ev.retain(e, "ts", AS_OF, days).agg(F.count("*").alias("kept")).select(F.lit(days).alias("days"), "kept") for days in (7, 14, 90)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def erase_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, orders = _events(spark, sf_dir), table(spark, sf_dir, "orders")
    owners = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("owner"))
    _, lost = ev.erase({"events": e, "orders": orders}, owners, {"events": "user_id", "orders": "o_custkey"})
    return lost


def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.queue_stats(_jobs(spark, sf_dir), AS_OF)


def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.claimable(_jobs(spark, sf_dir), "2024-01-25 00:00:00", 25).select("job_id", "lock_key")


def queue_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, delay = ev.retry(F.col("attempts") + 1, 5)
    failed = _jobs(spark, sf_dir).filter("state = 'ACTIVE'")
    return failed.select("job_id", state.alias("state"), delay.alias("delay"))


def queue_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.reclaim(_jobs(spark, sf_dir), AS_OF, 5)
    return found.groupBy("state", F.col("lease_until").isNull().alias("released")).agg(F.count("*").alias("n"))


def quota_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.within_quota(_events(spark, sf_dir), ["user_id"], "ts", ["ts", "event_id"], 2).select("event_id", "allowed")


def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev.sessions(_events(spark, sf_dir), ["user_id"], "ts", ["ts", "event_id"], 6 * 3600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("any_event"))


def rate_limit_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.fixed_windows(_events(spark, sf_dir), "user_id", "ts", ["event_id"], 24 * 3600, 3)


def rate_limit_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _events(spark, sf_dir).groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"))
    return per.filter("n > 1").groupBy("user_id").agg(F.count("*").alias("hours_over"), F.sum(F.col("n") - 1).alias("refused"))


def turns_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.recent_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2, 200).select("conv_id", "turn", "role", "text")


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(_entries(spark, sf_dir), ["user_id"])


def ledger_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.running_balance(_entries(spark, sf_dir), "user_id", ["ts", "event_id"]).select("event_id", "balance_after")


def _spends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).filter("kind = 'SPEND'")
    return e.select("event_id", "user_id", "kind", "delta", F.concat(F.lit("spend:"), F.col("event_id")).alias("reference"), F.when(F.col("event_id") % 2 == 0, "free").otherwise("paid").alias("bucket"))


def ledger_refund_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    spends = _spends(spark, sf_dir)
    asked = _events(spark, sf_dir).filter("event_type = 'view'").select(F.concat(F.lit("spend:"), F.col("event_id")).alias("reference"))
    back = ledger.refunds(spends, asked)
    return ledger.unrefunded(spends.unionByName(back)).select("event_id", "delta", "bucket")


def ledger_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).withColumn("reference", F.when(F.col("kind") == "GRANT", F.concat_ws(":", "user_id", F.to_date("ts"))))
    return ledger.idempotent(e, "reference", ["ts", "event_id"]).groupBy("user_id").agg(F.count("*").alias("entries"), F.sum("delta").alias("net"))


def ledger_spend_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "purchase", "grant").when(F.col("event_type") == "error", "deduct").otherwise("spend")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    actions = _events(spark, sf_dir).select("user_id", seq.alias("seq"), op.alias("op"), F.floor("value").alias("amount"))
    return ledger.spend_fold(actions)


def charged_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as searches that cost something; a user asks the same several times, and some were charged for before."""
    e = table(spark, sf_dir, "events")
    ref = F.expr("concat('u', user_id, '-', event_id % 40)")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    actions = e.select("user_id", seq.alias("seq"), (F.col("event_id") % 4).alias("cost"), ref.alias("reference"))
    balances = e.filter("user_id % 5 > 0").select("user_id", F.lit(10).alias("free"), (F.col("user_id") % 7 * 3).alias("paid"), F.lit(True).alias("granted")).distinct()
    spent = e.filter("event_id % 40 = 7").select(F.concat(ref, F.lit(":free")).alias("reference"))
    found = ledger.charges(actions, balances, spent, 20)
    return found.select("user_id", "seq", "allowed", "charged", "free_left", "paid_left", "already_spent", F.size("entries").alias("n_entries"))


QUERIES = {
    f.__name__: f
    for f in (
        charged_actions,
        claim_first,
        latest_state,
        upsert_customers,
        insert_absent,
        retention_counts,
        erase_users,
        queue_stats,
        queue_claim,
        queue_retry,
        queue_reclaim,
        quota_claim,
        session_gap,
        rate_limit_fixed,
        rate_limit_tumbling,
        turns_recent,
        ledger_totals,
        ledger_running,
        ledger_refund_match,
        ledger_idempotent,
        ledger_spend_fold,
    )
}
_JOBS = """(select event_id as job_id, user_id as lock_key, case event_type when 'signup' then 'QUEUED' when 'click' then 'ACTIVE' when 'error' then 'DEAD' else 'DONE' end as state,
            ts as run_at, ts + interval 1 hour as done_at, ts + interval 2 days as lease_until, (event_id % 6)::int as attempts from events)"""
_ENTRIES = """(select event_id, user_id, ts, kind, case kind when 'SPEND' then -cents else cents end as delta from (
            select *, case event_type when 'purchase' then 'GRANT' when 'click' then 'SPEND' when 'view' then 'SPEND' when 'error' then 'REFUND' end as kind, round(value * 100)::bigint as cents from events) where kind is not null)"""
ORACLES = {
    "charged_actions": """
        with recursive a as (select user_id, event_id % 4 as cost, 'u' || user_id || '-' || (event_id % 40) as ref, row_number() over (partition by user_id order by event_id) as n from events),
        past as (select distinct 'u' || user_id || '-' || (event_id % 40) as ref from events where event_id % 40 = 7),
        r as (
          select user_id, 0::bigint as seq, case when user_id % 5 > 0 then 10 else 20 end::bigint as free_left, case when user_id % 5 > 0 then user_id % 7 * 3 else 0 end::bigint as paid_left, []::varchar[] as held, true as allowed, 0::bigint as charged, false as already_spent, 0 as n_entries
          from (select distinct user_id from a)
          union all
          select user_id, n, free_left - own, paid_left - bought, case when own + bought > 0 then list_append(held, ref) else held end, seen or fits, own + bought, seen,
            (own > 0)::int + (bought > 0)::int + (n = 1 and user_id % 5 = 0)::int
          from (select *, case when not seen and fits then least(free_left, cost) else 0 end as own, case when not seen and fits then cost - least(free_left, cost) else 0 end as bought
            from (select r.*, a.n, a.cost, a.ref, a.ref in (select ref from past) or list_contains(held, a.ref) as seen, r.free_left + r.paid_left >= a.cost as fits from r join a on a.user_id = r.user_id and a.n = r.seq + 1)))
        select user_id, seq, allowed, charged, free_left, paid_left, already_spent, n_entries from r where seq > 0
    """,
    "claim_first": "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
    "latest_state": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "upsert_customers": """
        with l as (select o_custkey, o_orderpriority from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
        select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from l) union all select o_custkey, o_orderpriority from l
    """,
    "insert_absent": "select c_custkey as k, case when c_acctbal >= 0 then 'customer' else 'new' end as origin from customer",
    "retention_counts": f"select d::int as days, count(*) filter (ts is null or ts >= timestamp '{AS_OF}' - to_days(d::int)) as kept from events, (values (7), (14), (90)) v(d) group by 1",
    "erase_users": """
        with o as (select c_custkey from customer where c_mktsegment = 'BUILDING')
        select 'events' as name, count(*) as deleted from events where user_id in (from o) union all select 'orders', count(*) from orders where o_custkey in (from o)
    """,
    "queue_stats": f"""
        select count(*) filter (state = 'QUEUED' and run_at <= timestamp '{AS_OF}') as waiting, count(*) filter (state = 'ACTIVE') as active, count(*) filter (state = 'DEAD') as dead,
               count(*) filter (state = 'DONE' and done_at >= timestamp '{AS_OF}' - interval 1 day) as done_24h,
               coalesce(epoch(timestamp '{AS_OF}')::bigint - min(floor(epoch(run_at))::bigint) filter (state = 'QUEUED' and run_at <= timestamp '{AS_OF}'), 0) as oldest_wait from {_JOBS}
    """,
    "queue_claim": f"""
        with j as {_JOBS}, r as (select * from j where state = 'QUEUED' and run_at <= timestamp '2024-01-25' and not exists
            (select 1 from j a where a.lock_key = j.lock_key and a.state = 'ACTIVE' and a.lease_until > timestamp '2024-01-25')),
        f as (select * from r qualify row_number() over (partition by lock_key order by run_at, job_id) = 1)
        select job_id, lock_key from f order by run_at, job_id limit 25
    """,
    "queue_retry": f"""
        select job_id, case when attempts + 1 >= 5 then 'DEAD' else 'QUEUED' end as state, case when attempts + 1 < 5 then least(300, 5 * power(2, attempts))::bigint end as delay
        from {_JOBS} where state = 'ACTIVE'
    """,
    "queue_reclaim": f"""
        with j as (select *, state = 'ACTIVE' and lease_until < timestamp '{AS_OF}' as stalled from {_JOBS})
        select case when stalled and attempts >= 5 then 'DEAD' when stalled then 'QUEUED' else state end as state, stalled as released, count(*) as n from j group by 1, 2
    """,
    "quota_claim": "select event_id, row_number() over (partition by user_id, ts::date order by ts, event_id) <= 2 as allowed from events",
    "session_gap": """
        with l as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w <= 21600000000 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
        s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from l)
        select user_id, session::bigint as session, count(*) as n, min(event_id) as any_event from s group by 1, 2
    """,
    "rate_limit_tumbling": """
        with p as (select user_id, date_trunc('hour', ts) as h, count(*) as n from events group by 1, 2 having count(*) > 1)
        select user_id, count(*) as hours_over, sum(n - 1)::bigint as refused from p group by 1
    """,
    "turns_recent": """
        with l as (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 4),
        s as (select *, max((role <> 'assistant')::int) over (partition by conv_id order by turn) as started from l)
        select conv_id, turn, role, substr(text, 1, 200) as text from s where started = 1
    """,
    "ledger_totals": f"""
        select user_id, coalesce(sum(delta) filter (kind = 'GRANT'), 0)::bigint as granted, -coalesce(sum(delta) filter (kind = 'SPEND'), 0)::bigint as spent,
               coalesce(sum(delta) filter (kind = 'REFUND'), 0)::bigint as refunded, sum(delta)::bigint as net from {_ENTRIES} group by 1
    """,
    "ledger_running": f"select event_id, (sum(delta) over (partition by user_id order by ts, event_id rows unbounded preceding))::bigint as balance_after from {_ENTRIES}",
    "ledger_refund_match": f"select e.event_id, delta, case when e.event_id % 2 = 0 then 'free' else 'paid' end as bucket from {_ENTRIES} e join events v on v.event_id = e.event_id where kind = 'SPEND' and event_type <> 'view'",
    "ledger_idempotent": f"""
        with e as (select *, case when kind = 'GRANT' then user_id || ':' || ts::date end as reference from {_ENTRIES}),
        k as (select * from e qualify reference is null or row_number() over (partition by reference order by ts, event_id) = 1)
        select user_id, count(*) as entries, sum(delta)::bigint as net from k group by 1
    """,
}
