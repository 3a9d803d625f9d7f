"""Update, merge, token and guard queries; customers, orders and events stand in for accounts, payments and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import legal
from tessera.operators import changes
from tessera.session import table

AS_OF = "2024-01-25 00:00:00"
_ANSWER = "concat('Held in (2014) 2 SCC ', p_partkey, ' and AIR ', 1950 + p_size, ' SC ', p_partkey, '.')"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    guard = (F.col("o_orderstatus") != "F") & F.col("o_orderpriority").like("1%")
    return changes.update_where(orders, guard, {"o_orderstatus": F.lit("X"), "o_orderpriority": F.concat(F.lit("was "), F.col("o_orderpriority"))})


def cut_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    anchors = turns.filter("turn >= 1 and role = 'user' and contains(text, 'the')")
    return changes.cut_from(turns.drop("text"), anchors, "conv_id", "turn")


def without_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _events(spark, sf_dir).select("event_id", F.concat_ws(":", "user_id", "event_type").alias("key"))
    owners = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("owner"))
    return changes.without_owned(keyed, "key", owners)


def merge_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("segment")
    accounts = table(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("paid"), segment)
    moves = accounts.filter("c_custkey % 10 in (3, 7)").select(F.col("c_custkey").alias("old"), F.expr("cast(floor(c_custkey / 10) * 10 + 4 as long)").alias("new"))
    return changes.merge_accounts(accounts, moves, "c_custkey", ["paid"], ["segment"])


def live_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    tokens = e.filter("event_type = 'signup'").select(F.col("event_id").alias("token_id"), "user_id", F.col("ts").alias("issued_at"), F.expr("ts + interval 20 days").alias("expires_at"))
    uses = e.select((F.col("event_id") - F.col("event_id") % 7).alias("token_id"), (F.col("event_type") == "purchase").alias("ok"))
    return changes.live_tokens(tokens, uses, AS_OF, 3).select("token_id", "user_id")


def guarded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    answers = part.select("p_partkey", F.expr(_ANSWER).alias("answer"))
    known = part.filter("p_size <= 25").select(F.expr("concat('AIR ', 1950 + p_size, ' SC ', p_partkey)").alias("ref"))
    known = known.unionByName(part.filter("p_partkey % 3 = 0").select(F.expr("concat('(2014) 2 SCC ', p_partkey)").alias("ref")))
    found = changes.guarded(answers, known, "p_partkey", "answer", legal.citation_places)
    return found.select("p_partkey", "answer", F.array_join("removed", "; ").alias("removed"))


def paid_uncredited(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "PAID").otherwise("CREATED").alias("status")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), status)
    entries = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("order:"), F.col("l_orderkey")).alias("reference"))
    return changes.paid_uncredited(orders, entries).select("order_id")


def order_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.lifecycle(_events(spark, sf_dir), ["signup", "view", "click", "purchase"], "user_id", "event_type", "ts")
    return found.select("user_id", "event_type", F.col("reached").cast("string").alias("reached"))


QUERIES = {f.__name__: f for f in (update_where, cut_from, without_owned, merge_accounts, live_tokens, guarded_answers, paid_uncredited, order_lifecycle)}
ORACLES = {
    "update_where": """
        select o_orderkey, case when g then 'X' else o_orderstatus end as o_orderstatus, case when g then 'was ' || o_orderpriority else o_orderpriority end as o_orderpriority
        from (select *, o_orderstatus <> 'F' and o_orderpriority like '1%' as g from orders)
    """,
    "cut_from": """
        with a as (select conv_id, min(turn) as f from conversations where turn >= 1 and role = 'user' and contains(text, 'the') group by 1)
        select c.conv_id, turn, role from conversations c left join a on a.conv_id = c.conv_id where f is null or turn < f
    """,
    "without_owned": "select event_id, user_id || ':' || event_type as key from events where user_id not in (select c_custkey from customer where c_mktsegment = 'MACHINERY')",
    "merge_accounts": """
        with a as (select c_custkey as k, round(c_acctbal * 100)::bigint as paid, case when c_custkey % 4 > 0 then c_mktsegment end as segment,
                          case when c_custkey % 10 in (3, 7) then c_custkey // 10 * 10 + 4 else c_custkey end as t from customer)
        select t as c_custkey, sum(paid)::bigint as paid, first(segment order by (k <> t)::int, k) filter (segment is not null) as segment from a group by 1
    """,
    "live_tokens": f"""
        with l as (select event_id as token_id, user_id, ts + interval 20 days as e from events where event_type = 'signup' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
        u as (select event_id - event_id % 7 as token_id, count(*) filter (event_type <> 'purchase') as failed, bool_or(event_type = 'purchase') as used from events group by 1)
        select l.token_id, user_id from l left join u on u.token_id = l.token_id where coalesce(failed, 0) < 3 and not coalesce(used, false) and e > timestamp '{AS_OF}'
    """,
    "guarded_answers": """
        with a as (select p_partkey, '(2014) 2 SCC ' || p_partkey as s, 'AIR ' || (1950 + p_size) || ' SC ' || p_partkey as r, p_partkey % 3 = 0 as s_known, p_size <= 25 as r_known from part)
        select p_partkey, 'Held in ' || case when s_known then s else '[unverified]' end || ' and ' || case when r_known then r else '[unverified]' end || '.' as answer,
               concat_ws('; ', case when not s_known then s end, case when not r_known then r end) as removed from a
    """,
    "paid_uncredited": "select o_orderkey as order_id from orders where o_orderstatus = 'F' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
    "order_lifecycle": """
        with e as (select user_id, event_type, min(ts) as reached, case event_type when 'signup' then 1 when 'view' then 2 when 'click' then 3 else 4 end as r
                   from events where event_type <> 'error' group by 1, 2)
        select user_id, event_type, reached::varchar as reached from e qualify row_number() over (partition by user_id order by r desc) = 1
    """,
}
