"""Queries of conversations and of columns that are kept up to date."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import copies, sessions
from tessera.session import table

TTL = 5 * 24 * 3600
_SAID = (
    "case event_id % 15 when 0 then '1' when 1 then '2' when 2 then '3' when 3 then '0' when 4 then 'more' when 5 then concat('what is IPC ', event_id % 500) when 6 then concat('DLCT01', lpad(cast(event_id as string), 6, '0'), '2024') "
    "when 7 then 'thanks' when 8 then concat('DLCT01', event_id, '23x') when 9 then concat('A. Name, D/', event_id, '/2020, Delhi, Delhi') when 10 then 'anticipatory bail' when 11 then '' when 12 then '3' when 13 then 'next' else concat('bail ', event_id % 3) end"
)


def routed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the messages of a conversation."""
    said = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts"), F.expr(_SAID).alias("said"), (F.col("user_id") % 3 > 0).alias("known"))
    return sessions.routed(said, "user_id", "event_id", "ts", "said", "known", TTL)


def copied_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders carry the order's date and priority; some orders have changed since, one of them twice."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderpriority").alias("priority"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(orders, "l_orderkey")
    moved = orders.filter("l_orderkey % 5 = 0").select("l_orderkey", F.lit(1).alias("seq"), F.lit("2030-01-01").alias("day"), "priority")
    again = orders.filter("l_orderkey % 10 = 0").select("l_orderkey", F.lit(2).alias("seq"), F.lit("2031-01-01").alias("day"), F.lit("NONE").alias("priority"))
    return copies.updated(lines, moved.unionByName(again), "l_orderkey", "seq", ["day", "priority"])


def filled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing vectors of documents, made in batches of 32 texts from how often five letters occur."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("if(doc_id % 4 = 0, cast(null as array<double>), array(cast(n_chars as double)))").alias("vector"))
    made = copies.filled(docs, "text", "vector", _letters, 32)
    return made.select("doc_id", F.size("vector").alias("dims"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"))


def _letters(texts: pd.Series) -> list[list[float]]:
    return [[float(t.count(c)) for c in "aeiou"] for t in texts]


QUERIES = {f.__name__: f for f in (routed_sessions, copied_columns, filled_vectors)}
_WORD = r"regexp_replace(lower(trim(said)), '[\s!.?,;:]+$', '')"
_ASKS = sessions.ASKS.pattern.replace("'", "''")
ORACLES = {
    "routed_sessions": rf"""
        with recursive m as (
          select user_id, event_id, epoch_us(ts::timestamp) as us, said, {_WORD} as w, regexp_replace(lower(said), '[\s-]', '', 'g') as c, user_id % 3 > 0 as told,
            row_number() over (partition by user_id order by ts::timestamp, event_id) as n from (select *, {_SAID.replace("as string", "as varchar")} as said from events)),
        r as (
          select user_id, 0::bigint as n, null::varchar as state, null::bigint as last, null::varchar as charged, 0 as pages, false as known, null::bigint as event_id, null::varchar as before, null::varchar as action, null::varchar as argument, 0 as charge from (select distinct user_id from m)
          union all
          select user_id, n,
            case action when 'greet' then 'MAIN_MENU' when 'ask_profile' then 'AWAITING_PROFILE' when 'save_profile' then 'AWAITING_LANGUAGE' when 'ask_language' then 'AWAITING_LANGUAGE' when 'set_language' then 'MAIN_MENU' when 'classify' then 'MAIN_MENU'
              when 'nothing_more' then 'MAIN_MENU' when 'show_menu' then 'MAIN_MENU' when 'ask_input' then case when st = 'CASE_STATUS' then st when said = '1' then 'CASE_STATUS' when said = '2' then 'SECTION_INFO' else 'PRECEDENT_SEARCH' end else st end,
            us, case when action = 'search' then q when action = 'ask_input' and st = 'MAIN_MENU' and said = '3' then null else ch end,
            case when action = 'search' and st = 'PRECEDENT_SEARCH' then {sessions.PAGES} when action = 'next_page' then pg - 1 when action = 'ask_input' and st = 'MAIN_MENU' and said = '3' then 0 else pg end,
            kn or action = 'save_profile', event_id, st, action,
            case action when 'save_profile' then trim(split_part(said, ',', 2)) when 'set_language' then w when 'classify' then said when 'search' then case when st = 'CASE_STATUS' then upper(c) else said end end,
            case when action = 'search' and ch is distinct from q then case st when 'CASE_STATUS' then 1 else 2 end else 0 end
          from (
            select *, case when st = 'CASE_STATUS' then c else w end as q, case
              when st is null then case when kn then 'greet' else 'ask_profile' end
              when st = 'AWAITING_PROFILE' then case when len(string_split(said, ',')) = 4 then 'save_profile' else 'ask_profile' end
              when st = 'AWAITING_LANGUAGE' then case when w in ('1', '2', '3') then 'set_language' when regexp_matches(lower(said), '{_ASKS}') then 'classify' else 'ask_language' end
              when w in ('more', 'next') then case when pg > 0 then 'next_page' else 'nothing_more' end
              when said = '0' or (said = '' and st <> 'CASE_STATUS') then 'show_menu'
              when st = 'MAIN_MENU' then case when said in ('1', '2', '3') then 'ask_input' else 'classify' end
              when st = 'CASE_STATUS' then case when regexp_full_match(c, '[a-z]{{4}}[0-9]{{8}}(19|20)[0-9]{{2}}') then 'search' when length(c) >= 10 and length(regexp_replace(c, '[^0-9]', '', 'g')) >= 6 then 'ask_input' else 'classify' end
              when w in ('thanks', '') then 'classify' else 'search' end as action
            from (select m.*, case when r.last is null or m.us - r.last > {TTL}::bigint * 1000000 then null else r.state end as st, case when m.us - r.last > {TTL}::bigint * 1000000 then 0 else r.pages end as pg,
                  case when m.us - r.last > {TTL}::bigint * 1000000 then null else r.charged end as ch, r.known or m.told as kn from r join m on m.user_id = r.user_id and m.n = r.n + 1)))
        select user_id, event_id, before, state as after, action, argument, charge from r where n > 0
    """,
    "copied_columns": """
        select l_orderkey, l_linenumber, case when l_orderkey % 10 = 0 then '2031-01-01' when l_orderkey % 5 = 0 then '2030-01-01' else o_orderdate::date::varchar end as day,
               case when l_orderkey % 10 = 0 then 'NONE' else o_orderpriority end as priority from lineitem join orders on o_orderkey = l_orderkey
    """,
    "filled_vectors": """
        select doc_id, case when doc_id % 4 = 0 then 5 else 1 end as dims, case when doc_id % 4 = 0 then length(regexp_replace(text, '[^aeiou]', '', 'g'))::double else n_chars::double end as total from documents
    """,
}
