"""Queries of answer reports, named cases, numbers with two meanings, field weights, comparisons and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import legal
from tessera.operators import answers, lookup, retrieval
from tessera.session import table

DAY = "2024-01-20"
WORDS = ["license", "data", "the", "and"]
_ANSWER = (
    "case p_size % 4 when 0 then concat('Held in (2014) 2 SCC ', p_partkey, ' and (2014) 2 SCC ', p_partkey, '0.') when 1 then concat('See (2014)  2 SCC ', p_partkey, ' or (2014)\\n2 SCC ', p_partkey, ', u/s ', p_size, ' IPC.') "
    "when 2 then concat('*Case* (A.I.R. ', 1950 + p_size, ' S.C. ', p_partkey, ') and ( AIR ', 1951 + p_size, ' SC ', p_partkey, ' ) hold.') else concat('AIR ', 1950 + p_size, ' SC ', p_partkey, '; section ', p_size, ' of the IPC, ', p_name) end"
)
_SCC, _AIR = "concat('2014 (2) SCC ', p_partkey)", "concat('AIR ', 1950 + p_size, ' SC ', p_partkey)"
_CLASSED = "if(p_size % 2 = 0, concat('Theft is bailable. Punished as ', p_size, ' says.\\nPlain line.\\nIt is cognizable!'), 'Nothing said. Of it.')"
_ASKED = "case p_size % 5 when 0 then 'IPC 302 ka BNS mein kya hua' when 1 then 'what is bail' when 2 then 'यह hai ka kya' when 3 then 'Hinglish, please' else 'the ki' end"
_TITLE = "if(p_size % 4 = 0, p_name, concat('<b>', if(p_size % 2 = 0, 'Section', 'article'), '</b> ', p_size, 'a in The <b>', p_brand, '</b> Act, ', 1900 + p_size))"


def _refs(spark: SparkSession, sf_dir: str, scc: str, air: str, ipc: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    listed = [part.filter(scc).select(F.expr(_SCC)), part.filter("p_partkey % 5 = 0").select(F.expr(f"concat({_SCC}, '0')")), part.filter(air).select(F.expr(_AIR)), part.filter(ipc).select(F.expr("concat('ipc  ', p_size)")).distinct()]
    return lookup.union_all([df.toDF("ref") for df in listed])


def answer_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations and sections in one report: beginnings of real ones, blanks and line breaks in them, brackets and dots; what is known, and what was shown, is listed in another spelling."""
    texts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ANSWER).alias("answer"))
    known, shown = _refs(spark, sf_dir, "p_partkey % 3 = 0", "p_size <= 25", "p_size % 2 = 1"), _refs(spark, sf_dir, "p_partkey % 2 = 0", "p_size % 3 = 0", "p_size % 5 = 0")
    found = answers.report(texts, known, shown, "p_partkey", "answer", legal.reference_places, legal.reference_key)
    return found.withColumns({c: F.array_join(c, "; ") for c in ("removed", "flagged", "verified")})


def citation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr(f"array(concat('2014 INSC ', p_partkey), {_AIR}, concat('2014 SCC (Cri) ', p_size), {_SCC})")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(answers.by_report(made), "; ").alias("cited"))


def named_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer stand in for judgments that answer to one name."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 100).alias("score"), F.col("o_orderpriority").alias("court"), F.year("o_orderdate").alias("day"))
    return answers.named_case(rows, "o_custkey", "score", F.col("court") == "1-URGENT", "court", "day", "o_orderkey", 50)


def two_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    mapping = part.select(F.lit("IPC").alias("old_act"), F.col("p_size").cast("string").alias("old_section"), F.lit("BNS").alias("new_act"), F.expr("cast(if(p_size % 5 = 0, p_size, p_partkey % 3 + p_size) as string)").alias("new_section"))
    sections = part.filter("p_size % 2 = 0").select(F.lit("BNS").alias("act"), F.col("p_size").cast("string").alias("section"), F.col("p_name").alias("title"))
    return answers.ambiguous_numbers(mapping, sections, "IPC", "BNS").withColumn("now", F.array_join("now", "; "))


def field_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    scored = answers.weighted_hits(docs, WORDS, {"title": 1.0, "text": 0.25}, "doc_id")
    return retrieval.ranked(scored, [F.desc("score"), F.asc("doc_id")], 40, "rank")


def word_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = docs.filter("doc_id % 7 <> 0").withColumn("text", F.expr("case doc_id % 3 when 0 then concat(text, ' more') when 1 then replace(text, ' ', '  ') else text end"))
    return answers.compared(docs, changed, "doc_id", "text")


def unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", answers.without_sentences(F.expr(_CLASSED), r"(?i)\b(?:cognizable|bailable|compoundable)\b").alias("said"))


def asked_in_hinglish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", answers.hinglish(F.expr(_ASKED)).alias("hinglish"))


def law_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", answers.law_title(F.expr(_TITLE)).alias("t"))
    asked = F.concat(F.lit("Act (old) of "), F.col("p_brand"), F.when(F.col("p_size") % 3 == 0, F.lit(" 1899")).otherwise(F.lit("")))
    return rows.select("p_partkey", "t.word", "t.number", "t.act", answers.same_act(asked, F.col("t.act")).alias("same"))


def flagged_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    top = answers.page(e, [F.desc("ts"), F.desc("event_id")], 100, 20, F.col("event_type") == "error")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return top.join(users, "user_id", "left").select("event_id", "c_name", "ts", "value")


def searches_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(f"cast(ts as timestamp_ntz) >= timestamp_ntz '{DAY}'")
    return e.groupBy("user_id").agg(F.count("*").alias("n"))


def plan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") >= 50, F.year("o_orderdate").cast("string")).alias("archived"), "o_orderpriority")
    return answers.page(plans, [F.asc_nulls_first("archived"), F.asc("o_orderpriority"), F.asc("o_orderkey")], 100, 10)


def pending_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, role = F.expr("if(c_custkey % 3 = 0, 'SUBMITTED', 'NONE')"), F.expr("case c_custkey % 4 when 0 then 'GUEST' when 1 then 'ADVOCATE' when 2 then 'ADMIN' else 'GUEST' end")
    users = table(spark, sf_dir, "customer").select("c_custkey", status.alias("status"), role.alias("role"))
    decisions = users.filter("status = 'SUBMITTED'").select("c_custkey", F.expr("if(c_custkey % 2 = 0, 'VERIFIED', 'REJECTED')").alias("status"))
    return answers.decided(users, decisions, "c_custkey")


QUERIES = {
    f.__name__: f
    for f in (
        answer_reports,
        citation_order,
        named_cases,
        two_meanings,
        field_weights,
        word_differences,
        unclassified,
        asked_in_hinglish,
        law_titles,
        flagged_searches,
        searches_on_day,
        plan_listing,
        pending_decisions,
    )
}
_LISTED = ", ".join(f"'{w}'" for w in WORDS)
_HITS = rf"len(list_filter(regexp_split_to_array(lower({{}}), '[\s.,;:!?]+'), lambda w: w in ({_LISTED})))"
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')"
ORACLES = {
    "answer_reports": rf"""
        with t as (select p_partkey, {_ANSWER.replace(chr(92) + "n", "', chr(10), '")} as t from part),
        r as (select distinct p_partkey, unnest(regexp_extract_all(t, '\(2014\)\s+2 SCC [0-9]+|A[.]?I[.]?R[.]? [0-9]{{4}} S[.]?C[.]? [0-9]+|(?:u/s|section) [0-9]+ (?:of the )?IPC')) as said from t),
        k as (select p_partkey, said, regexp_replace(said, '\s+', ' ', 'g') as ref, case when said like '%SCC%' then 'SCC:' || regexp_extract(said, '([0-9]+)$', 1)
              when said like 'A%' then 'AIR:' || regexp_extract(said, '[0-9]{{4}}') || ':' || regexp_extract(said, '([0-9]+)$', 1) else 'IPC:' || regexp_extract(said, '[0-9]+') end as k from r),
        listed as (select 'SCC:' || p_partkey as k, p_partkey % 3 = 0 as known, p_partkey % 2 = 0 as shown from part union all select 'SCC:' || p_partkey || '0', p_partkey % 5 = 0, p_partkey % 5 = 0 from part
              union all select 'AIR:' || (1950 + p_size) || ':' || p_partkey, p_size <= 25, p_size % 3 = 0 from part union all select 'IPC:' || p_size, p_size % 2 = 1, p_size % 5 = 0 from part),
        m as (select k, bool_or(known) as known, bool_or(shown) as shown from listed group by k),
        s as (select p_partkey, list(said order by said desc) filter (not coalesce(known, false)) as bad, list(distinct ref order by ref) filter (not coalesce(known, false)) as removed,
              list(distinct ref order by ref) filter (known and not shown) as flagged, list(distinct ref order by ref) filter (known) as verified from k left join m using (k) group by p_partkey),
        f as (select p_partkey, t, coalesce(bad, []) as bad, coalesce(removed, []) as removed, coalesce(flagged, []) as flagged, coalesce(verified, []) as verified from t left join s using (p_partkey)),
        u as (select *, list_reduce(list_prepend(t, bad), lambda x, w: regexp_replace(regexp_replace(x, '\(\s*' || regexp_escape(w) || '\s*\)', '[unverified]', 'g'), regexp_escape(w) || '\b', '[unverified]', 'g')) as struck from f)
        select p_partkey, struck || case when len(removed) > 0 then chr(10) || chr(10) || '_References that could not be verified were removed._' else '' end as answer,
               array_to_string(removed, '; ') as removed, array_to_string(flagged, '; ') as flagged, array_to_string(verified, '; ') as verified, len(removed) + len(flagged) > 0 as triggered,
               concat_ws('; ', case when len(removed) > 0 then len(removed) || ' removed' end, case when len(flagged) > 0 then len(flagged) || ' not shown' end) as reason from u
    """,
    "citation_order": "select p_partkey, '2014 (2) SCC ' || p_partkey || '; AIR ' || (1950 + p_size) || ' SC ' || p_partkey || '; 2014 INSC ' || p_partkey || '; 2014 SCC (Cri) ' || p_size as cited from part",
    "named_cases": """
        with r as (select o_custkey, o_orderkey, o_orderkey % 100 as score, o_orderpriority as court, year(o_orderdate)::int as day from orders where o_orderkey % 100 >= 50),
        t as (select * from r qualify court = '1-URGENT' or not bool_or(court = '1-URGENT') over (partition by o_custkey)),
        u as (select * from t qualify row_number() over (partition by o_custkey, court, day order by score desc, o_orderkey) = 1)
        select *, row_number() over (partition by o_custkey order by score desc, o_orderkey)::int as position from u
        qualify row_number() over (partition by o_custkey order by score desc, o_orderkey) <= 3
    """,
    "two_meanings": """
        with m as (select distinct p_size::varchar as number, (case when p_size % 5 = 0 then p_size else p_partkey % 3 + p_size end)::varchar as s from part),
        w as (select number, string_agg(s, '; ' order by s) as now from m group by 1 having bool_or(s <> number))
        select number, now, min(p_name) as title from w join part on p_size::varchar = number where p_size % 2 = 0 group by 1, 2
    """,
    "field_weights": f"""
        with s as (select doc_id, {_HITS.format("split_part(text, chr(10), 1)")} * 1.0::double + {_HITS.format("text")} * 0.25::double as score from documents)
        select doc_id, score, row_number() over (order by score desc, doc_id)::int as rank from s where score > 0 order by score desc, doc_id limit 40
    """,
    "word_differences": f"""
        with d as (select doc_id, {_WORDS.format("text")} as ws from documents)
        select doc_id, case when doc_id % 7 = 0 then 'missing' when doc_id % 3 = 0 then 'differs' else 'same' end as status, len(ws)::int as our_words,
               case when doc_id % 7 <> 0 then (len(ws) + case when doc_id % 3 = 0 then 1 else 0 end)::int end as their_words from d
    """,
    "unclassified": "select p_partkey, case when p_size % 2 = 0 then 'Punished as ' || p_size || ' says.' || chr(10) || 'Plain line.' else 'Nothing said. Of it.' end as said from part",
    "asked_in_hinglish": "select p_partkey, p_size % 5 in (0, 3) as hinglish from part",
    "law_titles": """
        select p_partkey, case when p_size % 4 = 0 then null when p_size % 2 = 0 then 'Section' else 'Article' end as word, case when p_size % 4 > 0 then p_size || 'A' end as number,
               case when p_size % 4 > 0 then 'The ' || p_brand || ' Act, ' || (1900 + p_size) end as act, case when p_size % 4 > 0 then p_size % 3 > 0 end as same from part
    """,
    "flagged_searches": """
        with t as (select event_id, user_id, ts::timestamp as ts, value from events where event_type = 'error' order by ts desc, event_id desc limit 100 offset 20)
        select event_id, c_name, ts, value from t left join customer on c_custkey = user_id
    """,
    "searches_on_day": f"select user_id, count(*) as n from events where ts::timestamp >= timestamp '{DAY}' group by 1",
    "plan_listing": """
        with p as (select o_orderkey, case when o_orderkey >= 50 then year(o_orderdate)::varchar end as archived, o_orderpriority from orders)
        select * from p order by archived nulls first, o_orderpriority, o_orderkey limit 100 offset 10
    """,
    "pending_decisions": """
        with u as (select c_custkey, c_custkey % 3 = 0 as asked, c_custkey % 2 = 0 as ok, case c_custkey % 4 when 1 then 'ADVOCATE' when 2 then 'ADMIN' else 'GUEST' end as role from customer)
        select c_custkey, case when not asked then 'NONE' when ok then 'VERIFIED' else 'REJECTED' end as status,
               case when asked and ok and role = 'GUEST' then 'ADVOCATE' when asked and not ok and role = 'ADVOCATE' then 'GUEST' else role end as role from u
    """,
}
