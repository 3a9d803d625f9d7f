"""Full-text queries: boolean search, BM25, expansion, topics, hashed vectors, intents, time zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import search
from tessera.functions.text import terms
from tessera.operators import retrieval
from tessera.operators.lookup import union_all
from tessera.session import scratch, table
from tessera.sources import postings

RULES = [("numbers", "[0-9]{6,}"), ("mail", "[a-z0-9]@[a-z0-9]"), ("long", "(?s)^.{3000}"), ("question", "[?]")]
SYNONYMS = [["the", "der", "le", "el"], ["that", "que"], ["zebra", "quagga"]]


def web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = search.web_query('the or der -that')
    return table(spark, sf_dir, "documents").filter(search.matches(terms(F.col("text")), query)).select("doc_id", "lang")


INDEXED = ("the or der -that", '"of the" -nd', "-the", "ciónnñ or absent")


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several searches by one stored index of terms."""
    path = scratch(spark, "terms")
    postings.build_terms(table(spark, sf_dir, "documents"), path, "doc_id", "text")
    found = [postings.web_search(spark, path, search.web_query(q), "doc_id").withColumn("search", F.lit(i)) for i, q in enumerate(INDEXED)]
    return union_all(found).select("search", "doc_id")


def indexed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose name is like a misspelt one, by a stored index of trigrams."""
    path = scratch(spark, "trigrams")
    postings.build_trigrams(table(spark, sf_dir, "customer"), path, "c_custkey", "c_name")
    return postings.similar(spark, path, "Custommer 000000123", 0.6, "c_custkey").select("c_custkey", F.round("similarity", 6).alias("similarity"))


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = search.web_query('"of the"')
    return table(spark, sf_dir, "documents").filter(search.matches(terms(F.col("text")), query)).select("doc_id")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25_topk(table(spark, sf_dir, "documents"), ["the", "this", "for"], 40)
    return found.select("doc_id", F.round("score", 6).alias("score"), "sparse_rank")


def expanded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = search.expanded(["the", "that"], SYNONYMS, 6)
    found = retrieval.lexical_topk(table(spark, sf_dir, "documents"), query, 30)
    return found.select("doc_id", "hits", "sparse_rank")


def topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(search.topic(F.col("text")), " ").alias("topic"))


def covered_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ("the", "that", "this", "with")))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(search.covered_share(wanted, F.col("text")), 4).alias("share"))


def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "bucket", F.round("value", 6).alias("value"))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(search.intent(F.col("text"), RULES, "other").alias("intent")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def number_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.expr("concat(p_size, ' to ', p_size + 2, ', 171-I and ', p_partkey, '(1)')")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(search.number_ranges(listed), " ").alias("sections"))


def local_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by local day of a zone five and a half hours ahead, with the month's name."""
    local = F.expr("cast(ts as timestamp_ntz) + interval 330 minutes")
    day = F.date_trunc("day", local.cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.date_format(day, "yyyy-MM-dd").alias("day"), F.date_format(day, "MMMM yyyy").alias("month"))
    return rows.groupBy("day", "month").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (web_search, indexed_search, indexed_names, phrase_search, bm25_topk, expanded_search, topic_words, covered_share, hashed_vectors, intents, number_ranges, local_months)}
_TERMS = "list_filter(string_split_regex(lower(text), '[\\s.,;:!?]+'), lambda w: w <> '')"
_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> '')"
_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIM = lambda a, b: f"(len(list_intersect({_TRI.format(a)}, {_TRI.format(b)}))::double / len(list_distinct(list_concat({_TRI.format(a)}, {_TRI.format(b)}))))"
_STOP = ", ".join(f"'{w}'" for w in sorted(search.STOP))
_EXPANDED = "'the', 'that', 'der', 'le', 'el', 'que'"
ORACLES = {
    "web_search": f"with t as (select doc_id, lang, {_TERMS} as t from documents) select doc_id, lang from t where (list_contains(t, 'the') or list_contains(t, 'der')) and not list_contains(t, 'that')",
    "indexed_search": f"""
        with t as (select doc_id, {_TERMS} as t from documents)
        select 0 as search, doc_id from t where (list_contains(t, 'the') or list_contains(t, 'der')) and not list_contains(t, 'that')
        union all select 1, doc_id from t where contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') and not list_contains(t, 'nd')
        union all select 2, doc_id from t where not list_contains(t, 'the')
        union all select 3, doc_id from t where list_contains(t, 'ciónnñ') or list_contains(t, 'absent')
    """,
    "indexed_names": f"select c_custkey, round(s, 6) as similarity from (select c_custkey, {_SIM('c_name', chr(39) + 'Custommer 000000123' + chr(39))} as s from customer) where s > 0.6",
    "phrase_search": f"with t as (select doc_id, ' ' || array_to_string({_TERMS}, ' ') || ' ' as t from documents) select doc_id from t where contains(t, ' of the ')",
    "bm25_topk": f"""
        with t as (select doc_id, {_TERMS} as t from documents),
        c as (select doc_id, len(t) as n, {', '.join(f"len(list_filter(t, lambda w: w = '{w}')) as f{i}" for i, w in enumerate(("the", "this", "for")))} from t),
        s as (select count(*) as docs, avg(n) as mean, count(*) filter (f0 > 0) as d0, count(*) filter (f1 > 0) as d1, count(*) filter (f2 > 0) as d2 from c),
        r as (select doc_id, round({' + '.join(f'ln(1 + (docs - d{i} + 0.5::double) / (d{i} + 0.5::double)) * f{i} * 2.2::double / (f{i} + 1.2::double * (0.25::double + 0.75::double * n / mean))' for i in range(3))}, 9) as score from c, s where f0 + f1 + f2 > 0)
        select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as sparse_rank from r qualify sparse_rank <= 40
    """,
    "expanded_search": f"""
        with h as (select doc_id, len(list_filter({_TERMS}, lambda w: w in ({_EXPANDED}))) as hits from documents)
        select doc_id, hits, row_number() over (order by hits desc, doc_id) as sparse_rank from h where hits > 0 qualify sparse_rank <= 30
    """,
    "topic_words": f"select doc_id, array_to_string(list_filter({_WORDS}, lambda w: w not in ({_STOP}) and not regexp_matches(w, '^[0-9]+$')), ' ') as topic from documents",
    "covered_share": f"select doc_id, round(len(list_intersect(['the', 'that', 'this', 'with'], {_WORDS})) / 4.0::double, 4) as share from documents",
    "hashed_vectors": f"""
        with w as (select doc_id, unnest({_TERMS}) as w from documents), c as (select doc_id, sha256(w) as h, count(*) as n from w group by doc_id, w),
        b as (select doc_id, ('0x' || substr(h, 1, 7))::bigint % 64 as bucket, case when ('0x' || substr(h, 8, 7))::bigint % 2 = 0 then n else -n end as v from c union all
              select doc_id, ('0x' || substr(h, 15, 7))::bigint % 64, case when ('0x' || substr(h, 22, 7))::bigint % 2 = 0 then n else -n end from c),
        s as (select doc_id, bucket, sum(v)::bigint as v from b group by 1, 2 having sum(v) <> 0)
        select doc_id, bucket, round(v / sqrt(sum(v * v) over (partition by doc_id)::double), 6) as value from s
    """,
    "intents": """
        with i as (select doc_id, case when regexp_matches(lower(text), '[0-9]{6,}') then 'numbers' when regexp_matches(lower(text), '[a-z0-9]@[a-z0-9]') then 'mail'
                   when length(text) >= 3000 then 'long' when contains(text, '?') then 'question' else 'other' end as intent from documents)
        select intent, count(*) as n, min(doc_id) as first_doc from i group by 1
    """,
    "number_ranges": """
        select p_partkey, array_to_string(list_distinct_in_order, ' ') as sections from (select p_partkey, [p_size::varchar, (p_size + 1)::varchar, (p_size + 2)::varchar, '171-I', p_partkey || '(1)'] as list_distinct_in_order from part)
    """,
    "local_months": """
        with e as (select date_trunc('day', ts + interval 330 minutes) as d from events)
        select strftime(d, '%Y-%m-%d') as day, strftime(d, '%B %Y') as month, count(*) as n from e group by 1, 2
    """,
}
