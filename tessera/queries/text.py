"""Text queries: extraction, cleaning, chunking, ingest keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import legal, scanners
from tessera.functions import text as tx
from tessera.operators import events as ev
from tessera.session import table

_NUMBERED = "concat('In u/s ', p_size, ' of the IPC, see AIR ', 1950 + p_size, ' SC ', p_partkey, ' and (2014) 2 SCC ', p_partkey, '; CNR DLCT01-', lpad(p_partkey, 6, '0'), '-2024')"


def extract_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and long numbers in every document."""
    t = F.col("text")
    count = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    ip = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
    return table(spark, sf_dir, "documents").select("doc_id", count(ip).alias("ips"), count(r"[a-z0-9._]+@[a-z0-9.]+").alias("mails"), count(r"\b\d{10,}\b").alias("numbers"), F.nullif(F.regexp_extract("text", ip, 0), F.lit("")).alias("first_ip"))


def legal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_NUMBERED).alias("t")).withColumn("cited", legal.citations(t))
    return rows.select("p_partkey", legal.section(t).alias("section"), legal.named_act(t).alias("act"), legal.cnr(t).alias("cnr"), F.array_join(F.array_sort("cited"), "; ").alias("citations"), legal.canonical_citation(F.col("cited")[0]).alias("key"))


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("plain")).select("page_id", F.md5("plain").alias("digest"), F.length("plain").alias("chars"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    host = F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.trim(title).alias("title"), host.alias("host"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanners.page_sections(table(spark, sf_dir, "pages"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanners.chunk_documents(table(spark, sf_dir, "documents"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows of 1200 characters with an overlap of 200, by expressions alone."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text") - 200, F.lit(1)), F.lit(1000))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(starts).alias("chunk_index", "at"))
    return rows.select("doc_id", "chunk_index", F.md5(F.substring("text", F.col("at"), F.lit(1200))).alias("digest"))


def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(scanners.message_parts(F.col("text"))).alias("part", "body"))
    return rows.select("doc_id", "part", F.length("body").alias("chars"))


def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", tx.content_hash(F.col("text")).alias("content_hash"))
    return ev.claim_first(docs, ["content_hash"], ["doc_id"])


def context_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.context_key(F.col("text"))).alias("key"))
    return docs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.sum(tx.token_estimate(F.col("text"))).alias("tokens"), F.max(F.length("text")).alias("longest"))


def case_name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier against the customer with its number, as if both were parties of a case."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" v. ", F.replace("c_name", F.lit("#"), F.lit(" ")), "c_mktsegment").alias("asked"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.concat_ws(" versus ", F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit("BUILDINGS")).alias("title"))
    return c.join(s, "c_custkey").select("c_custkey", F.round(legal.name_score(F.col("asked"), F.col("title")), 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (extract_refs, legal_references, html_strip, page_titles, page_sections, chunk_documents, chunk_windows, message_parts, content_dedupe, context_keys, token_estimates, case_name_scores)
}
_IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
_STRIP = "html"
for _p, _r in ((r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " ")):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '{_r}', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_e}', '{_c}')"
_STRIP = rf"trim(regexp_replace({_STRIP}, '\s+', ' ', 'g'))"
ORACLES = {
    "extract_refs": rf"""
        select doc_id, len(regexp_extract_all(text, '{_IP}'))::int as ips, len(regexp_extract_all(text, '[a-z0-9._]+@[a-z0-9.]+'))::int as mails,
               len(regexp_extract_all(text, '\b\d{{10,}}\b'))::int as numbers, nullif(regexp_extract(text, '{_IP}'), '') as first_ip from documents
    """,
    "legal_references": """
        select p_partkey, p_size::varchar as section, 'IPC' as act, 'DLCT01' || lpad(p_partkey::varchar, 6, '0') || '2024' as cnr,
               '(2014) 2 SCC ' || p_partkey || '; AIR ' || (1950 + p_size) || ' SC ' || p_partkey as citations, 'AIR:' || (1950 + p_size) || ':SC:' || p_partkey as key from part
    """,
    "html_strip": f"select page_id, md5({_STRIP}) as digest, length({_STRIP}) as chars from pages",
    "page_titles": r"select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, regexp_extract(url, '^https?://([^/:?#]+)', 1) as host from pages",
    "chunk_windows": """
        with s as (select doc_id, text, unnest(generate_series(0, (greatest(length(text) - 200, 1) - 1) // 1000)) as chunk_index from documents)
        select doc_id, chunk_index, md5(substr(text, 1 + 1000 * chunk_index, 1200)) as digest from s
    """,
    "content_dedupe": "select doc_id, source, sha256(text) as content_hash from documents qualify row_number() over (partition by text order by doc_id) = 1",
    "context_keys": """
        with k as (select doc_id, md5(array_to_string(list_sort(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> '')), ' ')) as key from documents)
        select key, count(*) as n, min(doc_id) as first_doc from k group by 1
    """,
    "token_estimates": "select lang, sum(ceil(length(text) / 4.0))::bigint as tokens, max(length(text)) as longest from documents group by 1",
}
