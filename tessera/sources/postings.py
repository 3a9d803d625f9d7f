"""Stored postings: an index of terms and one of trigrams, of which a search reads the asked ones alone.

Postings lie in folders by a hash of the term and, in a file, in the order of
terms, so partition filters and row group statistics leave the rest unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.search import Query
from tessera.functions.text import terms, trigram_similarity, trigrams
from tessera.session import dealt

BUCKETS = 64


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int) -> None:
    """Rows with a term: dealt by range, so a frequent term is written by several tasks."""
    placed = rows.withColumn("bucket", _bucket(F.col("term"), buckets))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("bucket"), F.col("term"), F.col("key")]
    placed.repartitionByRange(n, *by).sortWithinPartitions(*by).write.partitionBy("bucket").parquet(path)


def term_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (term, key, positions) of the texts' terms.  Texts are dealt by key, so their terms meet where they are."""
    texts = dealt(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    rows = texts.select("key", F.posexplode(terms(F.col("text"))).alias("at", "term"))
    return rows.groupBy("term", "key").agg(F.array_sort(F.collect_list("at")).alias("positions"))  # of one text


def build_terms(docs: DataFrame, path: str, key: str, text: str, buckets: int = BUCKETS) -> None:
    """Writes the postings (term, key, positions) of the texts' terms, and the keys of all documents.  Keys have to be unique."""
    _write(term_rows(docs, key, text), f"{path}/postings", buckets)
    docs.select(F.col(key).alias("key")).write.parquet(f"{path}/keys")


def postings(spark: SparkSession, path: str, asked: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The stored rows of the asked terms."""
    wanted = sorted({r.b for r in spark.createDataFrame([(w,) for w in asked], "t string").select(_bucket(F.col("t"), buckets).alias("b")).collect()}) if asked else []
    rows = spark.read.parquet(path)
    return rows.filter(F.col("bucket").isin(wanted) & F.col("term").isin(asked)).drop("bucket")


def web_search(spark: SparkSession, path: str, query: Query, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Keys of the documents that meet a query, as ``tessera.functions.search.matches`` tells; column ``key``.

    Only the postings of the query's words are read, and the keys of all
    documents if it has nothing but words to leave out.
    """
    sides = [(i, alt) for i, group in enumerate(query.groups) for alt in group] + [(-1, never) for never in query.never]
    if not sides:
        return spark.read.parquet(f"{path}/keys").filter(F.lit(False)).withColumnRenamed("key", key)
    alternatives = [(n, i, term.split()) for n, (i, term) in enumerate(sides)]
    asked = [(n, i, len(ws), at, w) for n, i, ws in alternatives for at, w in enumerate(ws)]
    parts = spark.createDataFrame(asked, "alternative int, grp int, size int, at int, term string")
    met = postings(spark, f"{path}/postings", [a[-1] for a in asked], buckets).join(F.broadcast(parts), "term")  # a row a word of the query
    matched = met.filter("size = 1").select("key", "grp")
    starts = met.filter("size > 1").select("key", "grp", "alternative", "size", "at", F.explode("positions").alias("place"))
    phrases = starts.groupBy("key", "grp", "alternative", "size", F.col("place") - F.col("at")).agg(F.count("*").alias("n")).filter("n = size").select("key", "grp")
    if any(a[2] > 1 for a in asked):
        matched = matched.unionByName(phrases)
    found = matched.distinct().groupBy("key").agg(F.count_if(F.col("grp") >= 0).alias("_met"), F.bool_or(F.col("grp") < 0).alias("_never"))
    if query.groups:
        kept = found.filter((F.col("_met") == len(query.groups)) & ~F.col("_never")).select("key")
    else:
        kept = spark.read.parquet(f"{path}/keys").join(found, "key", "left_anti")
    return kept.withColumnRenamed("key", key)


def build_trigrams(rows: DataFrame, path: str, key: str, text: str, buckets: int = BUCKETS) -> None:
    """Writes the postings (term, key, text) of the texts' trigrams, and how many rows have each.  For short texts, such as names; keys have to be unique."""
    grams = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.explode(trigrams(F.col(text))).alias("term"))
    _write(grams, f"{path}/postings", buckets)
    counts = grams.groupBy("term").agg(F.count("*").alias("n")).withColumn("bucket", _bucket(F.col("term"), buckets))
    counts.write.partitionBy("bucket").parquet(f"{path}/counts")


def similar(spark: SparkSession, path: str, text: str, least: float, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows (key, similarity) whose trigram similarity with ``text`` is above ``least``.

    A row that is similar enough shares more than least * n of the text's n
    trigrams, so it has one of all but that many; the rarest of these are read,
    and their rows checked.
    """
    row = spark.range(1).select(trigrams(F.lit(text)).alias("g")).first()
    known = {r.term: r.n for r in postings(spark, f"{path}/counts", row.g, buckets).collect()} if row.g else {}
    prefix = sorted(row.g, key=lambda g: (known.get(g, 0), g))[: len(row.g) - int(least * len(row.g))]
    near = postings(spark, f"{path}/postings", [g for g in prefix if g in known], buckets).select("key", "text").distinct()
    scored = near.select(F.col("key").alias(key), trigram_similarity(F.col("text"), F.lit(text)).alias("similarity"))
    return scored.filter(F.col("similarity") > least)
