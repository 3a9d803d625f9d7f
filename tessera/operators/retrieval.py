"""Hybrid retrieval: lexical and dense rankings, reciprocal-rank fusion, collapse to one row a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import hits, terms


def ranked(df: DataFrame, order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows by ``order`` with their rank; only those k rows meet in one partition."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def lexical_topk(docs: DataFrame, query: list[str], k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, hits, sparse_rank): the k documents with most occurrences of the query's terms."""
    scored = docs.select(key, hits(terms(F.col(text)), query).alias("hits")).filter("hits > 0")
    return ranked(scored, [F.desc("hits"), F.asc(key)], k, "sparse_rank")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two vectors, in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1 - dot(a, b) / F.nullif(norm, F.lit(0.0))


def dense_topk(vectors: DataFrame, query: DataFrame, k: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (key, distance, dense_rank): the k vectors nearest to the one vector in ``query``; null vectors don't count."""
    q = query.select(F.col(vector).alias("_q")).limit(1)
    known = vectors.filter(F.col(vector).isNotNull())
    near = known.crossJoin(F.broadcast(q)).select(key, F.round(cosine_distance(F.col(vector), F.col("_q")), 9).alias("distance"))  # q is one row
    return ranked(near.filter("distance is not null"), [F.asc("distance"), F.asc(key)], k, "dense_rank")


def fuse(dense: DataFrame | None, sparse: DataFrame, key: str, rrf_k: int = 60) -> DataFrame:
    """Rows (key, dense_rank, sparse_rank, score) with score = sum of 1 / (rrf_k + rank); without vectors dense_rank is null."""
    sparse = sparse.select(key, "sparse_rank")
    both = dense.select(key, "dense_rank").join(sparse, key, "full") if dense is not None else sparse.withColumn("dense_rank", F.lit(None).cast("int"))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    return both.select(key, "dense_rank", "sparse_rank", (part("dense_rank") + part("sparse_rank")).alias("score"))


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``, which has to be total for a defined result."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def hybrid_passages(docs: DataFrame, vectors: DataFrame | None, query_vector: DataFrame | None, query: list[str], dense_k: int = 50, sparse_k: int = 50, rrf_k: int = 60, final_k: int = 5) -> DataFrame:
    """The final_k documents by fused score, with their columns.

    ``docs`` comes filtered: a filter above a top-k can't be pushed below it.
    Texts are joined back last, for the candidates only.
    """
    allowed = docs.select("doc_id")
    dense = None
    if vectors is not None:
        own = vectors.withColumnRenamed("vec_id", "doc_id").join(allowed, "doc_id", "left_semi")
        dense = dense_topk(own, query_vector, dense_k, key="doc_id")
    fused = fuse(dense, lexical_topk(docs, query, sparse_k), "doc_id", rrf_k)
    best = fused.orderBy(F.desc("score"), "doc_id").limit(final_k)
    return docs.join(F.broadcast(best), "doc_id")  # final_k rows


def search_precedents(docs: DataFrame, vectors: DataFrame | None, query_vector: DataFrame | None, query: list[str], k: int = 60, rrf_k: int = 60, limit: int = 15, group: str = "source", recency: str = "n_chars") -> DataFrame:
    """Fused candidates collapsed to the best document of each group; the most relevant groups, newest first.

    Columns: doc_id, group, recency, score, relevance_rank, total_matches.
    """
    meta = docs.select("doc_id", group, recency)
    dense = dense_topk(vectors.withColumnRenamed("vec_id", "doc_id"), query_vector, k, key="doc_id") if vectors is not None else None
    fused = fuse(dense, lexical_topk(docs, query, k), "doc_id", rrf_k)
    placed = meta.join(F.broadcast(fused), "doc_id")  # at most 2 * k rows
    best = first_of_each(placed, [group], [F.desc("score"), F.asc("doc_id")])
    everything = Window.partitionBy(F.lit(1))  # at most 2 * k rows
    order = Window.orderBy(F.desc("score"), F.asc("doc_id"))
    counted = best.withColumns({"total_matches": F.count("*").over(everything), "relevance_rank": F.row_number().over(order)})
    return counted.filter(F.col("relevance_rank") <= limit).orderBy(F.desc(recency), "doc_id")


def closest_to_best(df: DataFrame, score: str, ratio: float, most: int, order: list[Column]) -> DataFrame:
    """Rows whose score is at least ``ratio`` of the best one, at most ``most`` of them."""
    best = df.agg(F.max(score).alias("_best"))
    return df.crossJoin(F.broadcast(best)).filter(F.col(score) >= ratio * F.col("_best")).drop("_best").orderBy(*order).limit(most)  # best is one row


def fallback(variants: list[DataFrame]) -> DataFrame:
    """The rows of the first variant that has any, with its ``priority`` (1 = first)."""
    tagged = [v.withColumn("priority", F.lit(i)) for i, v in enumerate(variants, 1)]
    every = tagged[0]
    for v in tagged[1:]:
        every = every.unionByName(v)
    first = every.agg(F.min("priority").alias("_first"))
    return every.crossJoin(F.broadcast(first)).filter("priority = _first").drop("_first")  # first is one row


def bm25_topk(docs: DataFrame, query: list[str], k: int = 50, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows (key, score, sparse_rank): the k best documents by BM25; document counts and the mean length come from one pass over all texts."""
    counts = docs.select(key, terms(F.col(text)).alias("_t"))
    counts = counts.select(key, F.size("_t").alias("_n"), *((F.size("_t") - F.size(F.array_remove("_t", w))).alias(f"_f{i}") for i, w in enumerate(query)))
    stats = counts.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(query))))
    rows = counts.filter(" or ".join(f"_f{i} > 0" for i in range(len(query)))).crossJoin(F.broadcast(stats))  # stats is one row

    def part(i: int) -> Column:
        d, f = F.col(f"_d{i}"), F.col(f"_f{i}")
        return F.ln(1 + (F.col("_docs") - d + 0.5) / (d + 0.5)) * f * (k1 + 1) / (f + k1 * ((1 - b) + b * F.col("_n") / F.col("_mean")))

    scored = rows.select(key, F.round(sum((part(i) for i in range(1, len(query))), part(0)), 9).alias("score"))
    return ranked(scored, [F.desc("score"), F.asc(key)], k, "sparse_rank")
