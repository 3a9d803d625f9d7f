"""Retrieval queries: hybrid search, its parts, arrangement of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import hits, terms
from tessera.operators import arrange, retrieval
from tessera.session import scratch, table
from tessera.sources import vectors

QUERY = ["the", "that", "tion", "this"]
_IN = ", ".join(f"'{t}'" for t in QUERY)
_HITS = f"len(list_filter(string_split_regex(lower(text), '[\\s.,;:!?]+'), lambda w: w in ({_IN})))"
_SPARSE = f"""
    sparse as (select doc_id, hits, row_number() over (order by hits desc, doc_id) as sparse_rank
               from (select doc_id, {_HITS} as hits from docs) where hits > 0
               qualify sparse_rank <= {{k}})"""
_DENSE = """
    q as (select embedding::double[] as q from embeddings where vec_id = 0),
    dense as (select vec_id as doc_id, distance, row_number() over (order by distance, vec_id) as dense_rank
              from (select vec_id, round(1 - list_cosine_similarity(embedding::double[], q), 9) as distance from embeddings, q {semi})
              qualify dense_rank <= {k})"""
_FUSED = """
    fused as (select coalesce(d.doc_id, s.doc_id) as doc_id, dense_rank, sparse_rank,
                     coalesce(1.0::double / (60 + dense_rank), 0) + coalesce(1.0::double / (60 + sparse_rank), 0) as score
              from dense d full join sparse s on d.doc_id = s.doc_id)"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return table(spark, sf_dir, "documents"), vectors, vectors.filter("vec_id = 0")


def precedent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors, q = _inputs(spark, sf_dir)
    english = docs.filter("lang = 'en'")
    own = vectors.join(english.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    found = retrieval.search_precedents(english, own, q, QUERY)
    return found.select("doc_id", "source", "n_chars", "relevance_rank", "total_matches", F.round("score", 6).alias("score"))


def hybrid_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors, q = _inputs(spark, sf_dir)
    found = retrieval.hybrid_passages(docs.filter("lang = 'en' and n_chars >= 200"), vectors, q, QUERY)
    return found.select("doc_id", "source", "dense_rank", "sparse_rank", F.round("score", 6).alias("score"), "n_chars")


def lexical_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = retrieval.fuse(None, retrieval.lexical_topk(docs, QUERY), "doc_id")
    return found.select("doc_id", "sparse_rank", F.round("score", 6).alias("score"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vectors, q = _inputs(spark, sf_dir)
    return retrieval.dense_topk(vectors, q).select("vec_id", F.round("distance", 6).alias("distance"), "dense_rank")


def closest_to_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", hits(terms(F.col("text")), QUERY).alias("score"))
    return retrieval.closest_to_best(docs.filter("score > 0"), "score", 0.3, 4, [F.desc("score"), F.asc("doc_id")])


def fallback_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", terms(F.col("text")).alias("t"))
    variants = [["zzzz", "qqqq"], ["scum", "moron"], ["the"]]
    found = retrieval.fallback([docs.filter(F.forall(F.array(*map(F.lit, v)), lambda w: F.array_contains("t", w))) for v in variants])
    return found.select("doc_id", "source", "priority")


def arrange_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("lang <> 'es'").select("doc_id", "lang", "n_chars")
    return arrange.by_quota(docs, "lang", ["en", "fr", "de"], (0.4, 0.3, 1.0), 20, [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "lang", "n_chars", "place")


def home_group_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(40)
    return arrange.promote(docs, F.col("source") == "src3", 3, [F.desc("n_chars"), F.asc("doc_id")])


def page_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(10)


def probed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth one, by stored cells; recall is measured in the tests."""
    stored, path = table(spark, sf_dir, "embeddings"), scratch(spark, "vectors")
    vectors.build(stored, path, "vec_id", "embedding", 32)
    return vectors.neighbours(stored.filter("vec_id % 20 = 0"), path, "vec_id", "embedding", 10, 20)


QUERIES = {f.__name__: f for f in (precedent_search, probed_neighbours, hybrid_passages, lexical_only, dense_topk, closest_to_best, fallback_priority, arrange_by_group, home_group_first, page_of_results)}
ORACLES = {
    "precedent_search": f"""
        with docs as (select * from documents where lang = 'en'), {_DENSE.format(k=60, semi="where vec_id in (select doc_id from docs)")}, {_SPARSE.format(k=60)}, {_FUSED},
        best as (select f.doc_id, source, n_chars, score from fused f join docs d on d.doc_id = f.doc_id
                 qualify row_number() over (partition by source order by score desc, f.doc_id) = 1),
        counted as (select *, count(*) over () as total_matches, row_number() over (order by score desc, doc_id) as relevance_rank from best)
        select doc_id, source, n_chars, relevance_rank, total_matches, round(score, 6) as score from counted where relevance_rank <= 15
    """,
    "hybrid_passages": f"""
        with docs as (select * from documents where lang = 'en' and n_chars >= 200), {_DENSE.format(k=50, semi="where vec_id in (select doc_id from docs)")}, {_SPARSE.format(k=50)}, {_FUSED},
        best as (select * from fused order by score desc, doc_id limit 5)
        select b.doc_id, source, dense_rank, sparse_rank, round(score, 6) as score, n_chars from best b join docs d on d.doc_id = b.doc_id
    """,
    "lexical_only": f"with docs as (select * from documents), {_SPARSE.format(k=50)} select doc_id, sparse_rank, round(1.0::double / (60 + sparse_rank), 6) as score from sparse",
    "dense_topk": f"with {_DENSE.format(k=50, semi='')} select doc_id as vec_id, round(distance, 6) as distance, dense_rank from dense",
    "closest_to_best": f"""
        with s as (select doc_id, {_HITS} as score from documents)
        select doc_id, score from s where score > 0 and score >= 0.3 * (select max(score) from s) order by score desc, doc_id limit 4
    """,
    "fallback_priority": """
        with d as (select doc_id, source, string_split_regex(lower(text), '[\\s.,;:!?]+') as t from documents),
        v as (select *, 1 as priority from d where list_has_all(t, ['zzzz', 'qqqq']) union all
              select *, 2 from d where list_has_all(t, ['scum', 'moron']) union all select *, 3 from d where list_has_all(t, ['the']))
        select doc_id, source, priority from v where priority = (select min(priority) from v)
    """,
    "arrange_by_group": """
        with d as (select doc_id, lang, n_chars, case lang when 'en' then 1 when 'fr' then 2 else 3 end as g,
                          row_number() over (partition by lang order by n_chars desc, doc_id) as rn from documents where lang in ('en', 'fr', 'de')),
        n as (select count(*) filter (g = 1) as g1, count(*) filter (g = 2) as g2, count(*) filter (g = 3) as g3 from d),
        t as (select g1, g2, g3, least(g1, 8) as t1, least(g2, 6) as t2, least(g3, 20) as t3 from n),
        s as (select *, greatest(20 - t1 - t2 - t3, 0) as spare from t),
        x as (select *, least(spare, g1 - t1) as e1 from s),
        y as (select *, least(spare - e1, g2 - t2) as e2 from x),
        z as (select t1 + e1 as k1, t2 + e2 as k2, t3 + least(spare - e1 - e2, g3 - t3) as k3 from y),
        p as (select doc_id, lang, n_chars, row_number() over (order by g, rn) as place from d, z
              where rn <= case g when 1 then k1 when 2 then k2 else k3 end)
        select * from p where place <= 20
    """,
    "home_group_first": """
        with top as (select doc_id, source, n_chars from documents order by n_chars desc, doc_id limit 40),
        r as (select *, row_number() over (partition by source = 'src3' order by n_chars desc, doc_id) as rn from top)
        select doc_id, source, n_chars, row_number() over (order by case when source = 'src3' and rn <= 3 then 0 else 1 end, n_chars desc, doc_id) as place from r
    """,
    "page_of_results": "select doc_id, lang, n_chars from documents order by n_chars desc, doc_id limit 10 offset 20",
}
