"""Queries of questions on a subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.search import STOP
from tessera.functions.text import words
from tessera.operators import subjects
from tessera.session import table

_SENTENCE = r"^[^.!?\n]*"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each benchmark text as a question."""
    asked = F.filter(words(F.regexp_extract("text", _SENTENCE, 0)), lambda w: ~w.isin(*sorted(STOP)))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(asked).alias("asked"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with their first sentence as title."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", _SENTENCE, 0).alias("title"), "text")


def questions_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, entries = _questions(spark, sf_dir), _entries(spark, sf_dir)
    scored = subjects.coverage(questions, entries, "item_id", "asked", "doc_id", "title", "text").withColumn("score", 2 * F.col("title_hits") + F.col("hits"))
    best = subjects.candidates(scored, "item_id", "doc_id").join(entries.select("doc_id", "title"), "doc_id")
    return subjects.most_covered(best, questions, "item_id", "asked", "doc_id", "title")


def questions_on_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.on_subject(_questions(spark, sf_dir), _entries(spark, sf_dir), "item_id", "asked", "doc_id", "title", "text")


QUERIES = {f.__name__: f for f in (questions_covered, questions_on_subject)}
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')"
_FIRST = r"regexp_extract(text, '^[^.!?\n]*')"
_STOPPED = ", ".join(f"'{w}'" for w in sorted(STOP))
_HAS = "(length({w}) >= 3 and contains(lower({t}), substr({w}, 1, greatest(4, length({w}) - 2))))"
_BASE = f"""
    q as (select item_id, list_filter({_WORDS.format(_FIRST)}, lambda w: w not in ({_STOPPED})) as every from benchmark),
    k as (select item_id, list_filter(every, lambda w, i: list_position(every, w) = i) as asked from q),
    e as (select doc_id, {_FIRST} as title, {_WORDS.format(_FIRST)} as t, {_WORDS.format("text")} as b from documents),
    h as (select doc_id, w, max(i) as t, count(*) as n from (select doc_id, unnest(t) as w, 1 as i from e union all select doc_id, unnest(b), 0 from e) group by all),
    c as (select item_id, doc_id, sum(h.t) as title_hits, count(*) as hits, sum(n)::bigint as occurrences from (select item_id, unnest(asked) as w from k) join h using (w) group by all),
    s as (select c.*, k.asked, title, (2 * title_hits + hits)::bigint as score from c join k using (item_id) join e using (doc_id))"""


def _covered(source: str) -> str:
    return f"""
    r as (select item_id, any_value(asked) as asked, list({{'score': score, 'key': doc_id, 'title': title}} order by score desc, doc_id) as all_rows from {source} group by item_id),
    r12 as (select item_id, asked, all_rows[:12] as l from r),
    a as (select item_id, l, list_reduce(list_prepend({{'w': '', 'taken': list_filter(l, lambda x: x.score >= l[1].score * 0.8)[:4]}}, list_transform(asked, lambda w: {{'w': w, 'taken': l[:0]}})),
        lambda acc, x: {{'w': '', 'taken': case when len(acc.taken) >= 4 or length(x.w) < 4 or len(list_filter(acc.taken, lambda y: {_HAS.format(w='x.w', t='y.title')})) > 0 then acc.taken
          else acc.taken || list_filter(l, lambda y: y.score >= greatest(3, l[1].score * 0.5) and len(list_filter(acc.taken, lambda z: z.key = y.key)) = 0 and {_HAS.format(w='x.w', t='y.title')})[:1] end}}) as got
      from r12 where l[1].score >= 3),
    covered as (select item_id, unnest(got.taken).key as doc_id, unnest(got.taken).score as score, unnest(range(1, len(got.taken) + 1))::int as place from a)"""


ORACLES = {
    "questions_covered": f"with {_BASE}, {_covered('s')} select * from covered",
    "questions_on_subject": f"""
        with {_BASE},
        x as (select item_id, doc_id, occurrences as score, asked, title from s where hits = len(asked) qualify occurrences >= 0.3 * max(occurrences) over (partition by item_id)),
        y as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as place from x qualify row_number() over (partition by item_id order by score desc, doc_id) <= 4),
        titled as (select item_id from y group by item_id having bool_or(len(asked) < 2 or len(list_filter(asked, lambda w: {_HAS.format(w='w', t='title')})) > 0)),
        m as (select * from s where len(asked) >= 2 and item_id not in (select item_id from titled)),
        {_covered('m')}
        select item_id, doc_id, score, place, 'most words' as way from covered
        union all select item_id, doc_id, score, place, 'all words' from y where item_id not in (select item_id from covered)
    """,
}
