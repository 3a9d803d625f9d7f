"""Questions on a subject: the entries that cover most of their words, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.session import DEALT, dealt

CANDIDATES = 12  # entries of a question that are looked at: the best by score
MOST = 4


def title_has(title: Column, word: Column) -> Column:
    """Whether a title has a word of three letters or more, but for its last two letters if four remain."""
    return (F.length(word) >= 3) & F.contains(F.lower(title), F.substring(word, F.lit(1), F.greatest(F.lit(4), F.length(word) - 2)))


def coverage(questions: DataFrame, entries: DataFrame, question: str, asked: str, key: str, title: str, body: str) -> DataFrame:
    """Rows (question, key, title_hits, hits, occurrences, asked): what each entry has of each question's words.

    ``questions`` has the question's id and ``asked``, an array of words.  hits
    are the words in title or body, title_hits those in the title, occurrences
    how often the words stand in either.  Words meet by equality; pairs without
    a common word don't arise.  Entries are dealt by key once, into partitions
    that hold the fewer the more questions there are; their words are cut to those
    that are asked for, counted and met with the questions where they lie.
    """
    each = max(1, DEALT * 100 // max(100, questions.count()))
    entries = dealt(entries.select(*dict.fromkeys([key, title, body])), key, each=each)
    wanted = questions.select(question, F.explode(F.array_distinct(asked)).alias("_w"))
    counts = questions.select(question, F.size(F.array_distinct(asked)).alias("asked"))
    in_title = words(F.coalesce(F.col(title), F.lit("")))
    in_body = words(F.coalesce(F.col(body), F.lit("")))
    marked = F.concat(F.transform(in_title, lambda w: F.struct(w.alias("_w"), F.lit(1).alias("_t"))), F.transform(in_body, lambda w: F.struct(w.alias("_w"), F.lit(0).alias("_t"))))
    held = entries.select(key, F.inline(marked)).join(wanted.select("_w").distinct(), "_w", "left_semi")
    held = held.groupBy(key, "_w").agg(F.max("_t").alias("_t"), F.count("*").alias("_n"))
    met = held.join(wanted, "_w").groupBy(question, key)
    return met.agg(F.sum("_t").alias("title_hits"), F.count("*").alias("hits"), F.sum("_n").alias("occurrences")).join(counts, question)


def candidates(scored: DataFrame, question: str, key: str) -> DataFrame:
    """The CANDIDATES best entries of each question; equal scores go by key."""
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc("score"), F.asc(key)))
    return scored.withColumn("_rn", place).filter(F.col("_rn") <= CANDIDATES).drop("_rn")


def most_covered(scored: DataFrame, questions: DataFrame, question: str, asked: str, key: str, title: str) -> DataFrame:
    """Rows (question, key, score, place) of the entries that cover a question best, MOST at most.

    ``scored`` has the question, the key, a title and a score.  Of the
    CANDIDATES best entries those within 80 % of the best are taken.  Then, word
    by word in the order of ``asked``, a word of four letters that no taken
    title has adds the best entry whose title has it and whose score is half the
    best and 3 at least.  A question whose best score is below 3 has none.
    Equal scores go by key.  Null titles have no words.
    """
    best = F.struct((-F.col("score")).alias("minus"), F.col(key).alias("key"), F.coalesce(F.col(title), F.lit("")).alias("title"))
    rows = candidates(scored, question, key).groupBy(question).agg(F.array_sort(F.collect_list(best)).alias("_rows")).join(questions.select(question, F.col(asked).alias("_asked")), question)

    def fill(taken: Column, word: Column) -> Column:
        top = -F.get("_rows", F.lit(0))["minus"]
        fits = lambda r: (-r["minus"] >= F.greatest(F.lit(3), top * 0.5)) & ~F.exists(taken, lambda t: t["key"] == r["key"]) & title_has(r["title"], word)
        needless = (F.size(taken) >= MOST) | (F.length(word) < 4) | F.exists(taken, lambda t: title_has(t["title"], word))
        return F.when(needless, taken).otherwise(F.concat(taken, F.slice(F.filter("_rows", fits), 1, 1)))

    near = F.slice(F.filter("_rows", lambda r: -r["minus"] >= -F.get("_rows", F.lit(0))["minus"] * 0.8), 1, MOST)
    chosen = rows.filter(F.get("_rows", F.lit(0))["minus"] <= -3).select(question, F.posexplode(F.aggregate("_asked", near, fill)).alias("place", "_r"))
    return chosen.select(question, F.col("_r.key").alias(key), (-F.col("_r.minus")).alias("score"), (F.col("place") + 1).alias("place"))


def on_subject(questions: DataFrame, entries: DataFrame, question: str, asked: str, key: str, title: str, body: str) -> DataFrame:
    """Rows (question, key, score, place, way) of the entries that each question is about, MOST at most.

    way ``all words``: the entries that have every word, by occurrences, within
    30 % of the best.  If none of their titles has one of the words, and there
    are two or more words, way ``most words`` is taken where it finds anything:
    :func:`most_covered` by twice the words in the title plus the words anywhere.
    Questions without words have no rows, and ids of both sides have to be unique.
    """
    found, titles = coverage(questions, entries, question, asked, key, title, body), entries.select(key, title)
    own = Window.partitionBy(question)
    every = found.filter("hits = asked").withColumn("score", F.col("occurrences")).withColumn("_best", F.max("score").over(own)).filter("score >= 0.3 * _best")
    every = every.withColumn("place", F.row_number().over(own.orderBy(F.desc("score"), F.asc(key)))).filter(F.col("place") <= MOST).join(titles, key)
    told = every.join(questions.select(question, F.col(asked).alias("_asked")), question)
    titled = told.groupBy(question).agg(F.bool_or((F.col("asked") < 2) | F.exists("_asked", lambda w: title_has(F.coalesce(F.col(title), F.lit("")), w))).alias("_titled"))
    scored = found.withColumn("score", 2 * F.col("title_hits") + F.col("hits"))
    several = scored.filter("asked >= 2").join(titled.filter("_titled"), question, "left_anti")
    covered = most_covered(candidates(several, question, key).join(titles, key), questions, question, asked, key, title).withColumn("way", F.lit("most words"))
    exact = every.join(covered.select(question).distinct(), question, "left_anti").select(question, key, "score", "place", F.lit("all words").alias("way"))
    return exact.unionByName(covered)
