"""Dictionary lookup by several strategies, coverage ranking, verification of references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import base_section, citation_key, terms, trigram_similarity
from tessera.operators.retrieval import first_of_each


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def best_of_strategies(branches: list[DataFrame], key: str, most: int) -> DataFrame:
    """Union of branches with ``strategy`` and ``score``: the best row of each key, then the ``most`` best keys."""
    best = first_of_each(union_all(branches), [key], [F.desc("score"), F.asc("strategy")])
    return best.orderBy(F.desc("score"), key).limit(most)


def lookup(entries: DataFrame, text: str, section: str, act: str | None, mapping: DataFrame, limit: int = 5) -> DataFrame:
    """Entries (id, act, section, title) that a question about a section may mean.

    EXACT 1000: the whole number; EXACT 990: its base before "("; RECODIFIED
    950/900: the other end of a mapping row (old_act, old_section, new_act,
    new_section), from old to new and from new to old; FULLTEXT: all words in
    the title, 10 points each; FUZZY: trigram similarity of the title over 0.3.
    Columns: id, act, section, title, strategy, score.
    """
    same_act = F.lit(True) if act is None else F.col("act") == act
    base = section.split("(", 1)[0]
    words = [w for w in text.lower().split() if w]

    def branch(df: DataFrame, strategy: str, score: Column) -> DataFrame:
        return df.select("id", "act", "section", "title", F.lit(strategy).alias("strategy"), score.cast("double").alias("score"))

    exact = entries.filter(same_act & (F.upper("section") == section.upper()))
    based = entries.filter(same_act & (base_section(F.upper("section")) == base.upper()))
    from_old = mapping.filter((F.col("old_section") == section) & (F.lit(act is None) | (F.col("old_act") == (act or "")))).select(F.col("new_act").alias("act"), F.col("new_section").alias("section")).distinct()
    from_new = mapping.filter((F.col("new_section") == section) & (F.lit(act is None) | (F.col("new_act") == (act or "")))).select(F.col("old_act").alias("act"), F.col("old_section").alias("section")).distinct()
    titled = entries.withColumn("_t", terms(F.col("title")))
    every = F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains("_t", w)) if words else F.lit(False)
    near = entries.withColumn("_s", trigram_similarity(F.col("title"), F.lit(text)))
    return best_of_strategies(
        [
            branch(exact, "EXACT", F.lit(1000)),
            branch(based, "EXACT", F.lit(990)),
            branch(entries.join(from_old, ["act", "section"], "left_semi"), "RECODIFIED", F.lit(950)),
            branch(entries.join(from_new, ["act", "section"], "left_semi"), "RECODIFIED", F.lit(900)),
            branch(titled.filter(every), "FULLTEXT", F.lit(10 * len(words))),
            branch(near.filter("_s > 0.3"), "FUZZY", F.col("_s")),
        ],
        "id",
        limit,
    )


def covering(entries: DataFrame, words: list[str], title: str, body: str, key: str, limit: int = 12) -> DataFrame:
    """Rows that hold some of the words, by 2 * words in the title + words in title or body; columns key, title_hits, hits, score."""
    t, b = terms(F.col(title)), terms(F.col(body))
    title_hits = sum(F.array_contains(t, w).cast("int") for w in words)
    hits = sum((F.array_contains(t, w) | F.array_contains(b, w)).cast("int") for w in words)
    scored = entries.select(key, title_hits.alias("title_hits"), hits.alias("hits")).filter("hits > 0")
    return scored.withColumn("score", F.col("title_hits") * 2 + F.col("hits")).orderBy(F.desc("score"), key).limit(limit)


def verify_citations(citations: DataFrame, corpus: DataFrame, citation: str, known: str, key: str) -> DataFrame:
    """One row per input row: the citation, found, and the smallest key of a corpus row with the same citation key.

    The corpus is cut down to the keys asked for before it is grouped; Spark
    broadcasts these where its size limit allows.
    """
    asked = citations.withColumn("_k", citation_key(F.col(citation)))
    wanted = asked.select("_k").filter("_k <> ''").distinct()
    index = corpus.select(citation_key(F.col(known)).alias("_k"), key).join(wanted, "_k", "left_semi").groupBy("_k").agg(F.min(key).alias("match"))
    return asked.join(index, "_k", "left").select(*citations.columns, F.col("match").isNotNull().alias("found"), "match")


def verify_references(refs: DataFrame, own: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each reference (act, section) with where it is found: 1 its own row, 2 its base section, 3 a mapping; null if nowhere.

    ``own`` has act, section; ``mapping`` has old_act, old_section, new_act, new_section.
    """
    asked = refs.select("act", "section", base_section(F.col("section")).alias("base")).distinct()
    sides = mapping.select(F.col("old_act").alias("act"), F.col("old_section").alias("section")).unionByName(mapping.select(F.col("new_act").alias("act"), F.col("new_section").alias("section")))
    keyed = union_all(
        [
            own.select("act", "section", F.lit(1).alias("preference")),
            asked.join(own.select("act", F.col("section").alias("base")).distinct(), ["act", "base"], "left_semi").select("act", "section", F.lit(2).alias("preference")),
            sides.select("act", "section", F.lit(3).alias("preference")),
        ]
    )
    best = keyed.groupBy("act", "section").agg(F.min("preference").alias("preference"))
    return asked.join(best, ["act", "section"], "left").select("act", "section", "preference", F.col("preference").isNotNull().alias("found"))


def pairs_touching(rows: DataFrame, pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Pairs one of whose ends is a key of ``rows``: two equi-joins instead of a join on either end."""
    one = pairs.join(rows.select(F.col(key).alias(left)).distinct(), left, "left_semi")
    other = pairs.join(rows.select(F.col(key).alias(right)).distinct(), right, "left_semi")
    return one.unionByName(other).distinct()


def within_band(left: DataFrame, right: DataFrame, year: str, other: str, band: int = 1) -> DataFrame:
    """Rows of both sides whose years differ by at most ``band``, as an equi-join on the years of the band."""
    spread = right.withColumn("_y", F.explode(F.sequence(F.col(other) - band, F.col(other) + band)))
    return left.join(spread, F.col(year) == F.col("_y")).drop("_y")


def unique_match(df: DataFrame, by: str, value: str) -> DataFrame:
    """For each ``by`` its value if there is only one, else null."""
    return df.groupBy(by).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))


def latest_earlier(df: DataFrame, keys: list[str], time: str, condition: Column, value: Column, name: str) -> DataFrame:
    """Adds, to each row, ``value`` of the last row up to it (by time) that meets ``condition``."""
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(F.when(condition, value), ignorenulls=True).over(w))
