"""Full-text search: required, alternative and excluded terms, expansion by synonyms, hashed vectors."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import terms, words
from tessera.session import dealt

# Words that carry no topic.
STOP = frozenset("a an and are as at be by can do does for from has how i in is it me my of on or section that the this to under was what when which who will with".split())


@dataclass(frozen=True)
class Query:
    """Of each group one term has to occur, and none of ``never``; a term with blanks is a phrase."""

    groups: tuple[tuple[str, ...], ...]
    never: tuple[str, ...] = ()


def web_query(text: str) -> Query:
    """``a b`` wants both, ``a or b`` either, ``-a`` none, and quoted words stand together."""
    groups: list[tuple[str, ...]] = []
    never, either = [], False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
        if word == "or" and not minus:
            either = bool(groups)
            continue
        term = " ".join(re.findall(r"[^\s.,;:!?]+", phrase or word))
        if not re.search(r"\w", term):
            continue
        if minus:
            never.append(term)
        elif either:
            groups[-1] += (term,)
        else:
            groups.append((term,))
        either = False
    return Query(tuple(groups), tuple(never))


def matches(tokens: Column, query: Query) -> Column:
    """Whether an array of terms meets the query; a query without terms is met by none."""
    if not query.groups and not query.never:
        return F.lit(False)
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    has = lambda t: F.contains(joined, F.lit(f" {t} ")) if " " in t else F.array_contains(tokens, t)
    every = [reduce(or_, map(has, g)) for g in query.groups] + [~has(t) for t in query.never]
    return reduce(and_, every, F.lit(True))


def expanded(query: list[str], groups: list[list[str]], most: int = 6) -> list[str]:
    """The query and at most ``most`` further words of the synonym groups that hold one of its words."""
    more = [w for g in groups if set(g) & set(query) for w in g if w not in query]
    return [*query, *dict.fromkeys(more)][: len(query) + most]


def topic(c: Column) -> Column:
    """Words of a question without stop words and numbers."""
    return F.filter(words(c), lambda w: ~w.isin(*sorted(STOP)) & ~w.rlike("^[0-9]+$"))


def covered_share(wanted: Column, c: Column) -> Column:
    """Share of the wanted words that a text has; 0 if none is wanted."""
    return F.coalesce(F.size(F.array_intersect(wanted, words(c))) / F.nullif(F.size(F.array_distinct(wanted)), F.lit(0)), F.lit(0.0))


def hashed_vectors(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """Rows (key, bucket, value) of unit vectors: each term adds its number, with a sign, to two buckets of its SHA-256.

    Texts are dealt by key once; terms, buckets and lengths are of one key and
    stay where it is.  Terms are counted per text before their digests are
    taken, and buckets that come to 0 have no row.
    """
    counted = dealt(df.select(key, text), key).select(key, F.explode(terms(F.col(text))).alias("_w")).groupBy(key, "_w").agg(F.count("*").alias("_n"))
    digest = F.sha2("_w", 256)
    number = lambda at: F.conv(F.substring(digest, at, 7), 16, 10).cast("long")
    entry = lambda at: F.struct((number(at) % dims).alias("bucket"), F.when(number(at + 7) % 2 == 0, F.col("_n")).otherwise(-F.col("_n")).alias("_v"))
    rows = counted.select(key, F.inline(F.array(entry(1), entry(15))))
    summed = rows.groupBy(key, "bucket").agg(F.sum("_v").alias("_v")).filter("_v <> 0")
    length = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(key)))  # at most dims rows a key
    return summed.select(key, "bucket", (F.col("_v") / length).alias("value"))


def intent(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (name, pattern) that a text meets, else the default."""
    low = F.lower(c)
    return F.coalesce(*(F.when(low.rlike(pattern), name) for name, pattern in rules), F.lit(default))


def number_ranges(c: Column) -> Column:
    """Section numbers of a list such as ``230 to 232, 171-I and 376(1)``: ranges of whole numbers are written out."""
    items = F.filter(F.split(c, r"\s*(?:,|;|\band\b)\s*"), lambda x: F.trim(x) != "")

    def spread(x: Column) -> Column:
        low, high = (F.regexp_extract(x, r"^\s*(\d+)\s*(?:to|-)\s*(\d+)\s*$", g) for g in (1, 2))
        span = F.transform(F.sequence(F.nullif(low, F.lit("")).cast("int"), F.greatest(F.nullif(low, F.lit("")).cast("int"), F.nullif(high, F.lit("")).cast("int"))), lambda i: i.cast("string"))
        return F.when(low != "", span).otherwise(F.array(F.trim(x)))

    return F.array_distinct(F.flatten(F.transform(items, spread)))
