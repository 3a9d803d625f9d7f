"""Places in texts: where patterns match, which of them stand alone, and what can be done by place, as column expressions.

A place is a struct whose fields ``start`` and ``stop`` count characters from 0;
arrays of places are in order of start, the longer one first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64  # matches whose places are summed up at once


def _running(values: Column, add: Callable[[Column, Column], Column], kind: str) -> Column:
    """Struct (at, out): the sum of what ``add(sum before, value)`` returns as ``stop``, and all of its results."""
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def further(acc: Column, x: Column) -> Column:
        made = add(acc["at"], x)
        return F.struct(made["stop"].alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    return F.aggregate(values, nothing, further)


def _matches(c: Column, pattern: str) -> Column:
    """Places of one pattern.

    A text is its matches and the gaps between them, so a place is the length
    of all that stands before it: a running sum over CHUNK matches at a time,
    and one over the chunks.
    """
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.transform(F.split(c, pattern), lambda g: F.length(g)), lambda ref, gap: F.struct(ref.alias("ref"), gap.alias("gap")))
    pairs = F.filter(pairs, lambda x: x["ref"].isNotNull())  # there is one gap more

    def place(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), (start + F.length(x["ref"])).alias("stop"), x["ref"].alias("ref"))

    def moved(local: Column) -> Column:
        before = _running(local, lambda at, x: F.struct(at.alias("start"), (at + x["at"]).alias("stop")), "struct<start: int, stop: int>")["out"]
        by = lambda x, at: F.struct((x["start"] + at).alias("start"), (x["stop"] + at).alias("stop"), x["ref"].alias("ref"))
        return F.flatten(F.zip_with(local, before, lambda part, b: F.transform(part["out"], lambda x: by(x, b["start"]))))

    def summed(pairs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(pairs), F.lit(CHUNK)), lambda k: k < F.size(pairs))
        return F.transform(starts, lambda k: _running(F.slice(pairs, k + 1, F.lit(CHUNK)), place, "struct<start: int, stop: int, ref: string>"))

    return bound(bound(pairs, summed), moved)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_order(found: Column) -> Column:
    """Places by start, the longer one first."""
    by = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"])
    return F.array_sort(found, by)


def places(c: Column, *patterns: str) -> Column:
    """Places (start, stop, ref) of all matches of the patterns, which mustn't match an empty string; null for a null text.

    The patterns' matches may overlap.
    """
    return in_order(F.flatten(F.array(*(_matches(c, p) for p in patterns))))


def maximal(found: Column) -> Column:
    """Places that lie in no other one: a sweep that keeps what reaches further than all before it.  Of equal places one stays."""

    def further(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["far"], x["stop"]).alias("far"), F.when(x["stop"] > acc["far"], F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    def swept(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("far"), F.filter(found, lambda x: F.lit(False)).alias("out"))
        return F.aggregate(found, start, further, lambda acc: acc["out"])

    return bound(found, swept)


def with_brackets(text: Column, place: Column) -> Column:
    """Struct (start, stop) of a place together with the round brackets around it, if it stands in a pair alone."""
    left = F.length(F.regexp_extract(F.substring(text, F.lit(1), place["start"]), r"\(\s*$", 0))
    right = F.length(F.regexp_extract(F.substring(text, place["stop"] + 1, F.length(text)), r"^\s*\)", 0))
    both = (left > 0) & (right > 0)
    return F.struct((place["start"] - F.when(both, left).otherwise(0)).alias("start"), (place["stop"] + F.when(both, right).otherwise(0)).alias("stop"))


def strike_places(text: Column, found: Column, mark: str = "[unverified]") -> Column:
    """``text`` with each place replaced by ``mark``; of places that overlap the first is, up to its end, and the rest of the others goes too."""
    nothing = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def further(acc: Column, x: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(in_order(found), nothing, further, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def releasable_end(written: Column, found: Column, lookahead: int = 24) -> Column:
    """How many characters of a text still being written may be shown.

    The last end of a line that has ``lookahead`` characters after it and over
    which no place runs on; 0 if there is none.
    """
    ends = F.transform(_matches(written, "\n"), lambda x: x["stop"])

    def last(found: Column) -> Column:
        return F.array_max(F.filter(ends, lambda e: (e <= F.length(written) - lookahead) & ~F.exists(found, lambda x: (x["start"] < e) & (x["stop"] >= e))))

    return F.when(written.isNotNull(), F.coalesce(bound(found, last), F.lit(0)))
