"""Sections, judgments and grounded references; entries that follow an unverified answer; delayed and revived jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import base_section


def natural_order(section: Column) -> list[Column]:
    """Sort keys of a section: its leading number, then its text; sections without a number come last."""
    number = F.nullif(F.regexp_extract(section, r"^\d+", 0), F.lit("")).cast("long")
    return [number.asc_nulls_last(), section.asc()]


def numbered_sections(sections: DataFrame, act: str, section: str) -> DataFrame:
    """Adds ``position``, counting from 1 within each act in natural order."""
    return sections.withColumn("position", F.row_number().over(Window.partitionBy(act).orderBy(*natural_order(F.col(section)))))


def having_any(df: DataFrame, tags: str, wanted: list[str]) -> DataFrame:
    """The rows whose array shares an element with the wanted ones."""
    return df.filter(F.arrays_overlap(F.col(tags), F.array(*map(F.lit, wanted))))


def leading(judgments: DataFrame, subject: str, cited: str, year: str, wanted_year: int, key: str) -> DataFrame:
    """The judgment of each subject that is cited most, then nearest to the wanted year, then with the smallest key."""
    best = F.min_by(F.struct(*(c for c in judgments.columns if c != subject)), F.struct(-F.col(cited), F.abs(F.col(year) - wanted_year), F.col(key)))
    return judgments.groupBy(subject).agg(best.alias("one")).select(subject, "one.*")


def recodified_from(mapping: DataFrame, siblings: bool = True) -> DataFrame:
    """One row (old_act, base, new_act, new_section) each, preferring rows of the whole old section; with ``siblings`` those of 12A for 12 too."""
    base = F.regexp_extract("old_section", r"^\d+" if siblings else r"^\d+[A-Z]*", 0)
    whole = (~F.contains(F.col("old_section"), F.lit("("))).alias("whole")
    rows = mapping.select("old_act", base.alias("base"), "new_act", "new_section", "old_section", whole).filter("base <> ''")
    first = F.min_by(F.struct("old_section", "whole"), F.struct(~F.col("whole"), F.col("old_section"))).alias("one")
    return rows.groupBy("old_act", "base", "new_act", "new_section").agg(first).select("old_act", "base", "new_act", "new_section", "one.*")


def laws_with_section(sections: DataFrame, listed: list[str]) -> DataFrame:
    """Rows (section, acts): the acts outside ``listed`` that have a section of this number, in order."""
    return sections.filter(~F.col("act").isin(listed)).groupBy("section").agg(F.array_sort(F.collect_set("act")).alias("acts"))


def grounded_refs(*sources: DataFrame) -> DataFrame:
    """The distinct (act, section) of all sources, sections without their sub-clauses."""
    refs = [s.select("act", base_section(F.col("section")).alias("section")) for s in sources]
    out = refs[0]
    for other in refs[1:]:
        out = out.unionByName(other)
    return out.distinct()


def enqueue(new: DataFrame, jobs: DataFrame, key: str, time: str, order: list[str], delay: str) -> DataFrame:
    """The first of the new rows of each key that has no job QUEUED or ACTIVE, with ``run_at`` after the delay; rows without a key all enter."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keyed = new.filter(F.col(key).isNotNull()).withColumn("_n", first).filter("_n = 1").drop("_n")
    live = jobs.filter("state in ('QUEUED', 'ACTIVE')").select(key).distinct()
    entered = keyed.join(live, key, "left_anti").unionByName(new.filter(F.col(key).isNull()))
    return entered.withColumns({"state": F.lit("QUEUED"), "attempts": F.lit(0), "run_at": F.col(time) + F.expr(f"interval {delay}")})


def renew(jobs: DataFrame, worker: str, as_of: str, lease: str) -> DataFrame:
    """Jobs that a worker still holds get a lease from now; one whose lease has run out stays as it is."""
    now = F.lit(as_of).cast("timestamp_ntz")
    mine = (F.col("state") == "ACTIVE") & (F.col("worker") == worker) & (F.col("lease_until") >= now)
    return jobs.withColumn("lease_until", F.when(mine, now + F.expr(f"interval {lease}")).otherwise(F.col("lease_until")))


def requeue_dead(jobs: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The jobs, of which the chosen DEAD ones are QUEUED again without attempts or lease."""
    marked = jobs.join(chosen.select(key).distinct().withColumn("_chosen", F.lit(True)), key, "left")
    again = F.coalesce("_chosen", F.lit(False)) & (F.col("state") == "DEAD")
    changed = {"state": F.when(again, "QUEUED").otherwise(F.col("state")), "attempts": F.when(again, 0).otherwise(F.col("attempts")), "lease_until": F.when(~again, F.col("lease_until"))}
    return marked.withColumns(changed).select(*jobs.columns)


def unverified_charges(spends: DataFrame, reference: str) -> DataFrame:
    """For each SPEND of an unverified answer its REFUND and a SPEND of 1 under a reference of its own."""
    back = spends.withColumns({"kind": F.lit("REFUND"), "delta": -F.col("delta"), reference: F.concat(F.lit("refund:"), reference)})
    one = spends.withColumns({"delta": F.lit(-1).cast("long"), reference: F.concat(F.lit("unverified:"), reference)})
    return back.unionByName(one)
