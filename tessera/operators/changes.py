"""Updates and deletions as new tables: guarded updates, cuts, merged accounts, tokens, guarded answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.spans import strike_places
from tessera.functions.text import single_blanks


def update_where(df: DataFrame, guard: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that meet the guard get the values (of the old row); where the guard is null nothing changes."""
    return df.withColumns({c: F.when(guard, v).otherwise(F.col(c)) for c, v in values.items()})


def cut_from(df: DataFrame, anchors: DataFrame, key: str, order: str) -> DataFrame:
    """Rows before the first anchor (key, order) of their key; keys without one keep all."""
    first = anchors.filter(F.col(order).isNotNull()).groupBy(key).agg(F.min(order).alias("_from"))
    return df.join(first, key, "left").filter(F.col("_from").isNull() | (F.col(order) < F.col("_from"))).select(*df.columns)


def without_owned(df: DataFrame, column: str, owners: DataFrame, mark: str = ":") -> DataFrame:
    """Rows whose key ``owner:rest`` belongs to none of the owners (one column, owner)."""
    own = owners.select(F.col("owner").cast("string").alias("_o")).distinct()
    return df.withColumn("_o", F.split_part(F.col(column), F.lit(mark), F.lit(1))).join(own, "_o", "left_anti").select(*df.columns)


def repoint(df: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """``column`` with old keys replaced by new ones, by moves (old, new); of several moves of a key the smallest new one counts."""
    to = moves.groupBy("old").agg(F.min("new").alias("_new")).withColumnRenamed("old", "_old")
    moved = df.join(to, F.col(column) == F.col("_old"), "left")
    return moved.withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def merge_accounts(accounts: DataFrame, moves: DataFrame, key: str, sums: list[str], fill: list[str]) -> DataFrame:
    """One row per account that stays: sums over it and those moved into it, and its own profile values, or else those of the smallest moved key that has one."""
    placed = repoint(accounts.withColumn("_to", F.col(key)), "_to", moves)
    rank = F.struct((F.col(key) != F.col("_to")).alias("moved"), F.col(key).alias("key"))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fill]
    return placed.groupBy(F.col("_to").alias("_key")).agg(*(F.sum(c).alias(c) for c in sums), *first).withColumnRenamed("_key", key)


def live_tokens(tokens: DataFrame, uses: DataFrame, as_of: str, most_attempts: int = 5) -> DataFrame:
    """The newest token of each user (token_id, user_id, issued_at, expires_at) unless it has expired, was used, or failed too often.

    ``uses`` has token_id and ok; a newer token makes the older ones of its user void.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("issued_at"), F.desc("token_id"))
    last = tokens.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")
    tried = uses.groupBy("token_id").agg(F.count_if(~F.col("ok")).alias("_failed"), F.coalesce(F.bool_or("ok"), F.lit(False)).alias("_used"))
    fine = (F.coalesce("_failed", F.lit(0)) < most_attempts) & ~F.coalesce("_used", F.lit(False)) & (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz"))
    return last.join(tried, "token_id", "left").filter(fine).select(*tokens.columns)


def guarded(answers: DataFrame, known: DataFrame, key: str, text: str, places: Callable[[Column], Column]) -> DataFrame:
    """Rows (key, text, removed): references of a text that ``known`` (column ref) lacks are struck out where they stand, and listed.

    ``places`` gives the references of a text as an array of (start, stop, ref);
    only these travel, and the texts once, to where their missing references
    are.  References are compared with white space made single.  Keys have to be unique.
    """
    refs = answers.select(key, F.explode(places(F.col(text))).alias("_p")).withColumn("ref", single_blanks(F.col("_p")["ref"]))
    missing = refs.join(known.select("ref").distinct(), "ref", "left_anti")
    lists = missing.groupBy(key).agg(F.array_sort(F.collect_set("ref")).alias("removed"), F.collect_list("_p").alias("_struck"))  # the references of one text
    both = answers.select(key, text).join(lists, key, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<string>")))
    return both.withColumn(text, F.when(F.col("_struck").isNull(), F.col(text)).otherwise(strike_places(F.col(text), F.col("_struck")))).drop("_struck")


def paid_uncredited(orders: DataFrame, entries: DataFrame) -> DataFrame:
    """Orders (order_id, status) that are PAID but have no entry with the reference ``order:<id>``."""
    credited = entries.select(F.col("reference").alias("_r")).filter("_r like 'order:%'").distinct()
    return orders.filter("status = 'PAID'").join(credited, F.concat(F.lit("order:"), F.col("order_id")) == F.col("_r"), "left_anti")


def lifecycle(events: DataFrame, stages: list[str], key: str, stage: str, time: str) -> DataFrame:
    """The furthest stage of each key, in the order of ``stages``, and when it was first reached; other stages don't count."""
    rank = F.array_position(F.array(*map(F.lit, stages)), F.col(stage)).cast("int")
    rows = events.withColumn("_rank", rank).filter("_rank > 0").groupBy(key, "_rank", stage).agg(F.min(time).alias("reached"))
    return rows.groupBy(key).agg(F.max(F.struct("_rank", stage, "reached")).alias("_m")).select(key, f"_m.{stage}", "_m.reached")
