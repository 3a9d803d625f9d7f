"""Append-only credit ledger: folds, idempotent entries, refunds by reversal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FREE_GRANT = 20


def totals(entries: DataFrame, by: list[str]) -> DataFrame:
    """Sums of entries (kind, delta) by ``by``: granted, spent, refunded, net."""
    kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("delta"))), F.lit(0))
    return entries.groupBy(*by).agg(kind("GRANT").alias("granted"), (-kind("SPEND")).alias("spent"), kind("REFUND").alias("refunded"), F.sum("delta").alias("net"))


def running_balance(entries: DataFrame, user: str, order: list[str]) -> DataFrame:
    """Adds ``balance_after``."""
    w = Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("balance_after", F.sum("delta").over(w))


def idempotent(entries: DataFrame, reference: str, order: list[str]) -> DataFrame:
    """The first entry of each reference; entries without one all stay, and don't meet in one task."""
    first = F.row_number().over(Window.partitionBy(reference).orderBy(*order))
    known = entries.filter(F.col(reference).isNotNull()).withColumn("_rn", first).filter("_rn = 1").drop("_rn")
    return known.unionByName(entries.filter(F.col(reference).isNull()))


def refunds(spends: DataFrame, requests: DataFrame, reference: str = "reference") -> DataFrame:
    """One REFUND entry for each bucket of each requested SPEND, with its delta reversed and ``spend:`` in the reference made ``refund:``."""
    asked = requests.select(reference).distinct()
    found = spends.filter("kind = 'SPEND'").join(asked, reference, "left_semi")
    return found.withColumns({"kind": F.lit("REFUND"), "delta": -F.col("delta"), reference: F.regexp_replace(reference, "^spend:", "refund:")})


def unrefunded(entries: DataFrame, reference: str = "reference") -> DataFrame:
    """SPEND entries without their refund."""
    back = entries.filter("kind = 'REFUND'").select(F.regexp_replace(reference, "^refund:", "spend:").alias(reference), "bucket")
    return entries.filter("kind = 'SPEND'").join(back, [reference, "bucket"], "left_anti")


def spend_fold(actions: DataFrame) -> DataFrame:
    """Balances over actions (user_id, seq, op, amount): after each action free, paid and whether it went through.

    Users start with FREE_GRANT free credits.  ``grant`` adds paid credits
    (amounts of 0 or less do nothing); ``spend`` takes free ones first and is
    refused if both together don't suffice; ``deduct`` takes paid ones first and
    stops at zero.  What a spend takes depends on every action before it, so a
    user's actions, sorted by seq, are folded one by one.
    """
    schema = "user_id long, seq long, op string, free long, paid long, done boolean"

    def fold(batches):
        user, free, paid = object(), 0, 0
        for pdf in batches:
            out = []
            for u, seq, op, amount in zip(pdf["user_id"], pdf["seq"], pdf["op"], pdf["amount"], strict=True):
                if u != user:
                    user, free, paid = u, FREE_GRANT, 0
                done = amount > 0
                if op == "grant":
                    paid += max(amount, 0)
                elif op == "spend":
                    done = done and free + paid >= amount
                    if done:
                        took = min(free, amount)
                        free, paid = free - took, paid - (amount - took)
                elif op == "deduct":
                    took = min(paid, max(amount, 0))
                    free, paid = max(free - (max(amount, 0) - took), 0), paid - took
                else:
                    done = False
                out.append((u, seq, op, free, paid, bool(done)))
            yield pd.DataFrame(out, columns=["user_id", "seq", "op", "free", "paid", "done"])

    rows = actions.select(F.col("user_id").cast("long"), F.col("seq").cast("long"), "op", F.col("amount").cast("long"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "seq").mapInPandas(fold, schema)


_ENTRY = "struct<kind: string, bucket: string, delta: bigint, balance_after: bigint, reference: string>"


def charges(actions: DataFrame, balances: DataFrame, spent: DataFrame, monthly: int) -> DataFrame:
    """What each action (user_id, seq, cost, reference) is charged, with the entries it makes.

    Columns: user_id, seq, reference, allowed, charged, free_left, paid_left,
    from_free, from_paid, already_spent, entries.  ``balances`` has user_id,
    free, paid, granted; a user without a row, or never granted, first gets
    ``monthly`` free credits, with a GRANT entry.  A reference that ``spent``
    (column reference) has with ``:free`` or ``:paid``, or that an earlier action
    of the user was charged for, costs nothing again.  A spend takes free
    credits first, makes an entry for each kind it takes, and is refused if both
    together don't suffice; a refused reference may be tried again.  A null
    reference is never a repeat.  What an action costs depends on those before
    it, so a user's actions are folded in the order of seq; of earlier
    references only those that come again are held.
    """
    schema = f"user_id long, seq long, reference string, allowed boolean, charged long, free_left long, paid_left long, from_free long, from_paid long, already_spent boolean, entries array<{_ENTRY}>"

    def fold(batches):
        user, free, paid, held = object(), 0, 0, set()
        for pdf in batches:
            out = []
            for u, seq, cost, ref, again, before, f, p, granted in pdf.itertuples(index=False):
                made = []
                if u != user:
                    user, held, free, paid = u, set(), int(f), int(p)
                    if not granted:
                        free += monthly
                        made.append(("GRANT", "FREE", monthly, free, f"grant:{u}"))
                if ref is not None and (before or ref in held):
                    out.append((u, seq, ref, True, 0, free, paid, 0, 0, True, made))
                    continue
                allowed = cost >= 0 and free + paid >= cost
                own = min(free, cost) if allowed else 0
                bought = cost - own if allowed else 0
                free, paid = free - own, paid - bought
                named = lambda kind, ref=ref: None if ref is None else f"{ref}:{kind}"
                made += [("SPEND", bucket, -n, left, named(bucket.lower())) for bucket, n, left in (("FREE", own, free), ("PAID", bought, paid)) if n > 0]
                if again and own + bought > 0:
                    held.add(ref)
                out.append((u, seq, ref, allowed, own + bought, free, paid, own, bought, False, made))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", entries")[0].split(", ")] + ["entries"])

    past = spent.select(F.regexp_extract("reference", "^(.*):(?:free|paid)$", 1).alias("reference")).filter("reference <> ''").distinct().withColumn("_before", F.lit(True))
    rows = actions.select(F.col("user_id").cast("long"), F.col("seq").cast("long"), F.col("cost").cast("long"), F.col("reference").cast("string"))
    marked = rows.withColumn("_again", F.col("reference").isNotNull() & (F.count("*").over(Window.partitionBy("user_id", "reference")) > 1)).join(past, "reference", "left")
    own = balances.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.max("free").alias("_free"), F.max("paid").alias("_paid"), F.bool_or("granted").alias("_granted"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    met = marked.join(own, "user_id", "left").select("user_id", "seq", "cost", "reference", "_again", off("_before").alias("_before"), zero("_free").alias("_free"), zero("_paid").alias("_paid"), off("_granted").alias("_granted"))
    return met.filter("user_id is not null").repartition("user_id").sortWithinPartitions("user_id", "seq").mapInPandas(fold, schema)


def entries_of(charged: DataFrame) -> DataFrame:
    """The ledger entries (user_id, seq, kind, bucket, delta, balance_after, reference) that :func:`charges` makes, none to three an action."""
    return charged.select("user_id", "seq", F.inline("entries"))
