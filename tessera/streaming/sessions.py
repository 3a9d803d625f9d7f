"""The session router over a stream: a state a user, kept with a timer until the session runs out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.sessions import OUT, STATE, TTL_SECONDS, Session, step

#: State stores of ``transformWithState``; set it for ``spark.sql.streaming.stateStore.providerClass``.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Router(StatefulProcessor):
    def __init__(self, ttl_seconds: int):
        self.ttl_seconds = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE)
        self.seen = handle.getMapState("seen", "message long", "at long")

    def _ends(self, session: Session) -> int:
        return session.last // 1000 + self.ttl_seconds * 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.session.get() if self.session.exists() else None
        now = Session(*held) if held is not None else Session()
        had = self._ends(now) if now.last is not None else None
        for row in sorted(rows, key=lambda r: (r.us, r.message)):  # one user's messages of one batch
            if self.seen.containsKey((row.message,)):
                continue
            self.seen.updateValue((row.message,), (row.us,))
            now, told = step(now, row.us, row.text, row.known, self.ttl_seconds)
            yield Row(user=key[0], message=row.message, before=told[0], after=told[1], action=told[2], argument=told[3], charge=told[4])
        if now.last is not None and self._ends(now) != had:
            if had is not None:
                self.handle.deleteTimer(had)
            self.handle.registerTimer(self._ends(now))
            self.session.update(astuple(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.session.get()
        if held is not None and self._ends(Session(*held)) <= expiredTimerInfo.getExpiryTimeInMs():
            yield Row(user=key[0], message=None, before=held[0], after=None, action="expired", argument=None, charge=0)
            self.session.clear()
            self.seen.clear()

    def close(self) -> None:
        pass


def routed(messages: DataFrame, user: str, message: str, time: str, text: str, known: str, ttl_seconds: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Rows (user, message, before, after, action, argument, charge) as messages arrive; see the batch form for the rule.

    Of one batch a user's messages are taken in the order of time.  A message
    that comes later than ``late`` is left out, one that is only older than the
    last is answered in the present state, and an id that comes again within its
    session is taken once.  When the watermark passes the end of a session its
    state goes, and a row says ``expired``; so the state is bounded by the users
    of ``ttl_seconds`` and ``late``.  The session needs the state store STORE.
    """
    stamp = F.col(time).cast("timestamp")
    rows = messages.filter(F.col(user).isNotNull() & F.col(message).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(user).cast("long").alias("user"), F.col(message).cast("long").alias("message"), stamp.alias("at"), F.unix_micros(stamp).alias("us"), F.col(text).alias("text"), F.coalesce(F.col(known), F.lit(False)).alias("known"))
    grouped = rows.withWatermark("at", late).groupBy("user")
    found = grouped.transformWithState(_Router(ttl_seconds), f"user long, message long, {OUT}", "Append", "EventTime")
    return found.withColumnsRenamed({"user": user, "message": message})
