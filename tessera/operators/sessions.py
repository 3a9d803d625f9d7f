"""Conversations as a state machine: each message of a user leads from the state of the session to an action and the next state.

:func:`step` is the rule for one message; :func:`routed` folds it over a table,
and ``tessera.streaming.sessions`` over a stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states, what a search costs, and the words that ask for the next page or only acknowledge.
STATES = ("AWAITING_PROFILE", "AWAITING_LANGUAGE", "MAIN_MENU", "CASE_STATUS", "SECTION_INFO", "PRECEDENT_SEARCH")
COSTS = {"CASE_STATUS": 1, "SECTION_INFO": 2, "PRECEDENT_SEARCH": 2}
MORE = ("more", "next", "aur", "और", "continue")
THANKS = ("ok", "okay", "thanks", "thank you", "hello", "hi", "bye", "yes", "no", "done", "ठीक है", "धन्यवाद")
LANGUAGES = 3
PAGES = 3  # pages of a search that "more" leads through
TTL_SECONDS = 1800
ASKS = re.compile(r"\?|^(?:what|who|whose|whom|how|why|when|where|which|can|could|is|are|do|does|did|tell|explain|kya|kaise|kyu|kyun)\b|\b(?:ipc|bns|crpc|bnss|cpc|section|dhara|article|order)\b|क्या|कैसे|क्यों|कब|कौन|धारा|अनुच्छेद|अधिनियम|संहिता|संविधान")
CASE = re.compile(r"[a-z]{4}[0-9]{8}(?:19|20)[0-9]{2}")
STATE = "state string, last long, charged string, pages int, known boolean"
OUT = "before string, after string, action string, argument string, charge int"


@dataclass(frozen=True)
class Session:
    """state None: there is none, or it has run out.  last: microseconds of its latest message.  known: the profile is complete."""

    state: str | None = None
    last: int | None = None
    charged: str | None = None
    pages: int = 0
    known: bool = False


def step(now: Session, us: int, text: str | None, known: bool, ttl_seconds: int = TTL_SECONDS) -> tuple[Session, tuple]:
    """The session after one message, and (before, after, action, argument, charge).

    A session runs out ``ttl_seconds`` after its latest message.  A message that
    is older than that one is answered in the present state.
    """
    said = (text or "").strip()
    word = re.sub(r"\s+", " ", re.sub(r"[\s!.?,;:]+$", "", said.lower()))
    if now.last is not None and us - now.last > ttl_seconds * 1_000_000:
        now = Session(known=now.known)
    known = known or now.known
    state, last = now.state, max(us, now.last) if now.last is not None else us

    def to(after: str, action: str, argument: str | None = None, charge: int = 0, **changed) -> tuple[Session, tuple]:
        return replace(now, **({"state": after, "last": last, "known": known} | changed)), (state, after, action, argument, charge)

    def search(cost: int, argument: str, **changed) -> tuple[Session, tuple]:
        fresh = now.charged != word
        return to(state, "search", argument, cost if fresh else 0, charged=word, **changed)

    if state is None:
        return to("MAIN_MENU", "greet") if known else to("AWAITING_PROFILE", "ask_profile")
    if state == "AWAITING_PROFILE":
        fields = [f.strip() for f in said.split(",")]
        if len(fields) == 4 and all(fields) and re.search("[0-9]", fields[1]):
            return to("AWAITING_LANGUAGE", "save_profile", fields[1], known=True)
        return to(state, "ask_profile")
    question = bool(ASKS.search(said.lower()))
    if state == "AWAITING_LANGUAGE":
        if word.isascii() and word.isdigit() and 1 <= int(word) <= LANGUAGES:
            return to("MAIN_MENU", "set_language", word)
        return to("MAIN_MENU", "classify", said) if question else to(state, "ask_language")
    if word in MORE:
        return to(state, "next_page", pages=now.pages - 1) if now.pages > 0 else to("MAIN_MENU", "nothing_more")
    if said == "0" or (not said and state != "CASE_STATUS"):
        return to("MAIN_MENU", "show_menu")
    if state == "MAIN_MENU":
        if said in ("1", "2"):
            return to(STATES[2 + int(said)], "ask_input")
        return to("PRECEDENT_SEARCH", "ask_input", pages=0, charged=None) if said == "3" else to(state, "classify", said)
    if state == "CASE_STATUS":
        number = re.sub(r"[\s-]", "", said.lower())
        if CASE.fullmatch(number):
            fresh = now.charged != number
            return to(state, "search", number.upper(), COSTS[state] if fresh else 0, charged=number)
        digits = len(re.findall("[0-9]", number))
        return to(state, "ask_input") if len(number) >= 10 and digits >= 6 else to("MAIN_MENU", "classify", said)
    if word in THANKS or not word:
        return to("MAIN_MENU", "classify", said)
    return search(COSTS[state], said, pages=PAGES) if state == "PRECEDENT_SEARCH" else search(COSTS[state], said)


def routed(messages: DataFrame, user: str, message: str, time: str, text: str, known: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Rows (user, message, before, after, action, argument, charge), one a message, in the order of time and message.

    A message id that comes again is taken once, at its first time.  Rows
    without a user, an id or a time are left out; a null text is empty, a null
    ``known`` is false.  A user's messages pass through one task one by one, in
    which only the session is held.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = messages.select(F.col(user).alias("user"), F.col(message).alias("message"), micros.alias("us"), F.col(text).alias("text"), F.coalesce(F.col(known), F.lit(False)).alias("known"))
    first = rows.dropna(subset=["user", "message", "us"]).groupBy("user", "message").agg(F.min(F.struct("us", "text", "known")).alias("m")).select("user", "message", "m.*")
    kinds = {f.name: f.dataType for f in first.schema}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, now = None, Session()
        for batch in batches:
            out = []
            for u, us, text, known in zip(*(batch.column(c).to_pylist() for c in ("user", "us", "text", "known")), strict=True):
                now = now if u == who else Session()
                who = u
                now, told = step(now, us, text, known, ttl_seconds)
                out.append(told)
            if out:
                told = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), [*[pa.string()] * 4, pa.int32()], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("user"), batch.column("message"), *told], ["user", "message", "before", "after", "action", "argument", "charge"])

    dealt = first.repartition("user").sortWithinPartitions("user", "us", "message")
    schema = f"user {kinds['user'].simpleString()}, message {kinds['message'].simpleString()}, {OUT}"
    return dealt.mapInArrow(fold, schema).withColumnsRenamed({"user": user, "message": message})
