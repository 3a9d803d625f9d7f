"""Reports on answers and the references in them, named cases, numbers with two meanings, field weights, comparisons, listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import legal
from tessera.functions.spans import strike_places, with_brackets
from tessera.functions.text import base_section, hits, single_blanks, terms, words
from tessera.session import dealt

NOTE = "\n\n_References that could not be verified were removed._"


def report(answers: DataFrame, known: DataFrame, shown: DataFrame, key: str, text: str, places: Callable[[Column], Column], same: Callable[[Column], Column], note: str = NOTE, asked: str | None = None) -> DataFrame:
    """Rows (key, text, removed, flagged, verified, triggered, reason), one per answer.

    ``places`` gives the references of a text as an array of (start, stop, ref,
    key), of one kind or several; ``same`` gives the key of column ref of
    ``known`` and of ``shown``.  A reference is removed if it isn't known, and
    struck out of the text where it stands, with brackets that hold nothing
    else; the text then ends with ``note``.  It is flagged if it is known but
    wasn't shown, and verified in either case.  With an empty note this is the
    check of a draft.  ``asked`` names a column of ``answers`` with a key that
    stays although it isn't known.  Lists are sorted and have white space made
    single; a null text, or one without references, has empty ones.  Rows with
    one key and other texts, and rows with a null key, are reports of their own.
    References alone are joined; the lists of one text are as long as its
    references.  Texts are dealt into partitions of some thousands before they
    are searched, as a file of many short ones would be one task.
    """
    of = lambda df, name: df.select(same(F.col("ref")).alias("_k")).distinct().withColumn(name, F.lit(True))
    by = [F.col(key).alias("_key"), F.xxhash64(text, *([asked] if asked else [])).alias("_text")]
    own = [F.col(asked).alias("_asked")] if asked else [F.lit(None).cast("string").alias("_asked")]
    read = dealt(answers.filter(F.col(text).isNotNull()).select(*by, *own, F.col(text).alias("_t")), "_key", "_text")
    refs = read.select("_key", "_text", "_asked", "_t", F.explode(places(F.col("_t"))).alias("_p"))
    refs = refs.select("_key", "_text", "_asked", with_brackets(F.col("_t"), F.col("_p")).alias("_at"), single_blanks(F.col("_p")["ref"]).alias("_ref"), F.col("_p")["key"].alias("_k"))
    placed = refs.join(of(known, "_known"), "_k", "left").join(of(shown, "_shown"), "_k", "left").filter("_known or not _k <=> _asked")
    missing, unseen = F.col("_known").isNull(), F.col("_known").isNotNull() & F.col("_shown").isNull()
    listed = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("_ref"))))
    lists = placed.groupBy("_key", "_text").agg(listed(missing).alias("removed"), listed(unseen).alias("flagged"), listed(~missing).alias("verified"), F.collect_set(F.when(missing, F.col("_at"))).alias("_struck"))
    none = F.array().cast("array<string>")
    met = answers.select(F.col(key), F.col(text), *by).withColumnsRenamed({"_key": "_own_key", "_text": "_own_text"}).join(lists, F.col("_own_key").eqNullSafe(F.col("_key")) & (F.col("_own_text") == F.col("_text")), "left")
    out = met.select(key, text, "_struck", *(F.coalesce(c, none).alias(c) for c in ("removed", "flagged", "verified")))
    n_removed, n_flagged = F.size("removed"), F.size("flagged")
    said = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(what)))
    return out.withColumns(
        {
            text: F.when(n_removed > 0, F.concat(strike_places(F.col(text), F.col("_struck")), F.lit(note))).otherwise(F.col(text)),
            "triggered": n_removed + n_flagged > 0,
            "reason": F.concat_ws("; ", said(n_removed, " removed"), said(n_flagged, " not shown")),
        }
    ).drop("_struck")


def statutes_shown(answers: DataFrame, listed: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``listed`` (key, act, section and more) to show under each answer (key, text): the provisions it names.

    A number after a word for section with no act beside it names the one listed
    provision of that number, if there is only one.  An answer that names
    provisions, none of them listed, gets none; one that names none gets all.
    Keys of answers have to be unique; sub-sections count as their section.
    """
    written = legal.with_code_names(F.col(text))
    bare = F.transform(F.regexp_extract_all(written, F.lit(r"(?i)\b(?:sections?|secs?|s\.)\s*(\d+[A-Z]?)"), F.lit(1)), lambda x: F.upper(x))
    bases = F.transform(legal.statute_refs(written), lambda r: base_section(r))
    named = answers.select(F.col(key).alias("_key"), bases.alias("_refs"), bare.alias("_bare"))
    rows = listed.join(named, F.col(key) == F.col("_key")).withColumn("_base", F.upper(base_section(F.col("section"))))
    one = F.size(F.collect_set(F.upper("act")).over(Window.partitionBy(key, "_base"))) == 1
    hit = F.array_contains("_refs", F.concat(F.upper("act"), F.lit(" "), F.col("_base"))) | (F.array_contains("_bare", F.col("_base")) & one)
    marked = rows.withColumn("_hit", hit).withColumn("_any", F.bool_or("_hit").over(Window.partitionBy(key)))
    said = (F.size("_refs") > 0) | (F.size("_bare") > 0)
    return marked.filter(F.col("_hit") | (~F.col("_any") & ~said)).select(*listed.columns)


def by_report(cited: Column) -> Column:
    """An array of citations with those of SCC first (its criminal series apart), then AIR, then the others, each in their order."""
    rank = lambda c: F.when(c.rlike(r"(?i)\bSCC\b") & ~c.rlike(r"(?i)\bSCC\s*\(Cri"), 0).when(c.rlike(r"(?i)^AIR\b"), 1).otherwise(2)
    keyed = F.transform(cited, lambda c, i: F.struct(rank(c).alias("rank"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda s: s["c"])


def named_case(rows: DataFrame, asked: str, score: str, top_court: Column, court: str, day: str, key: str, least: float = 0.5, most: int = 3) -> DataFrame:
    """Rows of each asked name with at least the least score, one a court and day, ``most`` at most, with their ``position``.

    If the top court is among them its judgments alone remain; the better score
    goes first, then the smaller key.  A null day is a day of its own row.
    """
    found = rows.filter(F.col(score) >= least).withColumn("_top", F.coalesce(top_court, F.lit(False)))
    best = found.withColumn("_any", F.bool_or("_top").over(Window.partitionBy(asked))).filter("_top or not _any")
    order = [F.desc(score), F.asc(key)]
    once = F.coalesce(F.col(day).cast("string"), F.concat(F.lit("#"), F.col(key)))
    first = best.withColumn("_rn", F.row_number().over(Window.partitionBy(asked, court, once).orderBy(*order))).filter("_rn = 1")
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy(asked).orderBy(*order))).filter(F.col("position") <= most)
    return placed.select(*rows.columns, "position")


def ambiguous_numbers(mapping: DataFrame, sections: DataFrame, old_act: str, new_act: str) -> DataFrame:
    """Rows (number, now, title): numbers of the old act that moved elsewhere, while the new act has a section of that number.

    ``mapping`` has old_act, old_section, new_act, new_section, and ``sections``
    act, section, title.  ``now`` lists where the old number went.
    """
    went = mapping.filter((F.col("old_act") == old_act) & (F.col("new_act") == new_act)).groupBy(F.col("old_section").alias("number"))
    moved = went.agg(F.array_sort(F.collect_set("new_section")).alias("now")).filter("exists(now, s -> s <> number)")
    own = sections.filter(F.col("act") == new_act).groupBy(F.col("section").alias("number")).agg(F.min("title").alias("title"))
    return moved.join(own, "number").select("number", "now", "title")


def weighted_hits(docs: DataFrame, query: list[str], weights: dict[str, float], key: str) -> DataFrame:
    """Rows (key, score) of documents with a hit: how often the query's terms occur in each field, times the field's weight."""
    parts = [hits(terms(F.coalesce(F.col(c), F.lit(""))), query) * w for c, w in weights.items()]
    return docs.select(key, sum(parts[1:], parts[0]).alias("score")).filter("score > 0")


def compared(ours: DataFrame, theirs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, status, our_words, their_words): whether two versions of a text have the same words in the same order.

    status: same, differs or missing (no row in ``theirs``).  Digests and counts
    travel, not texts.  Keys have to be unique.
    """
    seen = lambda df, name: df.select(key, F.sha2(F.array_join(words(F.col(text)), " "), 256).alias(f"_{name}"), F.size(words(F.col(text))).alias(f"{name}_words"))
    both = seen(ours, "our").join(seen(theirs, "their"), key, "left")
    status = F.when(F.col("their_words").isNull(), "missing").when(F.col("_our").eqNullSafe(F.col("_their")), "same").otherwise("differs")
    return both.select(key, status.alias("status"), "our_words", "their_words")


def without_sentences(text: Column, pattern: str) -> Column:
    """A text without the sentences that meet the pattern; lines with none of them stay as they are, lines left empty go."""
    of_line = lambda line: F.trim(F.array_join(F.filter(F.split(line, r"(?<=[.!?।])\s+"), lambda s: ~s.rlike(pattern)), " "))
    lines = F.transform(F.split(text, "\n"), lambda line: F.when(~line.rlike(pattern), line).otherwise(F.nullif(of_line(line), F.lit(""))))
    return F.array_join(F.filter(lines, lambda line: line.isNotNull()), "\n")


# Hindi function words in Latin script.
HINGLISH = "hai hain kya ka ki ke mein kaun kaunsa kaunsi konsa konsi kitni kitna tha thi naya nayi purana purani ko liye hota hoti batao bataiye saza aur nahi kaise karo karna chahiye milti milta kab kahan gaya hoga".split()


def hinglish(c: Column) -> Column:
    """Whether a text without Devanagari has two different Hindi words in Latin script, or says that it is Hinglish."""
    found = F.size(F.array_intersect(F.split(F.lower(c), "[^a-z]+"), F.array(*map(F.lit, HINGLISH)))) >= 2
    return ~c.rlike(r"[\x{0900}-\x{097F}]") & (c.rlike(r"(?i)\bhinglish\b") | found)


def law_title(c: Column) -> Column:
    """Struct (word, number, act) of a title such as ``Section 138 in The Negotiable Instruments Act, 1881``, tags left out; null for others."""
    plain = F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    form = r"(?i)^(section|article)\s+(\d+[a-z]*)\s+in\s+(\S.*)$"
    part = lambda g: F.regexp_extract(plain, form, g)
    return F.when(plain.rlike(form), F.struct(F.initcap(part(1)).alias("word"), F.upper(part(2)).alias("number"), part(3).alias("act")))


def same_act(a: Column, b: Column) -> Column:
    """Whether two names of acts have the same words, in any order, and no different years; words that join others don't count."""
    bare = lambda c: F.regexp_replace(c, r"\([^)]*\)", " ")
    year = lambda c: F.nullif(F.regexp_extract(bare(c), r"\b(1[6-9]\d\d|20\d\d)\b", 1), F.lit(""))
    small = ("the", "of", "and", "in", "for", "a", "an", "to", "on")
    named = lambda c: F.array_sort(F.array_distinct(F.filter(words(bare(c)), lambda w: ~w.isin(*small) & ~w.rlike(r"^\d{4}$"))))
    return (named(a) == named(b)) & (F.size(named(a)) > 0) & F.coalesce(year(a) == year(b), F.lit(True))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, guard: Column | None = None) -> DataFrame:
    """One page of the rows that meet the guard, in a total order."""
    kept = df if guard is None else df.filter(guard)
    return kept.orderBy(*order).offset(offset).limit(limit)


def decided(users: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Users (key, status, role) after decisions (key, status): the verified rise from guest, others fall back to it, other roles stay."""
    new = decisions.groupBy(key).agg(F.max("status").alias("_new"))
    ok = F.col("_new") == "VERIFIED"
    role = F.when(ok & (F.col("role") == "GUEST"), "ADVOCATE").when(~ok & (F.col("role") == "ADVOCATE"), "GUEST").otherwise(F.col("role"))
    return users.join(new, key, "left").withColumns({"role": role, "status": F.coalesce("_new", "status")}).select(*users.columns)
