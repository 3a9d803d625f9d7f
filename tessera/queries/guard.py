"""Queries of places in texts: references by offset, release points, questions on old and new codes, sections shown, and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import legal, spans
from tessera.operators import answers, differences
from tessera.session import dealt, table

#: Mail addresses, host names, network addresses and long numbers; a host name inside a mail address is no place of its own.
PLACES = (r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", r"[A-Za-z0-9]+\.[a-z]+\.(?:com|org|net)\b", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"\b\d{10,}\b")
BROKEN = r"[a-z]+[,.]?\n[A-Za-z]+ [a-z]+"  # a name that a line break parts
LOOKAHEAD = 24
PAIRS = 1000  # versions of a partition, as comparing them is what takes time
_ASKED = (
    "case p_size % 9 when 0 then concat('IPC ', p_size, ' ka BNS mein kya hua') when 1 then concat('CrPC section ', p_size, 'A maintenance - which section in BNSS?') "
    "when 2 then concat('BNSS ', p_size, ' in CrPC?') when 3 then concat('IPC ', p_size, ' vs BNS ', p_partkey) when 4 then concat('2023 mein ', p_size, ' IPC, BNS?') "
    "when 5 then concat('CrPC की धारा ', p_size, ' BNSS') when 6 then concat('section ', p_size, ' (', p_size % 7, ') of the  Evidence Act under BSA') "
    "when 7 then concat('what is section ', p_size) else concat('IPC and BNS and ', p_brand) end"
)
_SAID = (
    "case p_size % 6 when 0 then concat('Section ', p_partkey % 40, ' of the Bharatiya Nyaya Sanhita, 2023 applies.') when 1 then concat('See sections ', p_partkey % 40, ' and ', p_size, '(2) of the IPC.') "
    "when 2 then concat('Under section ', p_size, '(1) bail is a right.') when 3 then concat('IPC ', 900 + p_size, ' says so.') when 4 then 'Nothing is named.' else concat('IPC ki dhara. धारा ', p_partkey % 40, ' BNS') end"
)


def document_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.maximal(spans.places(F.col("text"), *PLACES))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(found)).withColumnRenamed("ref", "said")


def release_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document could be shown if more were to come."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", spans.places(F.col("text"), *PLACES, BROKEN).alias("found"))
    return docs.select("doc_id", F.length("text").alias("written"), spans.releasable_end(F.col("text"), F.col("found"), LOOKAHEAD).alias("released"))


def masked_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    masked = spans.strike_places(t, spans.places(t, *PLACES[:1], *PLACES[2:]), "[private]")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(masked).alias("digest"), F.length(masked).alias("chars"))


def recodified_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = legal.recodified_reference(F.expr(_ASKED))
    return table(spark, sf_dir, "part").select("p_partkey", asked["act"].alias("act"), asked["section"].alias("section"))


def sections_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer lists four provisions, of which those are shown that it names."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(_SAID).alias("said"))
    rows = F.expr("array(struct('BNS' as act, cast(p_partkey % 40 as string) as section), struct('IPC' as act, cast(p_size as string) as section), struct('IPC' as act, concat(p_partkey % 40, 'A') as section), struct('BSA' as act, cast(p_size as string) as section))")
    listed = part.select("p_partkey", F.inline(rows))
    return answers.statutes_shown(part, listed, "p_partkey", "said").select("p_partkey", "act", "section")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, first_id, ours, theirs): each text with that of the first document that begins with the same 24 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 1, 24).alias("start"))
    first = docs.groupBy("start").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    pairs = docs.join(first, "start").select("doc_id", F.col("first.doc_id").alias("first_id"), F.col("text").alias("ours"), F.col("first.text").alias("theirs"))
    return dealt(pairs, "doc_id", each=PAIRS, rows=docs.count())  # a frequent beginning joins many in one task


def version_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where versions of a text differ, word by word."""
    pairs = _versions(spark, sf_dir).filter("doc_id <> first_id")
    return differences.differences(pairs, "doc_id", "ours", "theirs").select("doc_id", "op", "our_start", "our_stop", "their_start", "their_stop", F.size("added").alias("n_added"))


def replayed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version of each text, made of its own words and the differences alone."""
    pairs = _versions(spark, sf_dir)
    return differences.replay(pairs, differences.differences(pairs, "doc_id", "ours", "theirs"), "doc_id", "ours").select("doc_id", F.md5(F.array_join("words", " ")).alias("digest"), F.size("words").alias("n_words"))


QUERIES = {f.__name__: f for f in (document_places, release_points, masked_places, recodified_numbers, sections_shown, version_differences, replayed_versions)}

_MATCHES = "(select doc_id, {k} as form, unnest(regexp_extract_all(text, '{p}')) as said, unnest(range(len(regexp_extract_all(text, '{p}')))) as i, string_split_regex(text, '{p}') as gaps from documents)"
_OF = lambda patterns: " union all ".join(f"select * from {_MATCHES.format(k=k, p=p)}" for k, p in enumerate(patterns))
_PLACED = """
    found as ({found}),
    sized as (select doc_id, form, i, said, length(said) as n, length(gaps[i + 1]) as gap from found),
    stops as (select doc_id, said, n, sum(gap + n) over (partition by doc_id, form order by i)::int as stop from sized),
    placed as (select doc_id, stop - n::int as start, stop, said from stops)"""
_DIGITS = r"[0-9]+[A-Z]?(?:\s*[(]\s*[0-9]+\s*[)])?"
_PAIR = {"IPC": r"(?:ipc|indian penal code)", "BNS": r"(?:bns|bharatiya nyaya sanhita)", "CRPC": r"(?:crpc|code of criminal procedure)", "BNSS": r"(?:bnss|bharatiya nagarik suraksha sanhita)", "IEA": r"(?:iea|(?:indian )?evidence act)", "BSA": r"(?:bsa|bharatiya sakshya adhiniyam)"}
_BETWEEN = r"\s*(?:(?:ki|ka|ke|की|का|के)\s+)?(?:(?:section|sec|s|dhara|dhaara|धारा)\b)?[.]?\s*"
_ANY = "(?:" + "|".join(_PAIR.values()) + ")"
_NUMBER_OF = lambda act: f"coalesce(nullif(regexp_extract(t, '(?i)\\b{_PAIR[act]}\\b{_BETWEEN.replace(')' + chr(92) + 'b)?', '))?')}({_DIGITS})', 1), ''), nullif(regexp_extract(bare, '(?i)\\b({_DIGITS})\\s+(?:of\\s+(?:the\\s+)?)?{_PAIR[act]}\\b', 1), ''))"
ORACLES = {
    "document_places": f"""
        with {_PLACED.format(found=_OF(PLACES))}
        select distinct doc_id, start, stop, said from placed p
        where not exists (select 1 from placed q where q.doc_id = p.doc_id and q.start <= p.start and q.stop >= p.stop and q.stop - q.start > p.stop - p.start)
    """,
    "release_points": rf"""
        with {_PLACED.format(found=_OF((*PLACES, BROKEN)))},
        lines as (select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents),
        ends as (select doc_id, length(text) as written, sum(length(line) + 1) over (partition by doc_id order by i) as stop from lines),
        fine as (select * from ends e where stop <= written - {LOOKAHEAD} and not exists (select 1 from placed p where p.doc_id = e.doc_id and p.start < e.stop and p.stop >= e.stop))
        select d.doc_id, length(text)::int as written, coalesce(max(f.stop), 0)::int as released from documents d left join fine f using (doc_id) group by d.doc_id, text
    """,
    "masked_places": f"""
        with m as (select doc_id, regexp_replace(text, '{'|'.join((*PLACES[:1], *PLACES[2:]))}', '[private]', 'g') as t from documents)
        select doc_id, md5(t) as digest, length(t)::int as chars from m
    """,
    "recodified_numbers": f"""
        with q as (select p_partkey, {_ASKED.replace("concat(", "concat(")} as t from part),
        b as (select p_partkey, t, regexp_replace(t, '(?i)\\b{_ANY}\\b{_BETWEEN.replace(')' + chr(92) + 'b)?', '))?')}{_DIGITS}', ' # ', 'g') as bare from q),
        n as (select p_partkey, t, {', '.join(f"{_NUMBER_OF(a)} as n_{a.lower()}, regexp_matches(t, '(?i)" + chr(92) + f"b{_PAIR[a]}" + chr(92) + f"b') as has_{a.lower()}" for a in _PAIR)} from b),
        u as (select p_partkey, case {' '.join(f"when has_{o} and has_{w} and (n_{o} is null) <> (n_{w} is null) then case when n_{o} is not null then '{o.upper()}|' || n_{o} else '{w.upper()}|' || n_{w} end" for o, w in (('ipc', 'bns'), ('crpc', 'bnss'), ('iea', 'bsa')))} end as a from n)
        select p_partkey, split_part(a, '|', 1) as act, upper(regexp_replace(split_part(a, '|', 2), '\\s+', '', 'g')) as section from u
    """,
    "sections_shown": f"""
        with q as (select p_partkey, p_size, {_SAID} as said from part),
        w as (select p_partkey, p_size, regexp_replace(regexp_replace(replace(said, 'धारा ', 'Section '), 'Bharatiya Nyaya Sanhita, 2023', 'BNS'), '(BNS|IPC) (?:ki|ka|ke) ', '\\1 ') as t from q),
        r as (select *, case when p_size % 6 in (0, 5) then [regexp_extract(t, 'Section ([0-9]+)', 1)] else [] end as bns,
            case when p_size % 6 = 1 then [regexp_extract(t, 'sections ([0-9]+)', 1), regexp_extract(t, 'and ([0-9]+)', 1)] when p_size % 6 = 3 then [regexp_extract(t, 'IPC ([0-9]+)', 1)] else [] end as ipc,
            list_transform(regexp_extract_all(t, '(?i)\\b(?:sections?|secs?)\\s*([0-9]+)', 1), lambda x: x) as bare from w),
        l as (select p_partkey, unnest([{{'act': 'BNS', 'section': (p_partkey % 40)::varchar}}, {{'act': 'IPC', 'section': p_size::varchar}}, {{'act': 'IPC', 'section': (p_partkey % 40) || 'A'}}, {{'act': 'BSA', 'section': p_size::varchar}}], recursive := true), bns, ipc, bare from r),
        h as (select *, list_contains(case act when 'BNS' then bns when 'IPC' then ipc else [] end, section) or (list_contains(bare, section) and count(distinct act) over (partition by p_partkey, section) = 1) as hit from l)
        select p_partkey, act, section from h qualify hit or (not bool_or(hit) over (partition by p_partkey) and len(bns) + len(ipc) + len(bare) = 0)
    """,
    "replayed_versions": r"""
        with d as (select doc_id, text, substr(text, 1, 24) as start from documents), f as (select start, arg_min(text, doc_id) as text from d group by start),
        w as (select doc_id, list_filter(regexp_split_to_array(lower(f.text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as ws from d join f using (start))
        select doc_id, md5(array_to_string(ws, ' ')) as digest, len(ws)::int as n_words from w
    """,
}
