"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def citation_key(c: Column) -> Column:
    """Letters and digits only, in upper case: the form in which citations are compared."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def base_section(c: Column) -> Column:
    """The section before a sub-clause: ``318(4)`` -> ``318``."""
    return F.split_part(c, F.lit("("), F.lit(1))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits of any script, with the marks that belong to them."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def terms(c: Column) -> Column:
    """Lower-case words between white space, without marks at their ends."""
    return F.filter(F.split(F.lower(c), r"[\s.,;:!?]+"), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of the words, each padded by two blanks before and one after."""
    padded = F.transform(words(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(padded, cut)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct elements; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def hits(tokens: Column, query: list[str]) -> Column:
    """How many tokens are one of the query's terms."""
    return F.size(F.filter(tokens, lambda t: t.isin(query)))


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def strip_html(c: Column) -> Column:
    """Text of an HTML page: no scripts, styles, comments or tags; common entities decoded; white space made single blanks."""
    out = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def context_key(c: Column) -> Column:
    """Equal for questions that differ only in case, marks and order of words."""
    return F.array_join(F.array_sort(words(c)), " ")


def single_blanks(c: Column) -> Column:
    """White space made single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def roman_value(c: Column) -> Column:
    """Value of a roman numeral, null for anything else."""
    value = F.create_map(*(F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair))
    letters = F.transform(F.split(F.upper(c), ""), lambda x: F.coalesce(F.try_element_at(value, x), F.lit(0)))
    signed = F.transform(letters, lambda v, i: F.when(v < F.coalesce(F.get(letters, i + 1), F.lit(0)), -v).otherwise(v))
    total = F.aggregate(signed, F.lit(0), lambda acc, v: acc + v)
    return F.when(F.upper(c).rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (c != ""), total)


def char_code_sum(c: Column) -> Column:
    """Sum of the character codes, a stable seed for mock rows."""
    return F.aggregate(F.split(c, ""), F.lit(0), lambda acc, x: acc + F.ascii(x))


def clamp(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last of them an ellipsis if something was cut."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def mask_tail(c: Column, shown: int = 4) -> Column:
    """Stars for all but the last characters."""
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(c) - shown, F.lit(0))), F.right(c, F.lit(shown)))


def requested_word_count(c: Column, low: int = 10, high: int = 300) -> Column:
    """The number in a wish such as "in 80 words", kept within the limits; null without one."""
    asked = F.regexp_extract(F.lower(c), r"(?:in|within|about|under)\s+(\d{1,4})\s+words?", 1)
    return F.when(asked != "", F.greatest(F.lit(low), F.least(F.lit(high), F.nullif(asked, F.lit("")).cast("int"))))
