"""Text expressions: pure Column functions, evaluated in the JVM. A null input gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been being have has had do does did will would should could may might can this that these those"
).split()
#: Terms that make a sentence a claim.
CLAIM_TERMS = ["copay", "deductible", "coinsurance", "out-of-pocket", "maximum", "minimum"]
#: Phrases of answers that say nothing specific.
GENERIC_PHRASES = ["i don't know", "i'm not sure", "cannot determine", "unable to", "please consult", "contact your", "refer to", "check with"]
#: Patterns of claims with a number, in order. Digits are 0 to 9 alone, so that all engines give the same rows.
CLAIM_PATTERNS = [r"\$[0-9]+(?:\.[0-9]+)?", r"[0-9]+\s*(?:hours?|minutes?|days?|weeks?)", r"(?:step|step\s+)[0-9]+", r"[0-9]+(?:\.[0-9]+)?\s*(?:percent|%)"]
#: What each pattern needs, one of them in lower case: texts without it are not searched.
CLAIM_SIGNS = [["$"], ["hour", "minute", "day", "week"], ["step"], ["percent", "%"]]
#: A word of three characters or more; shorter ones are no keywords.
WORD = r"[\p{L}\p{N}_]{3,}"
SPLIT = "[.!?]+"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once for a row, even where fn uses it in a lambda for each element of an array."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """In lower case, with one space in place of each run of white space; single spaces are left as they are."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s{2,}|[\t\n\x0B\f\r]", " "))


def keywords(c: Column) -> Column:
    """Lower-cased words of more than two characters that are no stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))


def keyword_set(lowered: Column) -> Column:
    """The distinct keywords of a text that is in lower case, without a lambda."""
    return F.array_except(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array(*map(F.lit, STOP_WORDS)))


#: Claims of an answer that are looked at.
LIMIT = 5


def claims(c: Column, limit: int = LIMIT) -> Column:
    """The first claims: amounts, times, steps and percentages, then short sentences with a digit or a term of insurance."""
    none = F.array().cast("array<string>")
    signs = [reduce(Column.__or__, (F.contains(F.lower(c), F.lit(x)) for x in some)) for some in CLAIM_SIGNS]
    numbers = [F.when(~sign, none).otherwise(F.regexp_extract_all(c, F.lit("(?i)" + p), F.lit(0))) for sign, p in zip(signs, CLAIM_PATTERNS, strict=True)]
    telling = F.filter(
        F.transform(F.split(c, SPLIT, -1), strip),
        lambda s: (F.length(s) > 10) & (F.length(s) < 100) & (s.rlike("[0-9]") | F.lower(s).rlike("|".join(CLAIM_TERMS))),
    )
    return F.slice(F.concat(*numbers, telling), 1, limit)


def is_generic(c: Column) -> Column:
    return F.lower(c).rlike("|".join(GENERIC_PHRASES))


def numeric_cost(c: Column) -> Column:
    """The first number of a text without its commas; null without one. Cast numbers to string to keep them."""
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")  # an empty text is no number


def token_estimate(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+", -1), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sentences(c: Column) -> Column:
    """Sentences, trimmed; all but the text's last piece end with '. '. Blank pieces are dropped."""
    pieces = F.transform(F.split(c, SPLIT, -1), strip)
    some = lambda x: F.filter(x, lambda s: s != "")
    return let(pieces, lambda p: F.concat(F.transform(some(F.slice(p, 1, F.size(p) - 1)), lambda s: F.concat(s, F.lit(". "))), some(F.slice(p, -1, 1))))


def blank(c: Column) -> Column:
    """True for null and for white space alone."""
    return F.coalesce(strip(c), F.lit("")) == ""


def input_error(**required: Column) -> Column:
    """A message that names the first blank input; null if all are there."""
    out = F.lit(None).cast("string")
    for name, c in reversed(required.items()):
        out = F.when(blank(c), F.lit(f"missing {name}")).otherwise(out)
    return out
