"""Column functions on text.  Regular expressions keep to what Java and RE2 share, so SQL engines give the same results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}_]+"
NUMBER = "[0-9]+(?:[.,][0-9]+)*"
PROPER = "\\p{Lu}[\\p{L}\\p{N}]+(?: \\p{Lu}[\\p{L}\\p{N}]+)*"
SENTENCE_END = "[.!?]+(?:\\s+|$)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text, pattern: str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))


def words(text) -> Column:
    return matches(text, WORD)


def n_matches(text, pattern: str) -> Column:
    return F.size(matches(text, pattern))


def estimate_tokens(text) -> Column:
    """At least 1; characters over 3.8, halves to even."""
    return F.greatest(F.lit(1), F.bround(F.length(col(text)) / F.lit(3.8)).cast("int"))


def key(text) -> Column:
    """Trimmed, lower case, one space between words."""
    return F.lower(F.trim(F.regexp_replace(col(text), "[ \\t\\r\\n]+", " ")))


def title(text) -> Column:
    """Underscores to spaces, trimmed, first letter upper case."""
    t = F.trim(F.regexp_replace(F.translate(col(text), "_", " "), " +", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(text))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sentences(text, least_words: int = 3) -> Column:
    """Sentences of `least_words` words or more; a dot between digits ends none."""
    guarded = F.regexp_replace(col(text), "([0-9])\\.([0-9])", "$1․$2")
    parts = F.split(F.regexp_replace(guarded, SENTENCE_END, "$0␞"), "␞")
    parts = F.transform(parts, lambda s: F.trim(F.translate(F.translate(s, "\n", " "), "․", ".")))
    return F.filter(parts, lambda s: F.size(F.regexp_extract_all(s, F.lit(WORD), F.lit(0))) >= least_words)


def rewrite(text, rules: list[tuple[str, str]]) -> Column:
    """Ordered replacements; the order is part of their meaning."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, col(text))


def copy_case(model, value) -> Column:
    """`value` in the case pattern of `model`: UPPER, Capital or as it is."""
    m, v = col(model), col(value)
    first_up = F.substring(m, 1, 1) != F.lower(F.substring(m, 1, 1))
    capital = F.concat(F.upper(F.substring(v, 1, 1)), v.substr(F.lit(2), F.length(v)))
    return F.when((m == F.upper(m)) & (m != F.lower(m)) & (F.length(m) > 1), F.upper(v)).when(first_up, capital).otherwise(v)


def excerpt(text, at, around: int) -> Column:
    """Characters around the 1-based position `at`."""
    begin = F.greatest(F.lit(1), col(at) - around)
    return F.substring(col(text), begin, F.lit(2 * around))


def line_number(text, at) -> Column:
    before = F.substring(col(text), F.lit(1), col(at) - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def visible(html) -> Column:
    """Markup out, the five named references decoded, white space to single spaces."""
    t = F.regexp_replace(col(html), "(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, "[ \\t\\r\\n]+", " "))


def script_language(text) -> Column:
    """Language by script, then by common words; the first rule that holds wins."""
    t = col(text)
    return (
        F.when(t.rlike("\\p{IsCyrillic}"), "ru")
        .when(t.rlike("\\p{IsHan}"), "zh")
        .when(t.rlike("[ßäöü]"), "de")
        .when(t.rlike("[ñáíóú]"), "es")
        .when(t.rlike("[éèêç]"), "fr")
        .otherwise("en")
    )
