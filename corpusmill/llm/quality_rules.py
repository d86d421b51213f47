"""Quality by weak supervision, in DataFrame functions only.

Each rule looks at counts of one text and votes good (1), bad (-1) or abstains (0).  Rows are
aggregated to vote patterns, at most 3^8 of them; expectation-maximisation over the pattern
counts estimates, without labels, how often the votes of each rule are right.  A text stays when
its posterior probability of being good reaches the threshold, instead of having to pass every rule.

A null text has no words, every count is 0 and base_failed is true.  Texts of any length are
counted whole.  Repeated rows count each time; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
ROUNDS = 40
THRESHOLD = 0.5
#: How often a rule that votes is right, before anything is known.
START = 0.9
#: Weight of that prior as a share of a rule's votes: no accuracy ever reaches 1.
PSEUDO = 0.05


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs"]


def base_counts(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row, COUNTS): `columns` of `docs` (all of them) as one struct, so that none can clash, and the counts of its text."""
    own = docs.columns if columns is None else columns
    raw = F.coalesce("text", F.lit(""))
    out = docs.select(F.struct(*own).alias("row"), raw.alias("t"), F.array_remove(F.split(raw, SPACE), "").alias("w"), F.filter(F.split(raw, "\n"), lambda x: x.rlike(WORD)).alias("l"))
    n, lines = F.size("w"), F.col("l")

    def number(of: str) -> Column:
        return (F.size(F.split("t", of)) - 1).cast("long")

    return out.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        number(SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(n < 3, F.lit(0)).otherwise(repeat_words()).cast("long").alias("n_repeat_words"),
        number("[A-Z]").alias("n_upper"),
        number("!").alias("n_bangs"),
    )


def repeat_words(window: str = "xxhash64(w[i], w[i + 1], w[i + 2])", small: int = 1 << 21) -> Column:
    """Words of the array w inside windows of three that occur twice or more.

    Windows with a hash of their own occur once.  The hashes are sorted as longs with the place in
    the low bits (from `small` words on as pairs, since a place needs more bits); windows whose
    neighbour in that order has the same hash are candidates, and candidates are sorted and
    compared by their words.
    """
    packed = f"sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft({window}, 21) | CAST(i AS BIGINT)))"
    pairs = f"sort_array(transform(sequence(0, size(w) - 3), i -> struct({window} AS h, i AS p)))"
    places = f"""CASE WHEN size(w) < {small}
        THEN transform(array({packed}), s -> transform(filter(s, (x, k) ->
            (k > 0 AND shiftright(x, 21) = shiftright(s[k - 1], 21)) OR (k + 1 < size(s) AND shiftright(x, 21) = shiftright(s[k + 1], 21))), x -> CAST(x & 2097151 AS INT)))[0]
        ELSE transform(array({pairs}), s -> transform(filter(s, (x, k) -> (k > 0 AND x.h = s[k - 1].h) OR (k + 1 < size(s) AND x.h = s[k + 1].h)), x -> x.p))[0] END"""
    by_words = f"sort_array(transform({places}, p -> struct(concat_ws(' ', w[p], w[p + 1], w[p + 2]) AS g, p)))"
    again = f"transform(array({by_words}), s -> transform(filter(s, (x, k) -> (k > 0 AND x.g = s[k - 1].g) OR (k + 1 < size(s) AND x.g = s[k + 1].g)), x -> x.p))[0]"
    return F.expr(f"size(array_distinct(flatten(transform({again}, p -> array(p, p + 1, p + 2)))))")


def votes() -> list[tuple[str, Column]]:
    """Rules over the counts: (name, vote).  Most look for one fault and abstain without it; two recognise prose."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.col("word_chars")

    def fault(bad: Column) -> Column:
        return F.when(bad, F.lit(-1)).otherwise(F.lit(0))

    few_symbols, even_case = F.col("n_symbols") * 50 <= n, F.col("n_upper") * 5 <= chars
    varied = (F.col("n_repeat_words") * 4 <= n) & (F.col("n_dup_lines") * 20 <= n)
    plain_words = (chars >= 2 * n) & (chars <= 14 * n)
    return [
        ("symbols", fault(F.col("n_symbols") * 5 >= n)),
        ("repeats", fault(F.col("n_repeat_words") * 5 >= n * 2)),
        ("word_length", fault(~plain_words)),
        ("capitals", fault(F.col("n_upper") * 2 >= chars)),
        ("exclamations", fault(F.col("n_bangs") * 2 >= n)),
        ("lines", fault(F.col("n_dup_lines") * 8 >= n)),
        ("prose", F.when(few_symbols & even_case & plain_words & (F.col("n_bangs") * 20 <= n), F.lit(1)).otherwise(F.lit(0))),
        ("variety", F.when(varied & few_symbols, F.lit(1)).otherwise(F.lit(0))),
    ]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation on vote patterns with counts: posterior probability of good for each.

    A rule's accuracy is how often its votes are right; an abstention says nothing.  Both
    classes are equally likely beforehand: a common class would otherwise outvote the rules,
    and the share of good texts here comes from the votes alone.
    """
    if not patterns:
        return {}
    k = len(patterns[0][0])
    right, post = [START] * k, {}
    for _ in range(rounds):
        for p, _ in patterns:
            odds = sum(v * math.log(right[j] / (1 - right[j])) for j, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(min(700, -odds)))
        for j in range(k):
            seen = sum(c for p, c in patterns if p[j])
            agree = sum(c * (post[p] if p[j] > 0 else 1 - post[p]) for p, c in patterns if p[j])
            prior = 1 + PSEUDO * seen
            right[j] = (agree + START * prior) / (seen + prior)
    return post



def _judged(docs: DataFrame, threshold: float, columns: list[str] | None) -> DataFrame:
    """(row, COUNTS, base_failed, p_good, kept).  The texts are counted once; what is needed later is written to the shared folder.  Only the pattern counts, 3^8 rows at most, reach the driver."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = base_counts(docs, columns).withColumn("pattern", F.concat_ws(",", *(v.cast("string") for _, v in votes())))
    voted = cut(voted)
    found = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    post = fit(sorted((tuple(map(int, r["pattern"].split(","))), r["n"]) for r in found))
    lookup = docs.sparkSession.createDataFrame([(",".join(map(str, p)), float(x)) for p, x in post.items()], "pattern string, p_good double")
    out = voted.join(F.broadcast(lookup), "pattern", "left")  # 3^8 rows at most
    return out.select("row", *COUNTS, base.alias("base_failed"), "p_good", (~base & (F.coalesce("p_good", F.lit(0.0)) >= threshold)).alias("kept"))


def quality(docs: DataFrame, threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """`docs` (or only `columns` of it) with the counts, base_failed, p_good and kept; a column of `docs` that bears one of these names gives way."""
    made = [*COUNTS, "base_failed", "p_good", "kept"]
    own = [c for c in (docs.columns if columns is None else columns) if c.lower() not in made]
    return _judged(docs, threshold, columns).select(*(F.col("row")[c].alias(c) for c in own), *made)


def keep_quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns.  Null and empty texts fail the base rules and go; repeated rows get one verdict; an empty table gives an empty one."""
    return _judged(docs, threshold, None).filter("kept").select("row.*")
