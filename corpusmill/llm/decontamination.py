"""Benchmark decontamination, in DataFrame functions only.

The windows of the benchmark's texts are normalised, collected into a hash set and sent to every task as
one value: an array of slots, each with the windows whose hash falls there.  A scan over the documents
hashes each of its own windows, looks at the slot, and compares the words where the slot is not empty.
There is no shuffle and no second read of the texts.  The set goes out only where it is measured to be
small (SET_ROWS windows and SET_BYTES bytes); beyond that windows are joined by their words instead.

Null texts, and texts without words, hit nothing and are no item.  Texts of any length are scanned whole.
Repeated rows are judged each, repeated windows of an item are one, an item_id on several rows is one
item.  A null item_id is no item.  An empty benchmark leaves every document clean; an empty table gives
an empty result.  Columns of the caller are kept, but for those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is no word after lower-casing A-Z, and the same for texts as they are.
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
OTHER_RAW = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WINDOW = 10
#: The largest set that is sent to all tasks.
SET_ROWS, SET_BYTES = 200_000, 32 << 20
NO_HITS = "CAST(array() AS ARRAY<STRUCT<i: INT, m: INT, items: ARRAY<STRING>>>)"
COUNTS = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]


def words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), OTHER + "+"), "")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, m, items): every distinct window of the items, its number of words and the sorted ids of the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words("text").alias("w")).filter("item IS NOT NULL AND size(w) > 0")
    each = items.select("item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))")).alias("g"))
    return each.groupBy(F.array_join("g", " ").alias("gram"), F.size("g").alias("m")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _hash(m: int, word: str) -> str:
    return f"xxhash64({', '.join(word.format(j) for j in range(m))})"


def _hits_by_set(rows: DataFrame, grams: DataFrame, lengths: list[int], count: int) -> DataFrame:
    """The set as one array: slot k holds the windows with hash k modulo its size, or null.

    A text's words are bound to one variable, so that no filter that Spark moves down splits them again at every place.
    """
    size = 1 << min(21, (16 * count - 1).bit_length())  # most slots are empty, so few places need a comparison
    spread = grams.withColumn("w", F.split("gram", " "))
    slot = F.coalesce(*(F.when(F.col("m") == m, F.expr(_hash(m, "w[{}]"))) for m in lengths))
    spread = spread.groupBy(F.pmod(slot, F.lit(size)).cast("int").alias("slot")).agg(F.collect_list(F.struct("gram", "items")).alias("entries"))
    every = rows.sparkSession.range(size).select(F.col("id").cast("int").alias("slot")).join(spread, "slot", "left")
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "entries"))), lambda x: x["entries"]).alias("slots"))
    hits = []
    for m in lengths:
        at = f"slots[CAST(pmod({_hash(m, 'v[i + {}]')}, {size}) AS INT)]"
        near = f"filter(CASE WHEN size(v) >= {m} THEN sequence(0, size(v) - {m}) ELSE CAST(array() AS ARRAY<INT>) END, i -> {at} IS NOT NULL)"
        same = f"transform({near}, i -> struct(i, {m} AS m, get(filter({at}, e -> e.gram = array_join(slice(v, i + 1, {m}), ' ')), 0).items AS items))"
        hits.append(f"filter({same}, x -> x.items IS NOT NULL)")
    found = F.expr(f"transform(array(w), v -> struct(size(v) AS n, array_sort(concat({', '.join(hits)})) AS hits))[0]")
    return rows.withColumn("slots", table.scalar()).select("row", found.alias("found")).select("row", "found.n", "found.hits")


def _hits_by_join(rows: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a set of any size: windows meet by an equi-join on their words; a text's hits come back to its rows by two hashes of its words."""
    text = F.array_join("w", " ")
    keyed = rows.withColumn("h", F.struct(F.xxhash64(text).alias("a"), F.unhex(F.sha2(text, 256)).alias("b")))
    texts = keyed.dropDuplicates(["h"]).select("h", "w")
    places = F.expr(f"flatten(array({', '.join(f'transform(CASE WHEN size(w) >= {m} THEN sequence(0, size(w) - {m}) ELSE CAST(array() AS ARRAY<INT>) END, i -> struct(i, {m} AS m))' for m in lengths)}))")
    each = texts.select("h", "w", F.explode(places).alias("x")).select("h", "x.i", "x.m", F.expr("array_join(slice(w, x.i + 1, x.m), ' ')").alias("gram"))
    found = each.join(grams, ["gram", "m"]).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("i", "m", "items"))).alias("hits"))
    return keyed.join(found, "h", "left").select("row", F.size("w").alias("n"), F.coalesce("hits", F.expr(NO_HITS)).alias("hits"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_rows: int = SET_ROWS, set_bytes: int = SET_BYTES) -> DataFrame:
    """(row, n, hits): the columns of `docs` as one struct, how many words its text has, and where windows of the benchmark begin in it.

    Hits are sorted structs (i: place of the first word, m: words, items).
    """
    grams = windows(benchmark, window)
    seen = grams.groupBy("m").agg(F.count("*").alias("n"), F.sum(F.octet_length("gram") + F.expr("aggregate(items, 0L, (s, x) -> s + octet_length(x) + 16)")).alias("bytes")).collect()  # `window` rows at most
    lengths, count, size = sorted(r["m"] for r in seen), sum(r["n"] for r in seen), sum(r["bytes"] for r in seen)
    rows = docs.select(F.struct(*docs.columns).alias("row"), words("text").alias("w"))
    if not lengths:
        return rows.select("row", F.size("w").alias("n"), F.expr(NO_HITS).alias("hits"))
    return _hits_by_set(rows, grams, lengths, count) if count <= set_rows and size <= set_bytes else _hits_by_join(rows, grams, lengths)


def _covered() -> Column:
    """Words inside any hit: hits are sorted, so a running end suffices."""
    return F.expr("""aggregate(hits, struct(0L AS n, 0 AS end),
        (s, x) -> struct(s.n + greatest(0, x.i + x.m - greatest(s.end, x.i)) AS n, greatest(s.end, x.i + x.m) AS end), s -> s.n)""")


def _judged(found: DataFrame) -> DataFrame:
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    out = found.select("row", F.col("n").cast("long").alias("n_words"), _covered().alias("n_hit"), items.alias("items"))
    return out.select("*", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **bounds: int) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items (sorted as strings), items_sha256 of their comma-joined list, and contaminated."""
    own = [c for c in docs.columns if c.lower() not in COUNTS]
    return _judged(find(docs, benchmark, window, **bounds)).select(*(F.col("row")[c].alias(c) for c in own), *COUNTS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents", **bounds: int) -> DataFrame:
    """`docs` without what the benchmark holds.

    remove="documents" drops each document with a hit; remove="spans" takes the hit words out of its text,
    each with the characters between it and the word before, and leaves the others as they are.
    """
    found = find(docs, benchmark, window, **bounds)
    if remove == "documents":
        return found.filter("size(hits) = 0").select("row.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    text = F.col("row")["text"]
    parts = found.withColumn("parts", F.regexp_extract_all(text, F.lit(f"[{OTHER_RAW}]*[^{OTHER_RAW}]+"), F.lit(0))).withColumn("tail", F.regexp_extract(text, f"[{OTHER_RAW}]*$", 0))
    hit = F.flatten(F.transform("hits", lambda x: F.sequence(x["i"], x["i"] + x["m"] - 1)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.col("n") - 1), hit), lambda k: F.get("parts", k))
    cleaned = F.when(F.size("hits") == 0, text).otherwise(F.concat(F.array_join(kept, ""), "tail"))
    return parts.select(*(cleaned.alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in docs.columns))
