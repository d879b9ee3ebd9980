"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``SPAN - GRAM + 1`` consecutive hashes of ``GRAM`` words the smallest is a fingerprint, so two
texts that share ``SPAN`` words share a fingerprint of that passage. The fingerprints of documents and
benchmark are joined, and each hit is extended to the windows around it, which are compared as text.

Arrays are unrolled with ``explode_outer``: for ``explode`` the optimizer adds a filter on the array's size
and pushes it down, which repeats the array's whole expression once more for every step it was made in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import ascii_lower, row_key

SPAN = 13
GRAM = 6
BROADCAST_PRINTS = 1 << 20


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a null text has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def window_at(words: Column, start: Column, length: int) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def positions(count: Column) -> Column:
    """0 .. count - 1, empty for a count below one."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def chained(hashes: Column, steps: tuple[int, ...]) -> Column:
    """At each place, the hash of the elements that many places ahead; those past the end count as null."""
    return F.transform(hashes, lambda _, i: F.xxhash64(*(F.get(hashes, i + s) for s in steps)))


def smallest(values: Column, steps: tuple[int, ...]) -> Column:
    return F.transform(values, lambda _, i: F.least(*(F.get(values, i + s) for s in steps)))


def head(values: Column, drop: int) -> Column:
    """All but the last ``drop`` elements."""
    return F.slice(values, 1, F.greatest(F.lit(0), F.size(values) - drop))


def with_grams(df: DataFrame, length: int) -> DataFrame:
    """Adds ``grams``, the hash of every run of words, and ``prints``, those that are fingerprints.

    Runs of ``GRAM`` words are hashed as three pairs, and the minima of ``SPAN - GRAM + 1`` hashes are
    taken from minima of four. Short windows are hashed whole and all of them are fingerprints.
    """
    df = df.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    if length < SPAN:
        runs = F.transform(
            positions(F.size("word_hashes") - (length - 1)), lambda i: F.xxhash64(F.slice("word_hashes", i + 1, length))
        )
        return df.withColumn("grams", runs).withColumn("prints", F.array_distinct("grams"))
    df = df.withColumn("pairs", chained(F.col("word_hashes"), (0, 1)))
    df = df.withColumn("grams", head(chained(F.col("pairs"), (0, 2, 4)), GRAM - 1))
    df = df.withColumn("fours", smallest(F.col("grams"), (0, 1, 2, 3)))
    df = df.withColumn("minima", head(smallest(F.col("fours"), (0, 4)), SPAN - GRAM))
    return df.withColumn("prints", F.array_distinct("minima")).drop("word_hashes", "pairs", "fours", "minima")


def with_hits(grams: DataFrame, prints: DataFrame, broadcast_prints: int) -> DataFrame:
    """(doc_id, row_key, words, grams, fingerprint) of the fingerprints that the benchmark has as well.

    Up to ``broadcast_prints`` benchmark fingerprints, counted, the document's own row is tested against a
    broadcast set, so no text moves. Beyond that the fingerprints are shuffled without the texts, and the
    documents with a hit are joined back.
    """
    if prints.count() <= broadcast_prints:
        exploded = grams.withColumn("fingerprint", F.explode_outer("prints"))
        return exploded.join(F.broadcast(prints), "fingerprint", "left_semi")
    slim = grams.select("doc_id", "row_key", F.explode_outer("prints").alias("fingerprint"))
    found = slim.join(prints, "fingerprint", "left_semi").select(
        F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"), "fingerprint"
    )
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key"))
    return grams.join(found, same).drop("hit_id", "hit_key")


def hit_windows(documents: DataFrame, items: DataFrame, length: int, broadcast_prints: int) -> DataFrame:
    """(doc_id, row_key, start, length, window) of the windows around every common fingerprint.

    ``documents`` and ``items`` carry ``words``; ``items`` are those whose windows have this length.
    """
    prints = with_grams(items, length).select(F.explode_outer("prints").alias("fingerprint"))
    prints = prints.distinct().filter(F.col("fingerprint").isNotNull())
    hits = with_hits(with_grams(documents, length), prints, broadcast_prints)
    # A window of the span around a hit begins at most this many words before it.
    reach = SPAN - GRAM if length == SPAN else 0
    places = F.filter(
        F.transform("grams", lambda g, i: F.when(g == F.col("fingerprint"), i)), lambda i: i.isNotNull()
    )
    starts = F.flatten(
        F.transform(
            places,
            lambda p: F.when(
                F.least(p, F.size("words") - length) >= F.greatest(F.lit(0), p - reach),
                F.sequence(F.greatest(F.lit(0), p - reach), F.least(p, F.size("words") - length)),
            ).otherwise(F.array().cast("array<int>")),
        )
    )
    return (
        hits.select("doc_id", "row_key", "words", F.explode_outer(F.array_distinct(starts)).alias("start"))
        .select(
            "doc_id",
            "row_key",
            "start",
            F.lit(length).alias("length"),
            window_at(F.col("words"), F.col("start"), length).alias("window"),
        )
        .distinct()
    )


def item_windows(items: DataFrame, length: int) -> DataFrame:
    """(window, items): every distinct window of that many words with the sorted ids of the items that have it."""
    starts = positions(F.size("words") - (length - 1))
    return (
        items.select("item_id", "words", F.explode_outer(starts).alias("start"))
        .select("item_id", window_at(F.col("words"), F.col("start"), length).alias("window"))
        .groupBy("window")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )


def covered(intervals: Column) -> Column:
    """Number of positions inside any of the sorted (start, length) intervals."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def step(state: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        added = F.greatest(F.lit(0), end - F.greatest(state["end"], x["start"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["total"] + added).alias("total"))

    return F.aggregate(intervals, begin, step, lambda s: s["total"])


def contamination(
    documents: DataFrame, benchmark: DataFrame, broadcast_prints: int = BROADCAST_PRINTS
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the item ids.

    A window is ``SPAN`` consecutive words of an item; an item of fewer words is one window. A null or
    empty text has no words and is clean, as is everything when the benchmark is empty; items without
    words are ignored and a null item id counts as no item. Every input row gives one row; rows of one
    id with different texts are judged apart. Columns other than doc_id, text and item_id, text are
    not looked at.
    """
    docs = documents.select("doc_id", row_key().alias("row_key"), words_of(F.col("text")).alias("words"))
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(
        (F.size("words") > 0) & F.col("item_id").isNotNull()
    )
    window = F.least(F.size("words"), F.lit(SPAN))
    lengths = sorted(r[0] for r in items.select(window).distinct().collect())  # at most SPAN values
    found = [
        hit_windows(docs, own := items.filter(window == n), n, broadcast_prints).join(item_windows(own, n), "window")
        for n in lengths
    ]
    slim = docs.select("doc_id", "row_key", F.size("words").cast("long").alias("n_words"))
    if not found:
        none = F.array().cast("array<string>")
        return judged(slim.withColumns({"n_hit": F.lit(0).cast("long"), "items": none}))
    hits = (
        reduce(DataFrame.unionByName, found)
        .groupBy(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"))
        .agg(
            covered(F.array_sort(F.collect_list(F.struct("start", "length")))).alias("n_hit"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
    )
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key"))
    return judged(
        slim.join(hits, same, "left").select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def judged(counts: DataFrame) -> DataFrame:
    items = F.array_sort("items")
    return counts.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        items.alias("item_ids"),
    )
