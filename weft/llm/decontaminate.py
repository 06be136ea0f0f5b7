"""Benchmark decontamination: a prefix-filtered set join in DataFrame functions only.

Words are what stands between matches of BETWEEN in the A-Z lower-cased text. An item's windows are its runs of WINDOW words; an item of fewer
words, but not none, is one window. A document contains a window if all of its words stand there in a row, so under any
word order one word of it, the rarest, is a necessary prefix. Rarity is counted over all documents. The join goes by this
word alone; the length of the document and the word's position bound the window's place, and the words there are compared
whole.

A bit table of fixed size finds candidate words before any row is made, so documents shed all other words at the scan.
The windows are broadcast up to BROADCAST_WINDOWS of them with BROADCAST_BYTES of words, beyond that they are shuffled to the
candidates.

Null and blank texts have no words and no hits; items without an id or words have no windows. Rows equal in id and text
get one row each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name, lookup

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 8
BITS = 1 << 18
BROADCAST_WINDOWS, BROADCAST_BYTES = 100_000, 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN), "")


def _at(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BITS)).cast("int")


def _table(rows: DataFrame, column: str) -> Column | None:
    """A literal of BITS bits, 64 to a long, with those of the words in rows set; None without rows."""
    at = _at(F.col(column))
    longs = rows.select((at / 64).cast("int").alias("i"), F.expr("1L").alias("one"), (at % 64).alias("s")).select("i", F.expr("shiftleft(one, s)").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    held = {r.i: r.b for r in longs.collect()}  # BITS / 64 rows at most
    return F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(BITS // 64))), ",").cast("array<bigint>") if held else None


def _in_table(word: Column, table: Column) -> Column:
    at = _at(word)
    return F.get(table, (at / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at % 64)) != 0


def windows_of(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """One row for each distinct window (win, array of words), with the ids of its items as sorted strings."""
    words = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    each = words.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(w) - {window - 1})), i -> slice(w, i, {window}))")).alias("win"))
    return each.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _counts(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n) of the vocabulary's words over all documents."""
    table = _table(vocabulary, "word")
    found = words.select(F.explode(F.filter("w", lambda x: _in_table(x, table))).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _anchored(windows: DataFrame, words: DataFrame) -> DataFrame:
    """Each window with its rarest word (the first of equals by word) and that word's first place in it. Words are looked up
    by hash: a clash makes a word seem less rare, which any word of the window may be."""
    each = windows.select("win", "items", F.posexplode("win").alias("offset", "word"))
    vocabulary = checkpoint(each.groupBy("word").agg(F.count(F.lit(1)).alias("m")))
    known = vocabulary.join(_counts(words, vocabulary.select("word")), "word", "left")
    by_hash = known.groupBy(F.xxhash64("word").alias("key")).agg(F.sum("m").alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    counted = lookup(each.withColumn("key", F.xxhash64("word")), by_hash, "key", "m", F.struct("win", "offset"))
    ranked = counted.select("win", "items", F.struct("n", "word", "offset").alias("x"))
    return ranked.groupBy("win").agg(F.first("items").alias("items"), F.min("x").alias("x")).select(F.col("x.word").alias("anchor"), F.col("x.offset").alias("offset"), F.size("win").alias("len"), "win", "items")


def contained(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs(doc_id, text) against
    benchmark(item_id, text)."""
    return _contained(docs, benchmark, window).drop("whole")


def _contained(docs: DataFrame, benchmark: DataFrame, window: int, *more: str) -> DataFrame:
    """The columns of contained, and whole: whether a window of that many words is there; more: th, the text's hash."""
    spark = docs.sparkSession
    words = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("w"))
    windows = checkpoint(windows_of(benchmark, "item_id", "text", window))
    no_match = F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("array<string>").alias("near"))
    if windows.isEmpty():
        anchors, found = None, F.array(no_match)
    else:
        anchors = checkpoint(_anchored(windows, words.select("w")))
        table = _table(anchors.select("anchor").distinct(), "anchor")
        places = F.filter(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>")), lambda i: _in_table(F.get(F.col("w"), i), table))
        first = lambda i: F.greatest(i - (window - 1), F.lit(0))
        near = F.transform(places, lambda i: F.struct(i.alias("i"), F.get(F.col("w"), i).alias("word"), F.slice(F.col("w"), first(i) + 1, F.lit(2 * window - 1)).alias("near")))
        found = F.concat(F.array(no_match), near)
    rows = words.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), F.explode(found).alias("x")).select("doc_id", "th", "n_words", "x.i", "x.word", "x.near")
    if anchors is None:
        matched = rows.select("doc_id", "th", "n_words", "i", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("items"))
    else:
        held = anchors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("items", " "))).alias("bytes")).first()
        side = F.broadcast(anchors) if held.n <= BROADCAST_WINDOWS and held["bytes"] <= BROADCAST_BYTES else anchors
        at = F.col("i") - F.col("offset")
        start = at - F.greatest(F.col("i") - (window - 1), F.lit(0))
        whole = (F.col("word") == F.col("anchor")) & (at >= 0) & (at + F.col("len") <= F.col("n_words")) & (F.slice("near", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win"))
        matched = rows.join(side, whole, "left").filter(F.col("anchor").isNotNull() | (F.col("i") < 0)).select("doc_id", "th", "n_words", "i", F.when(F.col("anchor").isNotNull(), at).alias("at"), "len", "items")
    grouped = matched.groupBy("doc_id", "th", "n_words").agg(
        F.sum(F.when(F.col("i") < 0, 1).otherwise(0)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", (F.col("at") + F.col("len")).alias("to"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.coalesce(F.max(F.col("len") >= window), F.lit(False)).alias("whole"),
    )
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["to"], s["to"]).alias("to"), (a["n"] + F.greatest(s["to"] - F.greatest(a["to"], s["at"]), F.lit(0))).cast("long").alias("n")),
        lambda a: a["n"],
    )
    return grouped.select(
        "doc_id", *more, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"), "whole",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs with no whole window of WINDOW words of any item and windows of less than two items, with their
    columns. Hits on short items alone, which chance can make, don't condemn a document unless there are two. Each text
    counts by itself: of rows that share an id, or have none, those with another text stay."""
    id_, th_ = free_name(docs, "id_"), free_name(docs, "th_")
    gone = _contained(docs, benchmark, WINDOW, "th").filter(F.col("contaminated") | F.col("whole")).select(F.col("doc_id").alias(id_), F.col("th").alias(th_)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(th_)), "left_anti")
