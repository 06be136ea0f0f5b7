"""Lempel-Ziv phrase fingerprints.

A text is parsed, code point by code point, into the shortest phrases that its dictionary does not hold yet; each joins the
dictionary. The fingerprint is the minimum-hash signature of the phrase set: its KEPT smallest hashes (all of a smaller
set), as hex. The likeness of two fingerprints estimates the Jaccard similarity of the phrase sets from the KEPT smallest
hashes of both together; two texts without phrases are alike.

The parse of an edited text goes on from the phrases that lie before the edit. Each document also meets its neighbour in
descending order of doc_id: rows are dealt into ranges of ids and sorted, and only the first row of a range also travels
to the range before it. Null texts count as empty, null ids stand last, equal ids stand in the order of a hash of the
text; the last row's neighbour is the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounds_of, bucket_of, parallelism

KEPT = 64
RANGE_ROWS = 100_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _powers(n: int, base: int, held: dict = {}) -> np.ndarray:  # noqa: B006
    got = held.get(base)
    if got is None or len(got) < n:
        size = 1 << max(16, n.bit_length())
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = held[base] = np.multiply.accumulate(got)
    return got[:n]


def parse(text: str, start: int = 0, known: set | None = None) -> list[int]:
    """Ends of the phrases of text from start on. Every prefix of a phrase is one, so the longest known match is found by
    its length. The last phrase may be known."""
    held = set() if known is None else known
    ends, n, guess = [], len(text), 1
    while start < n:
        at = start + guess
        if text[start:at] in held:
            at += 1
            while at <= n and text[start:at] in held:
                at += 1
        else:
            while at - 1 > start and text[start : at - 1] not in held:
                at -= 1
        at = min(at, n)
        held.add(text[start:at])
        ends.append(at)
        guess = max(1, at - start - 1)
        start = at
    return ends


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The KEPT smallest hashes of the phrases."""
    if not ends:
        return np.empty(0, np.uint32)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    c = (c + _U(0x51ED27)) * _U(0xD6E8FEB86659FD93)
    c ^= c >> _U(32)
    sums = np.empty(len(c) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(c * _powers(len(c), _BASE), out=sums[1:])
    end = np.array(ends)
    start = np.r_[0, end[:-1]]
    h = (sums[end] - sums[start]) * _powers(len(c) + 1, _BACK)[start]
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    h = (h >> _U(32)).astype(np.uint32)
    if len(h) > 4 * KEPT:
        h = np.partition(h, 3 * KEPT)[: 3 * KEPT] if len(np.unique(np.partition(h, 3 * KEPT)[: 3 * KEPT])) >= KEPT else h
    return np.unique(h)[:KEPT]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:KEPT] if len(a) >= KEPT or len(b) >= KEPT else np.union1d(a, b)
    return float(np.isin(both, a, assume_unique=True).__and__(np.isin(both, b, assume_unique=True)).sum() / len(both))


def text_form(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def edited(text: str, other: str) -> tuple[str, int]:
    """The text with its last third replaced by the start of the other, and where the edit starts."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third], len(text) - third


def of_edited(text: str, ends: list[int], new: str, cut: int) -> np.ndarray:
    """Signature of new, which has the first cut code points of text."""
    k = int(np.searchsorted(ends, cut, "right")) if ends else 0
    if k and k == len(ends):
        k -= 1  # the last phrase ended with the text
    known = {text[a:b] for a, b in zip([0, *ends[:k]], ends[:k])}
    return signature(new, [*ends[:k], *parse(new, ends[k - 1] if k else 0, known)])


def _printed(batches):
    """Rows in descending order; a ghost at the end of a range is the neighbour of the range's last row."""
    held = None  # id, text, phrase ends, signature
    for batch in batches:
        out = []
        for doc, text, ghost in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ghost"))):
            if ghost and held is None:
                continue
            if held is not None and held[1] == text:
                ends, s = held[2], held[3]
            else:
                ends = parse(text)
                s = signature(text, ends)
            if held is not None:
                new, cut = edited(held[1], text)
                e = of_edited(held[1], held[2], new, cut) if new != held[1] else held[3]
                out.append((held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), text_form(held[3]), text_form(e), likeness(held[3], e), likeness(held[3], s)))
            held = None if ghost else (doc, text, ends, s)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], _NAMES)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of
    docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("tie", F.xxhash64("text"))
    rows = docs.count()
    parts = max(parallelism(docs.sparkSession), rows // RANGE_ROWS)
    keyed = keyed.withColumn("part", bucket_of(F.col("key"), F.col("tie"), bounds_of(keyed.select("key"), "key", parts, rows)))
    tops = sorted((r.part, r.top.key, r.top.tie) for r in keyed.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("top")).collect())  # a row a range
    schema = "top_part int, top_key long, top_tie long, to int"
    targets = docs.sparkSession.createDataFrame([(p, k, t, tops[(i + 1) % len(tops)][0]) for i, (p, k, t) in enumerate(tops)], schema)
    joined = keyed.join(F.broadcast(targets), F.col("part") == F.col("top_part"))
    is_top = (F.col("key") == F.col("top_key")) & (F.col("tie") == F.col("top_tie"))
    own, ghost = F.struct(F.col("part").alias("part"), F.lit(0).alias("ghost")), F.struct(F.col("to").alias("part"), F.lit(1).alias("ghost"))
    dealt = joined.select("doc_id", "text", "key", "tie", F.explode(F.when(is_top, F.array(own, ghost)).otherwise(F.array(own))).alias("x")).select("doc_id", "text", "key", "tie", "x.part", "x.ghost")
    ranged = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("ghost", F.desc("key"), F.desc("tie"))
    return ranged.select("doc_id", "text", "ghost").mapInArrow(_printed, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
