"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Its tokens and its sections are intervals of its UTF-8 bytes; an interval join gives each
token to the section that holds most of its bytes, and to the earlier one of equals. So the counts of a document's
sections sum to the count of the whole. Sections are lines (count_tokens): each ends with its line end, the last one with the
text; or fields (count_fields): the texts of several columns, joined and encoded as one document, what joins two of them
belonging to the first.

Null and empty texts have no lines and give one row with section 0 and no tokens; a null field is an empty one, and has a row.
Repeated rows each give their rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec_of
from .common import bounded_batches

_LINE = re.compile(rb"[^\n]*\n|[^\n]+")


def attribute(ends: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Tokens by section, from the ends of consecutive tokens and of consecutive sections, both over the same bytes."""
    starts = np.r_[0, ends[:-1]]
    first = np.searchsorted(cuts, starts, "right")  # section of the first byte
    last = np.searchsorted(cuts, ends - 1, "right")
    own = first.copy()
    for i in np.flatnonzero(first != last):  # tokens over a boundary
        edges = np.r_[starts[i], cuts[first[i] : last[i]], ends[i]]
        own[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(own, minlength=len(cuts))


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, section, start and end (bytes), n_tokens and doc_tokens: a row for each section of docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = codec_of(shared.value, pattern)
        size_of = np.fromiter(map(len, codec.bytes_of), np.int64, len(codec.bytes_of))
        for batch in batches:
            take, columns = [], [[], [], [], [], []]
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = text.encode() if text else b""
                cuts = np.fromiter((m.end() for m in _LINE.finditer(raw)), np.int64) if raw else np.zeros(1, np.int64)
                ends = np.cumsum(size_of[np.frombuffer(codec.encode(text), "<u4")]) if raw else np.empty(0, np.int64)
                counts = attribute(ends, cuts) if len(ends) else np.zeros(1, np.int64)
                k = len(cuts)
                take.append(np.full(k, i))
                for column, x in zip(columns, (np.arange(k), np.r_[0, cuts[:-1]], cuts, counts, np.full(k, len(ends)))):
                    column.append(x)
            if take:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(take))), *(pa.array(np.concatenate(c)) for c in columns)], ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, section long, start long, end long, n_tokens long, doc_tokens long")


def count_fields(docs: DataFrame, fields: list[str], ranks_path: str, pattern: str, between: str = "\n") -> DataFrame:
    """doc_id, field, start and end (bytes of the joined text), n_tokens and doc_tokens: a row for each of the fields, text
    columns of docs(doc_id, ...)."""
    bounded_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = codec_of(shared.value, pattern)
        size_of = np.fromiter(map(len, codec.bytes_of), np.int64, len(codec.bytes_of))
        for batch in batches:
            rows = []
            for doc, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                texts = [(t or "") + (between if i < len(fields) - 1 else "") for i, t in enumerate(texts)]
                cuts, whole = np.cumsum([len(t.encode()) for t in texts]), "".join(texts)
                ends = np.cumsum(size_of[np.frombuffer(codec.encode(whole), "<u4")]) if whole else np.empty(0, np.int64)
                counts = attribute(ends, cuts) if len(ends) else np.zeros(len(fields), np.int64)
                rows += zip([doc] * len(fields), fields, [0, *cuts[:-1].tolist()], cuts.tolist(), counts.tolist(), [len(ends)] * len(fields))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (batch.schema.types[0], pa.string(), *[pa.int64()] * 4))], ["doc_id", "field", "start", "end", "n_tokens", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *[F.col(c) for c in fields]).mapInArrow(run, f"doc_id {kind}, field string, start long, end long, n_tokens long, doc_tokens long")
