"""Substring dedup over sliding runs of sentences.

A text is words between ASCII white space. A sentence ends after a word that ends in . ! or ? (a quote or bracket may
follow), and at a line end; a sentence of more than LONG words is cut after the word of least hash of every CUT words in a
row, so equal passages are cut alike wherever they stand, but for CUT words at either end. From every sentence, the run of RUN consecutive sentences, and on to RUN_WORDS words where
these are short, is hashed (by its words, A-Z lower-cased) and joined globally. Its first place is the least (doc_id, hash of the text, position),
null ids first; sentences that it covers at any other place go, in another document or in the same one (within), where the
runs that go cover least_words words at least in a row. Without within, a run counts as repeated only if two documents have
it.

A passage may begin and end within sentences that are cut in one document and too short to be cut in the other, so the runs
may cover less of it than SPAN_WORDS words. Therefore spans of SPAN_WORDS words wherever they begin, of every SPAN_WORDS + 1
in a row the one of least hash, are joined as well, and the words of repeated ones count as words in a row. So every passage of
more than 2 * SPAN_WORDS words that two documents have loses the sentences that runs cover, whatever stands around it.

The kept sentences keep their exact text: a text with no removed sentence is unchanged. Rows equal in doc_id and text are
one document and share one result. Null and empty texts stay as they are. Other columns pass through.

Every run's row is read twice: once for the first places, summed before they are shuffled, and once for the join, where a
bit table of the repeated hashes, of bounded size, lets only likely repeats through. A run that a third of all documents
share is one row on the side of the first places, and its rows on the other side are dealt anew by the skewed join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import Bloom
from .common import bounded_batches, checkpoint, free_name, mixed, powers, text_bytes, words_at

#: Sentences and least words of a run, least words of what goes, words of a sentence that is cut and of how many words in a row one cuts it.
RUN, RUN_WORDS, SPAN_WORDS, LONG, CUT = 2, 6, 25, 16, 8
_CLOSE, _STOP = (np.isin(np.arange(256), list(x)) for x in (b"\"')]", b".!?"))


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Place of the least of each size entries in a row, the first of equals."""
    at, reach = np.arange(len(x)), 1
    while reach < size:
        step = min(reach, size - reach)
        a, b = at[:-step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        reach += step
    return at


def _covered(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie from an a to its b (not included)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return np.cumsum(edge[:-1]) > 0


class Sentences:
    """The sentences of a text: first byte and words of each, and the hashes of its words."""

    def __init__(self, raw: bytes):
        self.raw = raw
        start, end, self.hashes = words_at(raw)
        self.sums = None
        n = len(start)
        if not n:
            self.first = self.words = np.empty(0, np.int64)
            self.offsets = np.empty(0, np.int64)
            return
        b = np.frombuffer(raw, np.uint8)
        last = b[end - 1]
        last = np.where(_CLOSE[last] & (end - start > 1), b[end - 2], last)
        lines = np.cumsum(b == 10)
        done = _STOP[last]
        done[:-1] |= lines[start[1:]] > lines[end[:-1] - 1]
        done[-1] = True
        stops = np.flatnonzero(done)
        size = np.diff(np.r_[-1, stops])
        if size.max() > LONG:
            at, own = _least(self.hashes, CUT), np.repeat(np.arange(len(size)), size)
            done[at[(own[: len(at)] == own[CUT - 1 :]) & (size > LONG)[own[: len(at)]]]] = True
            stops = np.flatnonzero(done)
        self.first = np.r_[0, stops[:-1] + 1]  # first word of each sentence
        self.words = np.diff(np.r_[self.first, n])
        self.offsets = start[self.first]
        self.offsets[0] = 0

    def ends(self) -> np.ndarray:
        """End (not included) of the run from each sentence that has one. A text that is shorter than a run is one."""
        m = len(self.words)
        if not m:
            return np.empty(0, np.int64)
        total = np.r_[0, np.cumsum(self.words)]
        ends = np.maximum(np.arange(m) + RUN, np.searchsorted(total, total[:-1] + RUN_WORDS))
        ends = ends[ends <= m]
        return ends if len(ends) else np.array([m])

    def _hashed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from a to b (not included)."""
        n = len(self.hashes)
        if self.sums is None:
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hashes * powers(True, n), out=self.sums[1:])
        return mixed((self.sums[b] - self.sums[a]) * powers(False, n)[a])

    def runs(self) -> np.ndarray:
        """Hash of the run from each sentence that has one."""
        ends = self.ends()
        n = len(self.hashes)
        if not n:
            return np.empty(0, np.int64)
        a, b = self.first[: len(ends)], np.r_[self.first, n][ends]
        return mixed(self._hashed(a, b) + (b - a).astype(np.uint64)).view(np.int64)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the least spans of SPAN_WORDS words: one at least of every SPAN_WORDS + 1 in a row."""
        a = np.arange(len(self.hashes) - SPAN_WORDS + 1)
        if len(a) <= SPAN_WORDS:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = mixed(self._hashed(a, a + SPAN_WORDS) + np.uint64(1 << 32))  # no run has this length
        at = _least(h, SPAN_WORDS + 1)
        at = at[np.r_[True, at[1:] != at[:-1]]]
        # Equal spans close together, of words that repeat: the first and the last of each dozen places do.
        key = np.flatnonzero(np.r_[True, (h[at[1:]] != h[at[:-1]]) | (at[1:] // 12 != at[:-1] // 12)])
        at = at[np.union1d(key, np.r_[key[1:], len(at)] - 1)]
        return at, h[at].view(np.int64)

    def without(self, starts, least_words: int = SPAN_WORDS) -> tuple[bytes, int]:
        """The text less the sentences that runs at these starts cover, where these and spans cover least_words words in a
        row, and the number of sentences that went. A start below 0 is that of a span, -1 for the first word."""
        m, n, ends = len(self.words), len(self.hashes), self.ends()
        starts = np.asarray(starts, np.int64)
        spans, starts = -1 - starts[starts < 0], starts[starts >= 0]
        covered, first = _covered(starts, ends[starts], m), np.r_[self.first, n]
        held = _covered(np.r_[first[starts], spans], np.r_[first[ends[starts]], spans + SPAN_WORDS], n)
        size = np.diff(np.r_[np.flatnonzero(np.r_[True, held[1:] != held[:-1]]), n])
        wide = np.repeat(size >= least_words, size)
        turn = np.flatnonzero(np.r_[True, covered[1:] != covered[:-1]])
        kept, gone = [], 0
        offsets = np.r_[self.offsets, len(self.raw)]
        for i, j in zip(turn.tolist(), [*turn[1:].tolist(), m]):
            if covered[i] and wide[first[i]]:
                gone += j - i
            else:
                kept.append(self.raw[offsets[i] : offsets[j]])
        return b"".join(kept), gone


def _run_rows(ids: Bloom, bloom=None):
    """h, doc_id, th and pos of the runs and spans, all or those that a bit table may hold. Of all, th is null where ids does
    not hold the document's id."""

    def run(batches):
        for batch in batches:
            hashes, rows, at = [], [], []
            for i, raw in enumerate(text_bytes(batch.column("text"))):
                if raw:
                    s = Sentences(raw)
                    h, (first, g) = s.runs(), s.spans()
                    p, h = np.r_[np.arange(len(h)), -1 - first].astype(np.int32), np.r_[h, g]
                    if bloom is not None:
                        may = bloom.may_hold(h)
                        p, h = p[may], h[may]
                    hashes.append(h)
                    at.append(p)
                    rows.append(np.full(len(p), i))
            if hashes:
                take, th = pa.array(np.concatenate(rows)), batch.column("th")
                if bloom is None:
                    th = pa.array(th.to_numpy(), mask=~ids.may_hold(batch.column("ih").to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), batch.column("doc_id").take(take), th.take(take), pa.array(np.concatenate(at))], ["h", "doc_id", "th", "pos"])

    return run


def repeated_runs(docs: DataFrame, within: bool = False) -> DataFrame:
    """(doc_id, th, pos) of every run and span of docs(doc_id, th, text), in two documents at least or (within) at two places,
    that is not the first; pos is that of Sentences.without. Only ids that several rows have need th for the first places, so
    others shed it there. Repeated rows count as places here, but all of them are the first."""
    docs = docs.withColumn("ih", F.xxhash64("doc_id"))
    shared = Bloom.of(checkpoint(docs.groupBy("ih").count().filter("count > 1").select("ih")), "ih")
    schema = f"h long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, pos int"
    more = F.count(F.lit(1)) if within else F.max(F.struct("doc_id", "th"))
    ends = docs.mapInArrow(_run_rows(shared), schema).groupBy("h").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), more.alias("more"))
    several = F.col("more") > 1 if within else ~F.struct("first.doc_id", "first.th").eqNullSafe(F.col("more"))
    first = checkpoint(ends.filter(several).select(F.col("h").alias("rh"), "first"))
    found = docs.mapInArrow(_run_rows(shared, Bloom.of(first, "rh")), schema)
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")) & F.coalesce(F.col("th") == F.col("first.th"), F.lit(True))
    return found.join(first, F.col("h") == F.col("rh")).filter(~is_first).select("doc_id", "th", "pos")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", within: bool = False, least_words: int = SPAN_WORDS) -> DataFrame:
    """The rows of docs with repeated spans cut from the text, and n_sentences and n_removed (with _ after them where docs
    has columns of these names). within: repeats inside one document go as well. least_words: of what goes in a row; at 0
    the sentences of every repeated run go, however short."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    id_, th, starts_ = (free_name(docs, c) for c in ("id_", "th_", "starts_"))
    marks = repeated_runs(keyed, within).groupBy("doc_id", "th").agg(F.collect_set("pos").alias(starts_)).select(F.col("doc_id").alias(id_), F.col("th").alias(th), starts_)
    joined = docs.join(marks, F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(th)), "left").select(*docs.columns, starts_)
    at, names = docs.columns.index(text), docs.columns
    own = [free_name(docs, c) for c in ("n_sentences", "n_removed")]

    def run(batches):
        for batch in batches:
            texts, sizes, gone = [], [], []
            for raw, starts in zip(text_bytes(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist()):
                s = Sentences(raw) if raw else None
                g = 0
                if s and starts:
                    raw, g = s.without(starts, least_words)
                texts.append(raw)
                sizes.append(len(s.words) if s else 0)
                gone.append(g)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], [*names, *own])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(name, T.LongType()) for name in own)]))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeated spans, within documents too, cut from text and the columns docs has; n_chars, if there,
    follows the text."""
    cut = remove_repeats(docs, within=True)
    changed = cut.columns[-1]
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(changed) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)
