"""Exact n-gram Jaccard self-join with set-relation skipping, and its connected components.

A document's set holds the hashes of its distinct word 5-shingles (A-Z lower-cased, words between ASCII white space);
a text of fewer words is one shingle, a text without words has the empty set and links with nothing.

The join follows set relations at three levels:

* equal sets are one node from the start, so copies never meet;
* index lists (token -> sets, over the prefix that a threshold requires, rarest tokens first) are cut into blocks by set
  size; blocks whose sizes cannot reach the threshold are skipped, and positions bound what is left; a list of more than
  LIST_MOST sets is dealt over several tasks, each of which gets the list's hub too;
* every list has a hub. Members are verified against the hub alone, which gives their difference to it too. The answers of a
  member are then derived from the hub's: members of one component are skipped, and the overlap of others follows from
  their differences, without their sets. Only pairs that no common hub decides are verified.

Token order only decides the work, never the result. The table of frequent tokens that sets the order is bounded by
HOT_TOKENS; all other tokens count as rare. No list, candidate or partner is ever dropped.

Defined cases: null and blank texts have n_shingles 0 and are their own component; a null doc_id never is the smallest
of a component unless all its members' ids are null; repeated rows are members of one node; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .common import bounded_batches, checkpoint, free_name, lookup, mixed, parallelism, signed, text_bytes, word_hashes
from .components import components

WORDS = 5
NUM, DEN = 75, 100
HOT_TOKENS = 1 << 21  # entries of the order table
HOT_LEAST = 8  # sets that share a token before it counts as frequent
POSTINGS = 1 << 19  # index entries that a task holds before it packs them
MOST_BITS = 20  # at most so many bits of a token choose its bucket
LIST_MOST = 1 << 18  # sets in an index list, about; longer lists are split
MOST_EXTRA = 1 << 15  # buckets for the parts of split lists
BLOCK = 256  # sets in a block of an index list
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_U = np.uint64


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingles(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    w = word_hashes(text) if text else ()
    if not len(w):
        return np.empty(0, np.uint64)
    m = min(k, len(w))
    s = np.full(len(w) - m + 1, m, np.uint64)
    for i in range(m):
        s += w[i : len(w) - m + 1 + i] * _MUL[i]
    return distinct(mixed(s))


def set_id(s: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(s.tobytes()))


def prefix_length(n):
    """Tokens that must hold one in common with every similar set."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def linked(overlap, a, b):
    return DEN * overlap >= NUM * (a + b - overlap)


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1)


def _unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _sets(batches, seen: set):
    """(set id, sorted hashes) of each set that this task meets for the first time."""
    for batch in batches:
        for text in text_bytes(batch.column("text")):
            s = shingles(text)
            if len(s):
                k = set_id(s)
                if k not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(k)
                    yield k, s


def _identify(batches):
    for batch in batches:
        known: dict = {}
        ids, sizes = [], []
        for text in text_bytes(batch.column("text")):
            got = known.get(text)
            if got is None:
                s = shingles(text)
                got = known[text] = (set_id(s), len(s))
            ids.append(got[0])
            sizes.append(got[1])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "th", "set_id", "n"])


def _counted(bits: int):
    shift = 32 - bits

    def emit(tokens: list):
        values, counts = np.unique(np.concatenate(tokens), return_counts=True)
        cuts = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << _U(shift)) if bits else np.empty(0, np.int64)
        edges = [0, *cuts.tolist(), len(values)]
        rows = [(i, _pack(np.diff(values[a:b], prepend=np.uint32(0))), _pack(np.minimum(counts[a:b], 65535).astype(np.uint16))) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "v", "c"])

    def run(batches):
        held, n = [], 0
        for _, s in _sets(batches, set()):
            held.append((s >> _U(32)).astype(np.uint32))
            n += len(s)
            if n >= 4 * POSTINGS:
                yield emit(held)
                held, n = [], 0
        if held:
            yield emit(held)

    return run


def _frequent(most: int, least: int):
    def run(batches):
        values, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        for batch in batches:
            vs, cs = [values], [counts]
            for v, c in zip(batch.column("v").to_pylist(), batch.column("c").to_pylist()):
                vs.append(np.cumsum(_unpack(v, np.uint32), dtype=np.uint32))
                cs.append(_unpack(c, np.uint16).astype(np.int64))
            values, at = np.unique(np.concatenate(vs), return_inverse=True)
            counts = np.bincount(at, np.concatenate(cs), len(values)).astype(np.int64)
        keep = np.flatnonzero(counts >= least)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-counts[keep], kind="stable")[:most]])
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array([values[keep].tobytes()], pa.binary()), pa.array([np.minimum(counts[keep], 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["v", "c"])

    return run


class _Order:
    """Ranks tokens by how many sets share them, as far as the table of frequent tokens tells."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.counts = values, counts
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[values >> np.uint32(10)] = True

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The tokens to index, by ascending rank."""
        p = prefix_length(len(s))
        top = (s >> _U(32)).astype(np.uint32)
        some = np.flatnonzero(self.maybe[top >> np.uint32(10)])
        if not len(some):
            return s[:p]
        at = np.minimum(np.searchsorted(self.values, top[some]), len(self.values) - 1)
        hit = self.values[at] == top[some]
        if not hit.any():
            return s[:p]
        df = np.zeros(len(s), np.uint32)
        df[some[hit]] = self.counts[at[hit]]
        return s[np.argsort(df, kind="stable")[:p]]


class _Split:
    """Where the lists of tokens go that more than most sets share: each is dealt by set into parts, and the parts into
    extra buckets after the others."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, bits: int, most: int, extra: int):
        long = np.flatnonzero(counts > most)
        self.values, self.parts = values[long], (counts[long] // most + 1).astype(np.uint64)
        self.base, self.extra = 1 << bits, extra

    def parts_of(self, tokens: np.ndarray) -> np.ndarray:
        """Parts of each token's list; 0 of one that isn't split."""
        if not len(self.values):
            return np.zeros(len(tokens), np.uint64)
        top = (tokens >> _U(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.values, top), len(self.values) - 1)
        return np.where(self.values[at] == top, self.parts[at], _U(0))

    def bucket(self, tokens: np.ndarray, part: np.ndarray) -> np.ndarray:
        return self.base + ((mixed(tokens) + part) % _U(self.extra)).astype(np.int64)


_POSTED = "bucket int, token binary, local binary, pos binary, ids binary, sizes binary"


def _packed(bucket, tokens, owner, pos, ids, sizes):
    """A row for each bucket: its sorted tokens, the set and the position of each, and the sets."""
    by = np.lexsort((tokens, bucket))
    bucket, tokens, owner, pos = bucket[by], tokens[by], owner[by], pos[by]
    edges = [*_starts(bucket).tolist(), len(bucket)]
    out = []
    for a, b in zip(edges, edges[1:]):
        own, local = np.unique(owner[a:b], return_inverse=True)
        out.append((int(bucket[a]), _pack(np.diff(tokens[a:b], prepend=_U(0))), _pack(local.astype(np.uint32)), _pack(np.minimum(pos[a:b], 2**31).astype(np.uint32)), _pack(ids[own]), _pack(sizes[own].astype(np.uint32))))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 5))], ["bucket", "token", "local", "pos", "ids", "sizes"])


def _posted(order, bits: int, most: int, extra: int, held: int):
    """Packs the index entries of every set's prefix."""

    def emit(split, ids, sizes, prefixes):
        lengths = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
        tokens = np.concatenate(prefixes)
        owner = np.repeat(np.arange(len(ids)), lengths)
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids, sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
        bucket = (tokens >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
        parts = split.parts_of(tokens)
        long = np.flatnonzero(parts)
        if len(long):
            bucket[long] = split.bucket(tokens[long], mixed(ids[owner[long]].view(np.uint64)) % parts[long])
        return _packed(bucket, tokens, owner, pos, ids, sizes)

    def run(batches):
        table = _Order(*order.value) if len(order.value[0]) else None
        split = _Split(*order.value, bits, most, extra)
        ids, sizes, prefixes, n = [], [], [], 0
        for k, s in _sets(batches, set()):
            p = table.prefix(s) if table else s[: prefix_length(len(s))]
            ids.append(k)
            sizes.append(len(s))
            prefixes.append(p)
            n += len(p)
            if n >= held:
                yield emit(split, ids, sizes, prefixes)
                ids, sizes, prefixes, n = [], [], [], 0
        if ids:
            yield emit(split, ids, sizes, prefixes)

    return run


def _first_entries(batches):
    """The entry of the least set for each token of this partition's rows."""
    for batch in batches:
        rows = []
        for t, l, p, i, z in zip(*(batch.column(c).to_pylist() for c in ("token", "local", "pos", "ids", "sizes"))):
            token, local = np.cumsum(_unpack(t, np.uint64), dtype=np.uint64), _unpack(l, np.uint32)
            rows.append((token, _unpack(i, np.int64)[local], _unpack(z, np.uint32)[local].astype(np.int64), _unpack(p, np.uint32).astype(np.int64)))
        if rows:
            token, sid, size, pos = (np.concatenate(x) for x in zip(*rows))
            by = np.lexsort((sid, token))
            by = by[_starts(token[by])]
            yield pa.RecordBatch.from_arrays([pa.array(token[by].view(np.int64)), pa.array(sid[by]), pa.array(size[by]), pa.array(pos[by])], ["token", "sid", "size", "pos"])


def _hub_entries(order, bits: int, most: int, extra: int):
    """Posts the hub of a split list to all of its parts."""

    def run(batches):
        split = _Split(*order.value, bits, most, extra)
        for batch in batches:
            token, sid, size, pos = (np.asarray(batch.column(c)) for c in ("token", "sid", "size", "pos"))
            if not len(token):
                continue
            token = token.view(np.uint64)
            parts = split.parts_of(token).astype(np.int64)
            each = np.repeat(np.arange(len(token)), parts)
            part = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
            bucket = split.bucket(token[each], part.astype(np.uint64))
            yield _packed(bucket, token[each], each, pos[each], sid.astype(np.int64), size.astype(np.int64))

    return run


def _lists(batches):
    """The index lists of this partition that hold two sets at least: token, set, size and position, sorted by token and set."""
    parts: list = []
    for batch in batches:
        for t, l, p, i, z in zip(*(batch.column(c).to_pylist() for c in ("token", "local", "pos", "ids", "sizes"))):
            local = _unpack(l, np.uint32)
            parts.append((np.cumsum(_unpack(t, np.uint64), dtype=np.uint64), _unpack(i, np.int64)[local], _unpack(z, np.uint32)[local].astype(np.int64), _unpack(p, np.uint32).astype(np.int64)))
    if not parts:
        return None
    token, sid, size, pos = (np.concatenate(x) for x in zip(*parts))
    del parts
    _, at, count = np.unique(token, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[at] > 1)
    token, sid, size, pos = token[shared], sid[shared], size[shared], pos[shared]
    by = np.lexsort((sid, token))
    token, sid, size, pos = token[by], sid[by], size[by], pos[by]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])  # tasks that met equal sets posted them twice
    return token[new], sid[new], size[new], pos[new]


def _possible(na, pa_, nb, pb):
    """Whether two sets that first share a token at these positions can still link."""
    need = (NUM * (na + nb) + NUM + DEN - 1) // (NUM + DEN)
    return 1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need


def _starts(token: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)


def _hub_pairs(batches):
    """(hub, member) of every list, as far as sizes and positions allow a link."""
    got = _lists(batches)
    if got is None or not len(got[0]):
        return
    token, sid, size, pos = got
    start = _starts(token)
    hub = np.repeat(start, np.diff(np.r_[start, len(token)]))
    own = np.flatnonzero(hub != np.arange(len(token)))
    h = hub[own]
    own = own[_possible(size[h], pos[h], size[own], pos[own])]
    h = hub[own]
    pairs = np.unique(np.stack([sid[h], sid[own]], 1), axis=0) if len(own) else np.empty((0, 2), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _open_lists(base: int):
    """Lists of three sets and more, a row for each set but the hub. Lists of equal sets, all of which may link with the
    hub, come once a partition, without positions. The parts of a split list (in buckets from base on) keep one name."""

    def run(batches):
        bucket, batches = _peeked(batches)
        got = _lists(batches)
        if got is None or not len(got[0]):
            return
        token, sid, size, pos = got
        start = _starts(token)
        hub = np.repeat(start, np.diff(np.r_[start, len(token)]))
        fits = _possible(size[hub], pos[hub], size, pos)
        split = bucket >= base
        seen, rows = set(), []
        for a, b in zip(start.tolist(), np.r_[start[1:], len(token)].tolist()):
            if b - a < (2 if split else 3):
                continue
            members, places = sid[a:b], pos[a + 1 : b]
            if split:
                key = int(token[a])
            else:
                if fits[a + 1 : b].all():
                    places = np.zeros(b - a - 1, np.int64)
                key = xxhash.xxh64_intdigest(members.tobytes() + places.tobytes())
                if key in seen:
                    continue
                seen.add(key)
            rows.append((np.full(b - a - 1, signed(key)), np.full(b - a - 1, members[0]), members[1:], size[a + 1 : b], places))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], ["list", "hub", "set_id", "n", "pos"])

    return run


def _peeked(batches):
    """The bucket of a partition, and its batches."""
    batches = iter(batches)
    for first in batches:
        if first.num_rows:
            return first.column("bucket")[0].as_py(), itertools.chain([first], batches)
    return -1, iter(())


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, text) of the wanted (set_id, th); only texts that may be wanted are shuffled."""
    bloom = Bloom.of(wanted, "th")

    def run(batches):
        seen: set = set()
        for batch in batches:
            th = np.asarray(batch.column("th")).astype(np.int64)
            keep = np.flatnonzero(bloom.may_hold(th))
            keep = [i for i, h in zip(keep.tolist(), th[keep].tolist()) if not (h in seen or seen.add(h))]
            if len(seen) >= 1 << 20:
                seen.clear()
            if keep:
                some = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([some.column("th"), pa.array([zstandard.compress(x or b"", 3) for x in text_bytes(some.column("text"))], pa.binary())], ["th", "text"])

    found = docs.select(F.xxhash64("text").alias("th"), "text").mapInArrow(run, "th long, text binary")
    return found.join(wanted, "th").groupBy("set_id").agg(F.first("text").alias("text"))


def _measured(batches):
    """Overlaps of a stream in which each hub's row stands before its members. Of a member that shares half its tokens with
    the hub also the difference: a bit for each token of the hub that it has (r), and its other tokens (x)."""
    hub, own = None, None
    for batch in batches:
        out = []
        for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text").to_pylist()):
            s = shingles(zstandard.decompress(text))
            if b is None:
                hub, own = a, s
                continue
            if a != hub:
                raise ValueError("a member without its hub")
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            hit = own[at] == s
            o = int(hit.sum())
            if 2 * o >= len(s):
                r = np.zeros(len(own), bool)
                r[at[hit]] = True
                out.append((a, b, o, len(own), len(s), np.packbits(r).tobytes(), s[~hit].tobytes()))
            else:
                out.append((a, b, o, len(own), len(s), None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (*[pa.int64()] * 5, pa.binary(), pa.binary()))], ["a", "b", "o", "na", "nb", "r", "x"])


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Overlap and sizes of each pair (a, b). The members of a hub are dealt over tasks by hundreds."""
    nodes = pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b").alias("set_id"))).distinct()
    texts = checkpoint(_texts(docs, checkpoint(nodes.join(reps, "set_id").select("set_id", "th"))))
    salts = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / 256) + 1).cast("int").alias("salts"))
    hubs = salts.join(texts, salts.a == texts.set_id).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    salted = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    members = salted.join(texts, salted.b == texts.set_id).select("a", "salt", "b", "text")
    both = hubs.unionByName(members).repartition(parallelism(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.mapInArrow(_measured, "a long, b long, o long, na long, nb long, r binary, x binary")


def _blocks(rows: DataFrame, group: str) -> DataFrame:
    """Deals each group's rows over block pairs (i, j). Blocks hold sets of one octave of sizes, about BLOCK of them, and
    either of the group's main component or of the others (rest): the main component needs no pairs of its own, so its rows
    only meet the blocks of the rest. Blocks more than an octave apart cannot link and are skipped. side: 0 within a block,
    1 first, 2 second."""
    octave = F.floor(F.log2(F.col("n").cast("double"))).cast("long")
    blocks = lambda m: (F.floor(F.col(m) / BLOCK) + 1).cast("int")
    main = F.col("comp") == F.col("main")
    placed = rows.withColumn("octave", octave).withColumn("mains", blocks("main_m")).withColumn("rests", blocks("rest_m"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("set_id"), F.when(main, F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    name = {"main": "(octave + {0}) * 8589934592L + {1}", "rest": "(octave + {0}) * 8589934592L + 4294967296L + {1}"}

    def pairs(many: str, first: tuple, second: tuple, side: str) -> str:
        at = lambda kind, over, part: name[kind].format(over, part)
        return f"transform(sequence(0, {many} - 1), p -> named_struct('i', {at(*first)}, 'j', {at(*second)}, 'side', {side}))"

    steps = (-1, 0, 1)
    of_main = ", ".join(pairs("rests", ("main", 0, "part"), ("rest", d, "p"), "1") for d in steps)
    of_rest = ", ".join([
        *[pairs("mains", ("main", d, "p"), ("rest", 0, "part"), "2") for d in steps],
        pairs("rests", ("rest", 0, "least(part, p)"), ("rest", 0, "greatest(part, p)"), "IF(p = part, 0, IF(part < p, 1, 2))"),
        pairs("rests", ("rest", 0, "part"), ("rest", 1, "p"), "1"), pairs("rests", ("rest", -1, "p"), ("rest", 0, "part"), "2"),
    ])
    kept = [c for c in rows.columns if c not in ("main", "main_m", "rest_m")]
    dealt = placed.select(*kept, F.explode(F.expr(f"IF(comp = main, concat({of_main}), concat({of_rest}))")).alias("b_")).select(*kept, "b_.i", "b_.j", F.col("b_.side").cast("int").alias("side"))
    return dealt.repartition(parallelism(rows.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j")


def _by_group(solve, names: list[str], key: int):
    """Runs solve(rows) over the rows of each key of a sorted stream."""

    def run(batches):
        now, rows = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:key] != now:
                    out += solve(rows) if len(rows) > 1 else []
                    now, rows = row[:key], []
                rows.append(row[key:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
        out = solve(rows) if len(rows) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return run


def _root(of: dict, x: int) -> int:
    while of.setdefault(x, x) != x:
        of[x] = x = of[of[x]]
    return x


def _derived(rows: list) -> list:
    """Links over components among members of one hub, from their differences to it: two members share the hub's tokens
    that both have, and what they share of their others. Only links that join components anew are given."""
    side, sid, n, comp, r, x = zip(*rows)
    first, second = [i for i, s in enumerate(side) if s <= 1], [i for i, s in enumerate(side) if s != 1]
    if not first or not second:
        return []
    n, comp = np.array(n), np.array(comp)
    added = np.array([len(v) >> 3 for v in x])
    step = max(16, (1 << 22) // max(1, 8 * len(r[0])))
    bits = lambda of: np.unpackbits(np.frombuffer(b"".join(r[i] for i in of), np.uint8).reshape(len(of), -1), axis=1).astype(np.float32)
    out, of = [], {}
    for a in range(0, len(first), step):
        rows_a = first[a : a + step]
        bits_a = bits(rows_a)
        for b in range(0, len(second), step):
            rows_b = second[b : b + step]
            shared = (bits_a @ bits(rows_b).T).astype(np.int64)
            ia, ib = np.array(rows_a)[:, None], np.array(rows_b)[None, :]
            need = (NUM * (n[ia] + n[ib]) + NUM + DEN - 1) // (NUM + DEN)
            maybe = (comp[ia] != comp[ib]) & (shared + np.minimum(added[ia], added[ib]) >= need)
            for p, q in zip(*(v.tolist() for v in np.nonzero(maybe))):
                i, j = rows_a[p], rows_b[q]
                u, v = _root(of, comp[i]), _root(of, comp[j])
                if u == v or sid[i] == sid[j]:
                    continue
                both = len(np.intersect1d(np.frombuffer(x[i], np.uint64), np.frombuffer(x[j], np.uint64), assume_unique=True))
                if shared[p, q] + both >= need[p, q]:
                    of[u] = v
                    out.append((sid[i], sid[j]))
    return out


def _undecided(rows: list) -> list:
    """Pairs over components inside a block pair of a list that sizes and positions leave open and no hub decides."""
    side, sid, n, pos, comp, known = (np.array(v) for v in zip(*rows))
    y = np.flatnonzero(side != 1)
    y = y[np.argsort(n[y], kind="stable")]
    sizes, out = n[y], set()
    for i in np.flatnonzero(side <= 1).tolist():
        lo, hi = np.searchsorted(sizes, (NUM * n[i] + DEN - 1) // DEN), np.searchsorted(sizes, DEN * n[i] // NUM, "right")
        j = y[lo:hi]
        j = j[(comp[j] != comp[i]) & ~(known[j] & known[i]) & (sid[j] != sid[i])]
        j = j[_possible(n[i], pos[i], n[j], pos[j])]
        out.update((min(sid[i], k), max(sid[i], k)) for k in sid[j].tolist())
    return [(int(a), int(b)) for a, b in out]


def _with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, rows.set_id == comps.node, "left").select(*rows.columns, F.coalesce("component", "set_id").alias("comp"))


def _mixed_groups(rows: DataFrame, group: str, also=None) -> DataFrame:
    """The rows of groups that hold more than one component, with the component that most have, and how many have it or not."""
    each = rows.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("n_"), F.max(F.lit(True) if also is None else also).alias("also"))
    sums = each.groupBy(group).agg(F.max_by("comp", "n_").alias("main"), F.max("n_").alias("main_m"), F.sum("n_").alias("m"), F.count(F.lit(1)).alias("kinds"), F.max("also").alias("also"))
    return rows.join(checkpoint(sums.filter("kinds > 1 and also").select(group, "main", "main_m", (F.col("m") - F.col("main_m")).alias("rest_m"))), group)  # a side of its own: a hot group's rows can be dealt anew


def _within_hubs(hubs: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between components among the members of each hub."""
    members = hubs.filter("r is not null").select(F.col("a").alias("hub"), F.col("b").alias("set_id"), F.col("nb").alias("n"), "r", "x")
    small = _with_component(members.select("hub", "set_id", "n"), comps)
    kept = _mixed_groups(small, "hub").select(F.col("hub").alias("h_"), F.col("set_id").alias("s_"), "comp", "main", "main_m", "rest_m")
    rows = members.join(kept, (members.hub == kept.h_) & (members.set_id == kept.s_)).select("hub", "set_id", "n", "comp", "r", "x", "main", "main_m", "rest_m")
    names = ["hub", "i", "j", "side", "set_id", "n", "comp", "r", "x"]
    return _blocks(rows, "hub").select(*names).mapInArrow(_by_group(_derived, names, 3), "a long, b long")


def _beside_hubs(postings: DataFrame, buckets: int, base: int, comps: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs of different components that lists hold and no common hub decides."""
    rows = postings.repartitionById(buckets, F.col("bucket")).mapInArrow(_open_lists(base), "list long, hub long, set_id long, n long, pos long").dropDuplicates(["list", "set_id"])
    known = hubs.filter("r is not null").select(F.col("a").alias("hub"), F.col("b").alias("set_id"), F.lit(True).alias("known"))
    rows = _with_component(rows.join(known, ["hub", "set_id"], "left").select("list", "set_id", "n", "pos", F.coalesce("known", F.lit(False)).alias("known")), comps)
    mixed_rows = _mixed_groups(rows, "list", ~F.col("known"))
    names = ["list", "i", "j", "side", "set_id", "n", "pos", "comp", "known"]
    return _blocks(mixed_rows, "list").select(*names).mapInArrow(_by_group(_undecided, names, 3), "a long, b long").distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, th, set_id, n) of every row of docs(doc_id, text), th the hash of its text, and the links of its sets."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    bounded_batches(spark)
    ids = checkpoint(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_identify, "doc_id long, th long, set_id long, n long"))
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return ids, _links(spark, docs, ids, total)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text); see the module's text."""
    ids, links = _grouped(docs)
    least = ids.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    if links is None:
        nodes = least.select("set_id", "copies", F.col("least").alias("component_id"))
    else:
        named = checkpoint(least.join(links, least.set_id == links.node, "left").select("set_id", "copies", "least", F.coalesce("component", "set_id").alias("component")))
        smallest = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
        nodes = lookup(named, smallest, "component", "m", F.col("set_id")).select("set_id", "copies", "component_id")
    return lookup(ids, nodes, "set_id", "copies", F.struct("doc_id", "th")).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _links(spark, docs: DataFrame, ids: DataFrame, total: int) -> DataFrame | None:
    """(node, component) of the sets that are linked with another."""
    if not total:
        return None
    bits = min(MOST_BITS, max(parallelism(spark) - 1, total // (4 * POSTINGS)).bit_length())
    text = docs.select("text")
    counted = text.mapInArrow(_counted(bits), "bucket int, v binary, c binary").repartitionById(1 << bits, F.col("bucket"))
    got = counted.mapInArrow(_frequent(max(1, HOT_TOKENS >> bits), HOT_LEAST), "v binary, c binary").collect()
    values, counts = np.concatenate([np.frombuffer(r.v, np.uint32) for r in got] or [np.empty(0, np.uint32)]), np.concatenate([np.frombuffer(r.c, np.uint32) for r in got] or [np.empty(0, np.uint32)])
    by = np.argsort(values)
    order = spark.sparkContext.broadcast((values[by], counts[by]))
    base, extra = 1 << bits, min(MOST_EXTRA, int((counts[counts > LIST_MOST].astype(np.int64) // LIST_MOST + 1).sum()))
    postings = checkpoint(text.mapInArrow(_posted(order, bits, LIST_MOST, max(1, extra), POSTINGS), _POSTED))
    if extra:
        firsts = postings.filter(F.col("bucket") >= base).mapInArrow(_first_entries, "token long, sid long, size long, pos long")
        hub_of = firsts.groupBy("token").agg(F.min(F.struct("sid", "size", "pos")).alias("x")).select("token", "x.sid", "x.size", "x.pos")
        postings = postings.union(checkpoint(hub_of.mapInArrow(_hub_entries(order, bits, LIST_MOST, extra), _POSTED)))
    buckets = base + extra
    reps = ids.filter("n > 0").groupBy("set_id").agg(F.min("th").alias("th"))
    pairs = checkpoint(postings.repartitionById(buckets, F.col("bucket")).mapInArrow(_hub_pairs, "a long, b long").distinct())
    if pairs.isEmpty():
        return None
    is_link = F.expr(f"{DEN} * o >= {NUM} * (na + nb - o)")
    hubs = checkpoint(_verified(docs, reps, pairs))
    links = hubs.filter(is_link).select("a", "b")
    labels = _labels(links)
    derived = checkpoint(_within_hubs(hubs, labels))
    rest = checkpoint(_beside_hubs(postings, buckets, base, labels, hubs))
    links = links.union(derived)
    if not rest.isEmpty():
        links = links.union(_verified(docs, reps, rest).filter(is_link).select("a", "b"))
    return _merged(labels, links)


def _labels(links: DataFrame) -> DataFrame:
    """(node, component) of linked members: a set that each is connected with, the least hub of the least hub of its least
    hub. Hubs are less than their members, so this goes down; two members of one component may still have two labels."""
    up = checkpoint(links.groupBy("b").agg(F.min("a").alias("a")))
    to = up.select(F.col("b").alias("hub"), F.col("a").alias("over"))
    for _ in range(2):
        up = up.join(to, F.col("a") == F.col("hub"), "left").select("b", F.coalesce("over", "a").alias("a"))
    return checkpoint(up.select(F.col("b").alias("node"), F.col("a").alias("component")))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of the links, from the labels and what joins these."""
    of_a, of_b = labels.toDF("node_a", "label_a"), labels.toDF("node_b", "label_b")
    ends = links.join(of_a, F.col("a") == F.col("node_a"), "left").join(of_b, F.col("b") == F.col("node_b"), "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    between = checkpoint(ends.filter("a <> b").distinct())
    if between.isEmpty():
        return labels
    comps = checkpoint(components(between, "a", "b"))
    to = comps.select(F.col("node").alias("label"), F.col("component").alias("over"))
    moved = labels.join(to, F.col("component") == F.col("label"), "left").select("node", F.coalesce("over", "component").alias("component"))
    return moved.unionByName(comps.join(labels, "node", "left_anti"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of the rows of docs with an id, one of each component, and all without shingles. That of the least doc_id stays, of its
    texts the one of the least hash, of rows equal in both the least by their columns. Rows without an id stay."""
    ids, links = _grouped(docs)
    copies = checkpoint(ids.filter("n > 0 and doc_id is not null").groupBy("doc_id", "th", "set_id").agg(F.count(F.lit(1)).alias("n")))
    best = copies.groupBy("set_id").agg(F.min(F.struct("doc_id", "th")).alias("x"))
    if links is not None:
        best = best.join(links, best.set_id == links.node, "left").groupBy(F.coalesce("component", "set_id")).agg(F.min("x").alias("x"))
    best = checkpoint(best.select("x.doc_id", "x.th"))
    id_, th_ = free_name(docs, "id_"), free_name(docs, "th_")
    named = lambda rows: rows.select(F.col("doc_id").alias(id_), F.col("th").alias(th_))
    same = (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(th_))
    kept = docs.join(named(copies.join(best, ["doc_id", "th"], "left_anti")), same, "left_anti")
    several = checkpoint(named(copies.filter("n > 1").join(best, ["doc_id", "th"], "left_semi")))
    if several.isEmpty():
        return kept
    one = docs.join(several, same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min(F.struct(*docs.columns)).alias(id_)).select(f"{id_}.*")
    return kept.join(several, same, "left_anti").unionByName(one)
