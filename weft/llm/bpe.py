"""Byte-level BPE by monoid tree reduction.

A text is halved until its parts are small. Each part is split by the pattern and encoded; neighbours are joined by
encoding anew a window around their boundary, which grows until nothing outside it can change:

* pieces of the pattern: it reads no further than LOOKAHEAD characters past a piece, so pieces of the left part that end
  that far from its end stand; from a position that is a piece's start in the window and in the right part both scans agree;
* tokens of one long piece: an encoding is right exactly if each pair of adjacent tokens encodes to itself, so the window
  stands as soon as the pairs at both of its ends do.

Decoding concatenates up the same kind of tree. Result: what the ranks give when each match of the pattern is merged on
its own and no special token is read. Null counts as empty. Repeated rows each get their row; a task holds one batch and
one text's tokens.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, free_name

LEAF_CHARS = 8192
LEAF_BYTES = 256
LOOKAHEAD = 3
_CODECS: dict = {}


class Codec:
    """Encodes and decodes with one rank file and pattern."""

    def __init__(self, ranks: bytes, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.merged = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            self.bytes_of[i] = token
        self.known = _Pieces(self)

    # Pieces of the pattern.

    def pieces(self, text: str) -> list[str]:
        if len(text) <= self.leaf_chars:
            return self.pattern.findall(text)
        half = len(text) // 2
        return self.joined_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def joined_pieces(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left or right
        a, tail = len(left) - 1, len(left[-1])
        while a and tail < LOOKAHEAD:
            a -= 1
            tail += len(left[a])
        if a:  # the piece before must end LOOKAHEAD characters before the end
            head = "".join(left[a:])
        else:
            head = "".join(left)
        b = min(8, len(right))
        while True:
            window = head + "".join(right[:b])
            whole = b == len(right)
            starts, at = {len(head): 0}, len(head)
            for i, piece in enumerate(right[:b]):
                at += len(piece)
                starts[at] = i + 1
            out, at = [], 0
            for piece in self.pattern.findall(window):
                if at in starts and (whole or at <= len(window) - LOOKAHEAD):
                    return left[:a] + out + right[starts[at] :]
                out.append(piece)
                at += len(piece)
            if whole:
                return left[:a] + out
            b = min(2 * b, len(right))

    # Tokens of a piece.

    def tokens(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self.merged(piece)
        half = len(piece) // 2
        return self.joined_tokens(self.tokens(piece[:half]), self.tokens(piece[half:]))

    def stands(self, a: int, b: int) -> bool:
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def joined_tokens(self, left: list[int], right: list[int]) -> list[int]:
        a = b = 0
        middle: list[int] = []
        while True:
            ends = [*left[len(left) - a - 1 : len(left) - a], *middle, *right[b : b + 1]]
            bad_left = a < len(left) and len(ends) > 1 and not self.stands(ends[0], ends[1])
            bad_right = b < len(right) and len(ends) > 1 and not self.stands(ends[-2], ends[-1])
            if not bad_left and not bad_right:
                return left[: len(left) - a] + middle + right[b:]
            a = min(len(left), max(1, 2 * a)) if bad_left else a
            b = min(len(right), max(1, 2 * b)) if bad_right else b
            middle = self.merged(b"".join(self.bytes_of[i] for i in left[len(left) - a :] + right[:b]))

    # Texts.

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Pieces(dict):
    """Encoded pieces, with a bounded cache."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.codec.tokens(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= 1 << 19:
                self.clear()
            self[piece] = ids
        return ids


def codec_of(ranks: bytes, pattern: str) -> Codec:
    """One codec a process."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows of docs and, under the names ids, n_tokens, ids_sha256 and decoded_sha256 (or with _ after them where docs
    has these), the encoding, its length and digests of it and of its decoding. The rank file, of fixed size, is read by
    the driver and broadcast."""
    bounded_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    own = [free_name(docs, c) for c in ("ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    at = docs.columns.index(text)

    def run(batches):
        codec = codec_of(shared.value, pattern)
        for batch in batches:
            ids, sizes, digests, decoded = [], [], [], []
            for x in batch.column(at).to_pylist():
                got = codec.encode(x) if x else b""
                ids.append(got)
                sizes.append(len(got) >> 2)
                digests.append(hashlib.sha256(got).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(np.frombuffer(got, "<u4").tolist())).hexdigest())
            columns = [pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *own])

    kinds = (T.BinaryType(), T.LongType(), T.StringType(), T.StringType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *map(T.StructField, own, kinds)]))
