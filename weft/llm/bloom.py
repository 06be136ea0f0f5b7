"""A table of bits that tells which keys may be among given ones: it lets rows go before they are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

MOST_BITS = 30  # 128 MB; beyond, more rows pass that need not
_U = np.uint64


class Bloom:
    """Broadcast bits; keys are long hashes. Of size 16 bits a key, and MOST_BITS at most."""

    def __init__(self, bits: int, shared):
        self.bits, self.shared = bits, shared

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> Bloom:
        """Gathers the bits of a (checkpointed) frame's keys from a table a partition, OR-ed on the driver one by one."""
        bits = min(MOST_BITS, max(12, (16 * max(keys.count(), 1)).bit_length()))

        def run(batches):
            held = np.zeros(1 << bits >> 3, np.uint8)
            for batch in batches:
                at = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64) >> _U(64 - bits)
                np.bitwise_or.at(held, at >> _U(3), np.uint8(128) >> (at & _U(7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(held.tobytes())], pa.binary())], ["b"])

        held = np.zeros(1 << bits >> 3, np.uint8)
        for row in keys.select(column).coalesce(8).mapInArrow(run, "b binary").toLocalIterator():
            held |= np.frombuffer(zstandard.decompress(row.b), np.uint8)
        return cls(bits, keys.sparkSession.sparkContext.broadcast(held))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) >> _U(64 - self.bits)
        return (self.shared.value[at >> _U(3)] >> (_U(7) - (at & _U(7))).astype(np.uint8) & 1).astype(bool)
