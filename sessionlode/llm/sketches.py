"""Sketches of bounded size, filled on the executors and added up in a tree: a frequency sketch and a Bloom filter.

Both only steer work (the order of tokens, what is worth shipping); exact comparisons and counts decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlode.llm.hashing import U64, mix

SLOT_BITS = 20
#: Bits of a Bloom filter: 16 for each key, within these bounds (128 KB and 32 MB). Beyond 16 million keys more and more
#: misses pass as hits, which costs shipping and no result.
BLOOM_BITS = (20, 28)
FAN_IN = 16


def _one(vector: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([zlib.compress(vector.tobytes(), 1)], type=pa.binary())], names=["part"])


def _fold(rows: Iterable[bytes], dtype: str, width: int, merge) -> np.ndarray | None:
    total = None
    for part in rows:
        vector = np.frombuffer(zlib.decompress(part), dtype=dtype)
        total = vector.copy() if total is None else merge(total, vector, out=total)
    return total


def tree_total(parts: DataFrame, dtype: str, width: int, merge) -> np.ndarray:
    """The merged vector of all rows of ``parts`` (one binary column); zeros if there are none.

    Each level merges its rows to a sixteenth as many, one vector in memory at a time; the driver gets one row.
    """

    def run(batches):
        total = _fold((x for b in batches for x in b.column(0).to_pylist()), dtype, width, merge)
        if total is not None:
            yield _one(total)

    fan = max(1, parts.sparkSession.sparkContext.defaultParallelism)
    while True:
        parts = parts.repartition(fan, F.pmod(F.xxhash64("part"), F.lit(fan))).mapInArrow(run, "part binary")
        if fan == 1:
            break
        fan = 1 if fan <= FAN_IN else -(-fan // FAN_IN)
    total = _fold((r[0] for r in parts.collect()), dtype, width, merge)
    return np.zeros(width, dtype=dtype) if total is None else total


def slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - SLOT_BITS)).astype(np.int64)


def exact_counts(df: DataFrame, tokens: Callable[[pa.RecordBatch], Iterator[np.ndarray]], over: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(tokens, counts) of all tokens that occur more than ``least`` times, of those whose slot is in ``over``; sorted by
    token. None if there are more than ``most`` of them. A count by key, combined before the shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(over)

    def run(batches):
        for batch in batches:
            for x in tokens(batch):
                x, n = np.unique(x[shared.value[slot(x)]], return_counts=True)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], names=["token", "n"])

    heavy = df.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    found = heavy.limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    at, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(at)
    return at[order], n[order]


def frequencies(df: DataFrame, tokens: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How often tokens fall in each of 2**SLOT_BITS slots, over all rows: an upper bound of every token's frequency."""
    width = 1 << SLOT_BITS

    def run(batches):
        total = np.zeros(width, dtype=np.int64)
        held, n = [], 0
        for batch in batches:
            for x in tokens(batch):
                held.append(slot(x))
                n += len(x)
                if n >= width:  # counting takes a pass over all slots
                    total += np.bincount(np.concatenate(held), minlength=width)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=width)
        if total.any():
            yield _one(total)

    return tree_total(df.mapInArrow(run, "part binary"), "int64", width, np.add)


class Bloom:
    """Three probes a key in 2**bits bits: a miss is certain, a hit is not."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    @staticmethod
    def _probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        x = mix(keys)
        for k in range(3):
            yield ((x >> U64(13 * k)) & U64((1 << bits) - 1)).astype(np.int64)

    @classmethod
    def of(cls, df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> Bloom:
        bits = min(max((16 * df.count()).bit_length(), BLOOM_BITS[0]), BLOOM_BITS[1])
        width = 1 << (bits - 3)

        def run(batches):
            packed = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if packed is None:
                    packed = np.zeros(width, dtype=np.uint8)
                for at in cls._probes(keys(batch), bits):
                    np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
            if packed is not None:
                yield _one(packed)

        return cls(bits, tree_total(df.mapInArrow(run, "part binary"), "uint8", width, np.bitwise_or))

    def hits(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for at in self._probes(keys, self.bits):
            out &= (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out
