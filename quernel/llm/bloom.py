"""A Bloom filter of keys that may occur more than once, built in one distributed pass.

Every slot counts to two. A key that occurs twice has put two into each of its
slots, so a probe never misses a repeated key; a key that occurs once passes
only where other keys fill all its slots. Tasks send sparse partial counts, a
shuffle by chunk of the filter adds them up in a stream, and what reaches the
driver is one bit a slot, at most ``max_bits`` (a proven bound). With more keys
than that serves, more unique keys pass the probe; no result depends on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

PROBES = 3
CHUNK = 1 << 16
SLOTS_A_KEY = 8
MAX_BITS = 1 << 29
FLUSH = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slots(keys: np.ndarray, bits: int, probes: int = PROBES) -> np.ndarray:
    """Different slots of each 64-bit key, as (keys, probes)."""
    k = keys.astype(np.uint64, copy=False)
    with np.errstate(over="ignore"):
        a, b = mix(k + np.uint64(0x9E3779B97F4A7C15)), mix(k ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        return (a[:, None] + np.arange(probes, dtype=np.uint64) * b[:, None]) & np.uint64(bits - 1)


def bits_for(rows: int, max_bits: int = MAX_BITS) -> int:
    need = max(CHUNK, rows * SLOTS_A_KEY)
    return min(max_bits, 1 << (need - 1).bit_length())


def _pack(offsets: np.ndarray) -> bytes:
    """Slots of one chunk: their 16-bit offsets, or the bitmap where that is shorter."""
    if len(offsets) * 2 < CHUNK // 8:
        return offsets.astype("<u2").tobytes()
    bitmap = np.zeros(CHUNK, bool)
    bitmap[offsets] = True
    return np.packbits(bitmap, bitorder="little").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if len(data) < CHUNK // 8:
        return np.frombuffer(data, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


PARTIAL = pa.schema([("chunk", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def _partials(bits: int, repeated: bool, probes: int):
    def run(batches):
        held, n = [], 0

        def flush():
            s, c = np.unique(slots(np.concatenate(held), bits, probes).ravel(), return_counts=True)
            chunk, offset = s // np.uint64(CHUNK), (s % np.uint64(CHUNK)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.diff(chunk, prepend=chunk[0] + np.uint64(1))), len(chunk))
            rows = {"chunk": [], "once": [], "twice": []}
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                rows["chunk"].append(int(chunk[i]))
                rows["once"].append(_pack(offset[i:j]))
                rows["twice"].append(_pack(offset[i:j][c[i:j] > 1]) if repeated else b"")
            return pa.RecordBatch.from_pydict(rows, schema=PARTIAL)

        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(keys):
                held.append(keys.astype(np.int64, copy=False).view(np.uint64))
                n += len(keys)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _merge(repeated: bool):
    least = 2 if repeated else 1

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = counts.setdefault(chunk, np.zeros(CHUNK, np.uint8))
                at = _unpack(once)
                c[at] = np.minimum(c[at] + 1, 2)
                c[_unpack(twice)] = 2
        for chunk, c in counts.items():
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "once": [np.packbits(c >= least, bitorder="little").tobytes()], "twice": [b""]}, schema=PARTIAL)

    return run


class Filter:
    """A built filter: ``probe(column)`` is true for every key that was put in (twice at least, of a repeat filter)."""

    def __init__(self, spark, bits: int, data: bytes, probes: int = PROBES):
        self.bits, self.probes, self.held = bits, probes, spark.sparkContext.broadcast(data)

    def test(self):
        """A function from an array of 64-bit keys to booleans, for use in tasks."""
        bits, probes, held = self.bits, self.probes, self.held

        def test(keys: np.ndarray) -> np.ndarray:
            data = np.frombuffer(held.value, np.uint8)
            s = slots(keys.astype(np.int64, copy=False).view(np.uint64), bits, probes)
            return ((data[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

        return test

    def drop(self) -> None:
        """Deletes the filter on driver and executors; only once all that probes it is written."""
        self.held.destroy()

    def probe(self, key: Column) -> Column:
        test = self.test()

        @F.arrow_udf("boolean")
        def may(keys: pa.Array) -> pa.Array:
            return pa.array(test(keys.fill_null(0).to_numpy(zero_copy_only=False)))

        return may(key)


def build(keys: DataFrame, rows: int, repeated: bool, max_bits: int = MAX_BITS, probes: int = PROBES, through=None) -> Filter:
    """keys: one bigint column, nulls are left out; or what `through`, a function over batches, makes keys of in the same worker. repeated: hold the keys that may occur twice or more, else all."""
    bits = bits_for(rows, max_bits)
    partials = _partials(bits, repeated, probes)
    source = partials if through is None else lambda batches: partials(through(batches))
    merged = keys.mapInArrow(lean(source), "chunk long, once binary, twice binary").repartition("chunk").mapInArrow(lean(_merge(repeated)), "chunk long, once binary, twice binary")
    data = np.zeros(bits // 8, np.uint8)
    for r in merged.select("chunk", "once").collect():  # bits / CHUNK rows at most
        data[r.chunk * (CHUNK // 8) : (r.chunk + 1) * (CHUNK // 8)] = np.frombuffer(bytes(r.once), np.uint8)
    return Filter(keys.sparkSession, bits, data.tobytes(), probes)
