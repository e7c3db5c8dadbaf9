"""Block codecs as columns: LZ4, Zstandard, byte deltas, a shared dictionary, and an adaptive choice.

Tables leave compression to Parquet. These serve values that are stored or sent as
binary columns; batches go through Arrow, so each value is coded once, in place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes under which nothing is compressed, and under which LZ4 is taken; how much better Zstandard must be.
LEAST, THRESHOLD, BETTER = 64, 1024, 1.2
ZSTD_LEVEL = 3


def _size(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little")


def _lz4(data: bytes) -> bytes:
    return _size(data) + pa.Codec("lz4_raw").compress(data, asbytes=True)


def _un_lz4(data: bytes) -> bytes:
    return pa.Codec("lz4_raw").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True) if data[:4] != bytes(4) else b""


def _zstd(data: bytes, held=None) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=ZSTD_LEVEL, dict_data=held, write_content_size=True).compress(data)


def _un_zstd(data: bytes, held=None) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=held).decompress(data, max_output_size=0)


def _delta(data: bytes) -> bytes:
    b = np.frombuffer(data, np.uint8)
    return _lz4(np.diff(b, prepend=np.uint8(0)).astype(np.uint8).tobytes())


def _un_delta(data: bytes) -> bytes:
    return np.cumsum(np.frombuffer(_un_lz4(data), np.uint8), dtype=np.uint8).tobytes()


def _with(dictionary: bytes | None):
    if dictionary is None:
        return None
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


CODERS = {"none": (lambda b: b, lambda b: b), "lz4": (_lz4, _un_lz4), "zstd": (_zstd, _un_zstd), "delta": (_delta, _un_delta)}


def _column(value: Column, steps: Sequence[tuple[Column | str, int]], dictionary: bytes | None) -> Column:
    """The value after all steps (codec, 0 to pack or 1 to unpack). One function does them value by value: each Python function that isn't nested in another alone has a worker of its own in every task, which holds a batch."""
    named = [(c, which) if isinstance(c, str) else (None, which) for c, which in steps]

    @F.arrow_udf("binary")
    def coded(values: pa.Array, *codecs: pa.Array) -> pa.Array:
        held = _with(dictionary)
        shared = (lambda b: _zstd(b, held), lambda b: _un_zstd(b, held))
        by, out = {**CODERS, "dictionary": shared}, []
        for row, v in enumerate(values):
            v, told = v.as_py(), iter(codecs)
            for codec, which in named:
                codec = next(told)[row].as_py() if codec is None else codec
                v = None if v is None else by[codec][which](v)
            out.append(v)
        return pa.array(out, pa.binary())

    return coded(value.cast("binary"), *[c for c, _ in steps if not isinstance(c, str)])


def compress(value: Column, codec: Column | str, dictionary: bytes | None = None) -> Column:
    """codec: none, lz4, zstd, delta or dictionary (Zstandard with the bytes given); null stays null."""
    return _column(value, [(codec, 0)], dictionary)


def decompress(value: Column, codec: Column | str, dictionary: bytes | None = None) -> Column:
    return _column(value, [(codec, 1)], dictionary)


def round_trip(value: Column, codecs: Sequence[Column | str], dictionary: bytes | None = None) -> Column:
    """The value as each codec in turn has packed and unpacked it, in one Python worker a task whatever the number of codecs."""
    return _column(value, [(c, which) for c in codecs for which in (0, 1)], dictionary)


def choose(size: Column, lz4_ratio: Column | float = 1.0, zstd_ratio: Column | float = 1.0, threshold: int = THRESHOLD) -> Column:
    """The adaptive choice by a value's size and the ratios seen so far."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    better = as_column(zstd_ratio) > as_column(lz4_ratio) * BETTER
    return F.when(size < LEAST, "none").when(size < threshold, "lz4").when(better, "zstd").otherwise("lz4")


def ratios(df: DataFrame, value: str, codecs: tuple[str, ...] = ("lz4", "zstd")) -> DataFrame:
    """codec, size, packed, ratio of all values of a column: what `choose` learns from."""
    v = F.col(value).cast("binary")
    wide = df.agg(F.sum(F.octet_length(v)).alias("size"), *[F.sum(F.octet_length(compress(v, c))).alias(c) for c in codecs])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("codec"), F.col(c).alias("packed")) for c in codecs]))
    return wide.select("size", each.alias("x")).select("x.codec", "size", "x.packed", (F.col("size") / F.col("x.packed")).alias("ratio"))


def deltas(df: DataFrame, order: str, value: str, overlap_rows: int = 1) -> DataFrame:
    """Differences to the value before, in order: (order, delta); the first is the value itself. Chunks of the order look back on one row."""
    from pyspark.sql import Window

    from .ranges import in_chunks

    w = Window.partitionBy("_chunk").orderBy("_at")
    rows = in_chunks(df.select(order, value), [], [order], overlap_rows).withColumn("_before", F.lag(value).over(w)).where("not _context")
    return rows.select(order, (F.col(value) - F.coalesce("_before", F.lit(0))).alias("delta"))


def undelta(df: DataFrame, order: str) -> DataFrame:
    """(order, value): running sums of deltas over the whole order."""
    from .ranges import running

    return running(df.select(order, "delta"), [order], {"value": F.col("delta")}).drop("delta")
