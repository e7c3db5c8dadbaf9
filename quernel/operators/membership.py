"""A Bloom filter of a column as a small table of 64-bit words, built and probed by column expressions.

Every hash sets a bit; words are or-ed by partial aggregates, so nothing is gathered
but the filter, whose size is bits_per_key times the keys. A probe joins a key's
words: by broadcast where the filter is small, else by a shuffle, so it serves at any
size. It never misses a key that was put in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

BITS_PER_KEY, HASHES = 10, 6
#: Words of a filter that is broadcast: 8 MB.
BROADCAST_WORDS = 1 << 20


class BloomFilter:
    def __init__(self, words: DataFrame, bits: int, hashes: int = HASHES):
        self.words, self.bits, self.hashes = words, bits, hashes

    @staticmethod
    def build(df: DataFrame, key: str, bits_per_key: int = BITS_PER_KEY, hashes: int = HASHES) -> BloomFilter:
        keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
        bits = max(64, -(-keys.count() * bits_per_key // 64) * 64)
        set_ = keys.select(F.explode(_places(F.col("k"), bits, hashes)).alias("p"))
        words = set_.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        return BloomFilter(stage(words, "bloom"), bits, hashes)

    def probe(self, df: DataFrame, key: str, hit: str = "hit") -> DataFrame:
        """df with a column that is false only for keys that were never put in (null: false)."""
        small = self.bits // 64 <= BROADCAST_WORDS
        keys = df.select(F.col(key).alias("_k")).where("_k is not null").distinct().withColumn("p", F.explode(_places(F.col("_k"), self.bits, self.hashes)))
        words = F.broadcast(self.words) if small else self.words
        told = keys.withColumn("word", F.floor(F.col("p") / 64)).join(words, "word", "left")
        set_ = F.coalesce(F.expr("(shiftright(bits, cast(p % 64 as int)) & 1L) = 1"), F.lit(False))
        told = told.groupBy("_k").agg(F.every(set_).alias(hit))
        return df.join(told, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(hit, F.coalesce(hit, F.lit(False)))


def _places(key: Column, bits: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(hashes)])
