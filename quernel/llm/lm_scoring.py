"""Language-model scores from a log-frequency Bloom filter.

The model counts words and pairs of neighbouring words over all training texts. A
count c is quantised to q = 1 + floor(log2 c), so that an n-gram seen once has level
1 and one never seen has none, and the filter holds it for each level 1..q: a probe asks level after level until one is
missing, which bounds the count from above with a small one-sided error. The
probability of a word after another is

    P(w | u) = MIX * min(1, c(u, w) / c(u)) + (1 - MIX) * (c(w) + 1) / (N + V + 1)

with every c from the filter, N and V the training tokens and different tokens.
A text starts after an end token and closes with one.

The filter grows with the counts: it is cut by range of hashes into shards of
about ``KEYS_A_RANGE`` tokens, more of them the more tokens there are, each with
``BITS_A_LEVEL`` bits for each level it holds. No shard leaves its task. The texts
stand in blocks; a block sends its different n-grams to their shards, with the
counts they have in its training texts, and each shard sums them, is built, is
probed, and sends a byte an n-gram back to the block. So the same steps run at
every size and no n-gram is left out for its number.

Beside it stand exact add-one scores of single tokens (base_score). Counts of the
``HOT`` most frequent tokens at most are broadcast; all other tokens of a text
meet their counts in a shuffled join, so counts are exact at every size.

Blocks sum their own counts before the shuffle, as packed arrays of hashes (the
range and 40 more bits, by which two n-grams of a range are hardly ever taken for
one), byte planes first: they compress. No n-gram is ever gathered from all rows.

Defined cases: a null text counts as empty, whose one token is the end; a null id
is a training row; with no training row N and V are 0 and base scores are 0;
rows that are alike get alike scores; texts and tokens of any length are read whole
(a text longer than a block is a block of its own); an empty table gives an empty
result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import discard, lean, stage

FOLDS, HELD_OUT = 7, 2
HOT = 1 << 17
#: Longer tokens stand in the broadcast table by their SHA-256, which bounds its size.
HOT_BYTES = 64
BITS_A_LEVEL = 12
PROBES = 3
MIX = 0.3
#: The end of a text; no word can hold a space.
END = b" "
#: UTF-8 bytes of a block's texts (one longer text is a block of its own), and tokens a range of hashes is meant to have.
BLOCK_BYTES, KEYS_A_RANGE = 3 << 20, 1 << 20
LEVELS = 64


def words(text: str | None) -> list[bytes]:
    """Lower-case in A-Z alone, split at the contract's white space alone, as bytes; then the end."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def short_name(word: bytes) -> bytes:
    return word if len(word) <= HOT_BYTES else hashlib.sha256(word).digest() + b"  sha"


def hash_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return bloom.mix(u * np.uint64(0x9E3779B97F4A7C15) + w)


class _Numbers(dict):
    """Gives every new word the next number."""

    def __init__(self):
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.names.append(word)
        return n


class Words:
    """Numbers words as they come, with their hashes."""

    def __init__(self):
        self.number = _Numbers()
        self.names = self.number.names
        self.hashes = np.zeros(1 << 12, np.uint64)

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        first = len(self.names)
        out = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        while len(self.names) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[first : len(self.names)] = [hash_of(w) for w in self.names[first:]]
        return out


def _count_words(batches):
    held: Counter = Counter()

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
        held.clear()
        return rows

    for b in batches:
        for t in b.column(0).to_pylist():
            held.update(words(t))
            if len(held) > 1 << 20:
                yield flush()
    if held:
        yield flush()


class Part:
    """Neighbouring texts of a block as numbered tokens, and the sorted different n-grams in them."""

    def __init__(self, texts: list, ranges: int):
        tokens, self.ends = [END], [0]
        for t in texts:
            tokens += words(t)
            self.ends.append(len(tokens) - 1)
        known = Words()
        self.ids = known.numbers(tokens)
        self.names = known.names
        h = known.hashes[: len(self.names)]
        of = h[self.ids]
        pairs = pair_hash(of[:-1], of[1:])
        self.keys, at = np.unique(_trimmed(np.concatenate([pairs, h]), ranges), return_inverse=True)
        #: Places in keys of the pair that ends at each token but the first, and of each different word.
        self.pair, self.word = at[: len(pairs)], at[len(pairs) :]

    def counts(self, trained: np.ndarray) -> np.ndarray:
        """Of each key, in the trained texts."""
        each = np.repeat(trained, np.diff(self.ends))
        n = np.bincount(self.pair[each], minlength=len(self.keys))
        return n + np.bincount(self.word[self.ids[1:][each]], minlength=len(self.keys))


def _high(ranges: int) -> int:
    return 64 - (ranges.bit_length() - 1)


def _trimmed(h: np.ndarray, ranges: int) -> np.ndarray:
    """What is sent of a hash: its range, which is its high bits, and its 40 low bits."""
    high = _high(ranges)
    keep = np.uint64((1 << 40) - 1) | (np.uint64(((1 << 64) - 1) ^ ((1 << high) - 1)) if ranges > 1 else np.uint64(0))
    return h & keep


def _packed(x: np.ndarray, size: int) -> bytes:
    """The low bytes of numbers, as planes: all first bytes, then all second ones."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return out.view("<u8").ravel()


BLOCKS = "block long, row long, doc_id long, trained boolean, text string"
#: Rows first to last of a block are a part; asked: whether it wants levels.
KEYS = "range long, block long, first long, last long, asked boolean, low binary, n binary"
ANSWERS = "block long, first long, last long, range long, levels binary"


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[x for x, _ in fields])


def _in_blocks(batches):
    block, held = None, 0
    for b in batches:
        rows, sizes = b.column("row").to_pylist(), [len(t.encode("utf-8", "replace")) if t else 0 for t in b.column("text").to_pylist()]
        out = []
        for row, size in zip(rows, sizes, strict=True):
            if block is None or held + size > BLOCK_BYTES:
                block, held = row, 0
            held += size + 1
            out.append(block)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *b.select(["row", "doc_id", "trained", "text"]).columns], names=["block", "row", "doc_id", "trained", "text"])


def blocks(df: DataFrame) -> DataFrame:
    """df: doc_id, text, trained. Staged, so that a row's block and number never change."""
    return stage(df.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lean(_in_blocks), BLOCKS), "lm-blocks", compression="zstd")


def _keys(ranges: int, asked: bool):
    high = np.uint64(_high(ranges) % 64)

    def run(batches):
        block, rows, trained, texts = None, [], [], []

        def flush():
            part = Part(texts, ranges)
            n = part.counts(np.array(trained, bool))
            keys, n = (part.keys, n) if asked else (part.keys[n > 0], n[n > 0])
            if not len(keys):
                return
            where = (keys >> high).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
            edges = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(keys))
            yield _batch([(int(where[i]), block, rows[0], rows[-1], asked, _packed(keys[i:j], 5), _packed(n[i:j], 4)) for i, j in zip(edges[:-1], edges[1:], strict=True)], KEYS)

        for b in batches:
            for k, row, t, text in zip(*(b.column(x).to_pylist() for x in ("block", "row", "trained", "text")), strict=True):
                if k != block and rows:
                    yield from flush()
                    rows, trained, texts = [], [], []
                block = k
                rows.append(row)
                trained.append(t)
                texts.append(text)
        if rows:
            yield from flush()

    return run


def _answers(ranges: int, bits_a_level: int):
    """Rows of KEYS, sorted by range. A range's filter is built from its sums and probed for what its parts ask."""

    def answered(where: int, held: list):
        h = np.concatenate([_unpacked(x[4], 5) for x in held])
        h, back = np.unique(h, return_inverse=True)
        n = np.bincount(back, np.concatenate([_unpacked(x[5], 4) for x in held])).astype(np.int64)
        h |= (np.uint64(where) << np.uint64(_high(ranges))) if ranges > 1 else np.uint64(0)
        levels = LogFilter.of(h, n, bits_a_level).levels(h)
        at = 0
        for block, first, last, asked, low, _ in held:
            size = len(low) // 5
            if asked:
                yield _batch([(block, first, last, where, levels[back[at : at + size]].tobytes())], ANSWERS)
            at += size

    def run(batches):
        now, held = None, []
        for b in batches:
            for where, *x in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if where != now and held:
                    yield from answered(now, held)
                    held = []
                now = where
                held.append(x)
        if held:
            yield from answered(now, held)

    return run


def quantised(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, 1 + np.floor(np.log2(np.maximum(n, 1) + 0.5)), 0).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """Level 1 is count 1; the others stand for about the middle of their counts."""
    return np.where(level > 1, 0.7 * np.exp2(level.astype(float)), level.astype(float))


def _slots(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """PROBES slots of each key at a level, as (PROBES, keys)."""
    with np.errstate(over="ignore"):
        a = bloom.mix(keys + np.uint64(level) * np.uint64(0xD1342543DE82EF95))
        b = (a >> np.uint64(32)) | np.uint64(1)
        low = a & np.uint64(0xFFFFFFFF)
        return (((low + np.arange(PROBES, dtype=np.uint64)[:, None] * b) & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)


class LogFilter:
    """The filter of a range of hashes. levels(keys): the level found of each key, 0 where there is none."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @staticmethod
    def of(keys: np.ndarray, n: np.ndarray, bits_a_level: int = BITS_A_LEVEL) -> LogFilter:
        q = quantised(n)
        bits = max(64, int(q.sum()) * bits_a_level)
        held = np.zeros(bits, bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            held[_slots(keys[q >= level], level, bits)] = True
        return LogFilter(bits, held)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        q = np.zeros(len(keys), np.uint8)
        alive = np.arange(len(keys))
        for level in range(1, LEVELS):
            alive = alive[self.data[_slots(keys[alive], level, self.bits)].all(axis=0)]
            if not len(alive):
                break
            q[alive] = level
        return q


class Pairs:
    """The filter's shards, as what is sent to build them: words and pairs of the staged training rows."""

    def __init__(self, rows: DataFrame, ranges: int):
        self.rows, self.ranges = rows, ranges

    def answers(self, keys: DataFrame) -> DataFrame:
        """keys: KEYS of all training rows and of what asks."""
        return keys.repartition("range").sortWithinPartitions("range").mapInArrow(lean(_answers(self.ranges, BITS_A_LEVEL)), ANSWERS)

    def keys(self, asked: bool, rows: DataFrame | None = None) -> DataFrame:
        return (self.rows if rows is None else rows).mapInArrow(lean(_keys(self.ranges, asked)), KEYS)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts that the levels of a few hashes stand for."""
        k = _trimmed(keys.astype(np.uint64), self.ranges)
        where = [int(x) >> _high(self.ranges) for x in k]
        rows = [(where[i], i, 0, 0, True, _packed(k[i : i + 1], 5), bytes(4)) for i in range(len(k))]
        asked = self.rows.sparkSession.createDataFrame(rows, KEYS)
        told = {r["block"]: r["levels"][0] for r in self.answers(self.keys(False).where(F.col("range").isin(where)).unionByName(asked)).collect()}
        return count_of(np.array([told[i] for i in range(len(k))]))


class Model:
    def __init__(self, counts: DataFrame, tokens: int, different: int, hot, pairs: Pairs):
        self.counts, self.tokens, self.different, self.hot, self.pairs = counts, tokens, different, hot, pairs


def _fit(rows: DataFrame) -> Model:
    """rows: staged BLOCKS."""
    spark = rows.sparkSession
    counts = stage(rows.where("trained").select("text").mapInArrow(lean(_count_words), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "lm-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, different = total["n"] or 0, total["v"]
    name = F.when(F.octet_length("token") <= HOT_BYTES, F.col("token").cast("binary")).otherwise(F.concat(F.unhex(F.sha2("token", 256)), F.lit("  sha").cast("binary")))
    short = counts.select(name.alias("token"), "n", F.floor(F.log2("n") * 8).cast("int").alias("grade"))
    grades = {r["grade"]: r["m"] for r in short.groupBy("grade").agg(F.count("*").alias("m")).collect()}  # 8 * LEVELS rows at most
    taken, least = 0, None
    for grade in sorted(grades, reverse=True):
        if taken + grades[grade] > HOT:
            break
        taken, least = taken + grades[grade], grade
    hot = {bytes(r["token"]): r["n"] for r in short.where(F.col("grade") >= F.lit(least)).select("token", "n").collect()} if least is not None else {}  # HOT rows at most
    ranges = 1 << max(0, (max(1, tokens // KEYS_A_RANGE) - 1).bit_length())
    return Model(counts, tokens, different, spark.sparkContext.broadcast(hot), Pairs(rows, ranges))


def train(texts: DataFrame) -> Model:
    """texts: one column of training texts."""
    return _fit(blocks(texts.select(F.lit(None).cast("long").alias("doc_id"), F.col(texts.columns[0]).alias("text"), F.lit(True).alias("trained"))))


SCORED = "doc_id long, n_tokens long, hot_known long, hot_sum double, score double, tail array<string>"


def _score(hot, tokens: int, different: int, ranges: int):
    floor = 1.0 / (tokens + different + 1)

    def scored(own: pa.Table, levels: np.ndarray) -> pa.Table:
        part = Part(own.column("text").to_pylist(), ranges)
        if len(levels) != len(part.keys):
            raise ValueError("a part's levels are not those of its n-grams")
        lm, ids = count_of(levels), part.ids
        c, s = np.array([hot.value.get(short_name(w), -1) for w in part.names])[ids][1:], lm[part.word][ids]
        alone = (s[1:] + 1) * floor
        after = np.minimum(1.0, lm[part.pair] / np.maximum(s[:-1], 1.0))
        p = np.log10(MIX * after + (1 - MIX) * np.minimum(1.0, alone))
        starts, edges = np.array(part.ends[:-1]), np.array(part.ends)
        is_hot = c >= 0
        add = lambda x: np.add.reduceat(x, starts)
        rare = np.flatnonzero(~is_hot)
        names = [part.names[k].decode("utf-8", "replace") for k in ids[rare + 1].tolist()]
        tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, edges), pa.int32()), pa.array(names, pa.string()))
        sums = [np.diff(edges), add(is_hot.astype(np.int64)), add(np.where(is_hot, np.log10(np.maximum(c, 0) + 1), 0.0)), add(p)]
        return pa.table([own.column("doc_id"), *map(pa.array, sums), tail], names=["doc_id", "n_tokens", "hot_known", "hot_sum", "score", "tail"])

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        at = np.asarray(rows.column("row"))
        parts: dict[tuple, list] = {}
        for first, last, where, levels in zip(*(answers.column(x).to_pylist() for x in ("first", "last", "range", "levels")), strict=True):
            parts.setdefault((first, last), []).append((where, levels))
        out = []
        for (first, last), x in sorted(parts.items()):
            i, j = np.searchsorted(at, first), np.searchsorted(at, last, "right")
            out.append(scored(rows.slice(i, j - i), np.frombuffer(b"".join(y for _, y in sorted(x)), np.uint8)))
        return pa.concat_tables(out)

    return run


def _scored(rows: DataFrame, keys: DataFrame, model: Model, last: bool = False) -> DataFrame:
    """last: neither the rows nor the model are needed again."""
    n, v, pairs = model.tokens, model.different, model.pairs
    asked = rows.select("block", "row", "doc_id", "text").groupBy("block").cogroup(pairs.answers(keys).groupBy("block"))
    told = stage(asked.applyInArrow(_score(model.hot, n, v, pairs.ranges), SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    if last:
        del asked, keys
        discard(rows)
    tail = told.select("row", F.explode("tail").alias("token")).groupBy("row", "token").agg(F.count("*").alias("times"))
    sums = tail.join(model.counts, "token").groupBy("row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_sum"))
    joined = told.drop("tail").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("hot_sum") + zero("tail_sum") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return joined.select("doc_id", "n_tokens", (F.col("hot_known") + zero("tail_known")).cast("long").alias("n_known"), base.alias("base_score"), "score")


def score(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row."""
    rows = blocks(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(False).alias("trained")))
    return _scored(rows, model.pairs.keys(False).unionByName(model.pairs.keys(True, rows)), model)


def decide(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    fold = lambda c: F.coalesce(F.crc32(c.cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    rows = blocks(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (~fold(F.col(id_col))).alias("trained")))
    model = _fit(rows)
    told = _scored(rows, model.pairs.keys(True), model, last=True)
    return told.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
