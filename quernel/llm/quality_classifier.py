"""Compression classifier: Zstandard dictionaries of good and of bad text, and a calibrated difference of sizes.

A text is cut into blocks, and every block is compressed twice, with a raw
dictionary of blocks from texts labelled good and with one from texts labelled
bad. The difference of the summed sizes over the larger sum is how much better
the good dictionary explains the text. It is taken in two views, of the bytes as
they are and of their shape (letters, capitals, digits; other bytes stay), and a
logistic curve fitted to held-back labelled rows turns the two differences into
the probability of a good label.

Texts labelled bad often hold good passages, so the bad dictionary is built
twice: the second takes the half of the blocks that the first pair finds worst.

The fit takes at most ``SAMPLE_ROWS`` labelled rows a label, the first by a hash
of their ids, half of them for dictionaries (``BLOCKS_A_ROW`` blocks a row) and
half for the curve; what is broadcast is four dictionaries of ``DICTIONARY``
bytes. Every text is scored whole, in one pass without a shuffle.

Defined cases: a null text counts as empty, and an empty text has differences of
0; where a label has no rows to learn from, the score is the other label's; a null
id is neither held out nor learnt from; labels other than 0 and 1 are left out;
rows that are alike get alike scores, each a row of its own; a score of exactly the
threshold is predicted 1; of equal hashes the lesser id is learnt from first; texts
of any length are scored whole; an empty table gives an empty result; other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SAMPLE_ROWS = 4000
BLOCKS_A_ROW = 6
BLOCK = 256
DICTIONARY = 1 << 16
LEVEL = 5
FOLDS = 5
THRESHOLD = 0.3
#: Bytes of a frame's header, the same for every block.
HEADER = 9
SHAPE = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
VIEWS = (lambda b: b, lambda b: b.translate(SHAPE))


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


@cache
def compressor(dictionary: bytes):
    import zstandard

    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(parts: list[bytes], bad: bytes, good: bytes) -> float:
    """(bad - good) / max of the compressed sizes; above 0 the good dictionary does better."""
    b, g = (sum(len(c.compress(x)) - HEADER for x in parts) for c in (compressor(bad), compressor(good)))
    return (b - g) / max(b, g, 1)


def differences(text: str | None, dictionaries: list[tuple[bytes, bytes]]) -> list[float]:
    data = (text or "").encode("utf-8", "replace")
    return [difference(blocks(view(data)), *pair) for view, pair in zip(VIEWS, dictionaries, strict=True)]


def _draw(batches):
    """A row's blocks: those whose hash with their place is least, the same on every run."""
    for b in batches:
        out = [[], []]
        for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
            parts = blocks((text or "").encode("utf-8", "replace"))
            order = sorted(range(len(parts)), key=lambda i: hashlib.md5(b"%d|" % i + parts[i]).digest())
            for i in order[:BLOCKS_A_ROW]:
                out[0].append(label)
                out[1].append(parts[i])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["label", "block"])


def build_dictionaries(good: list[bytes], bad: list[bytes]) -> list[tuple[bytes, bytes]]:
    """(bad, good) for each view."""
    spread = lambda xs: sorted(xs, key=lambda x: hashlib.md5(x).digest())
    out = []
    for view in VIEWS:
        g, b = ([view(x) for x in spread(xs)] for xs in (good, bad))
        goods, bads = b"".join(g)[:DICTIONARY], b"".join(b)[:DICTIONARY]
        worst = sorted(b, key=lambda x: difference([x], bads, goods))[: (len(b) + 1) // 2]
        out.append((b"".join(spread(worst))[:DICTIONARY], goods))
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with intercept, by Newton's steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        move = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def _features(held):
    def run(batches):
        for b in batches:
            d = [differences(t, held.value) for t in b.column("text").to_pylist()]
            cols = [pa.array([x[i] for x in d], pa.float64()) for i in range(len(VIEWS))]
            yield pa.RecordBatch.from_arrays([*b.select([c for c in b.schema.names if c != "text"]).columns, *cols], names=[*(c for c in b.schema.names if c != "text"), "raw", "shape"])

    return run


class Model:
    def __init__(self, dictionaries, weights):
        self.dictionaries, self.weights = dictionaries, weights

    def score(self, raw: Column, shape: Column) -> Column:
        w = [float(v) for v in self.weights]
        return 1 / (1 + F.exp(-(raw * w[0] + shape * w[1] + w[2])))


def fit(labelled: DataFrame) -> Model | float:
    """labelled has label (0 or 1), half (0 or 1) and text, a bounded number of rows; the share of label 1 (or 0.5) where one label is missing."""
    spark = labelled.sparkSession
    found = labelled.where("half = 0").select("label", "text").mapInArrow(_draw, "label int, block binary").collect()
    good, bad = ([bytes(r.block) for r in found if r.label == k] for k in (1, 0))
    if not good or not bad:
        return 1.0 if good else 0.0 if bad else 0.5
    dictionaries = build_dictionaries(good, bad)
    held = spark.sparkContext.broadcast(dictionaries)
    rows = labelled.where("half = 1").select("label", "text").mapInArrow(_features(held), "label int, raw double, shape double").collect()
    rows.sort()
    x, y = np.array([[r.raw, r.shape] for r in rows]).reshape(-1, 2), np.array([r.label for r in rows], float)
    return Model(dictionaries, fit_curve(x, y) if 0 < y.sum() < len(y) else np.array([10.0, 10.0, 0.0]))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most sample_rows labelled ids a label, outside the held-out fold, with their texts; staged."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).withColumn("by", F.md5(F.col("doc_id").cast("string")))
    parts = [known.where(F.col("label") == k).orderBy("by", "doc_id").limit(sample_rows) for k in (0, 1)]
    ids = parts[0].unionByName(parts[1]).withColumn("half", F.conv(F.substring("by", 1, 1), 16, 10).cast("int") % 2).drop("by")
    return stage(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "half", "text"), "quality-sample")  # 2 * sample_rows ids at most


def decide(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = fit(training_rows(docs, labels, sample_rows))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out")
    if isinstance(model, float):
        scored = docs.select("doc_id", held_out, F.lit(model).alias("score"))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model.dictionaries)
        told = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_features(held), "doc_id long, raw double, shape double")
        scored = told.select("doc_id", held_out, model.score(F.col("raw"), F.col("shape")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
