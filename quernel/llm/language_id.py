"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the cosine of their sets of character n-grams, blended
over all lengths up to ``NGRAM`` (presence, not counts; lower case). A bounded
labelled sample gives landmarks, whose kernel matrix maps every text to as many
features as there are landmarks; ridge regression on them, one language versus
the rest, is solved in closed form. As the cosine is linear in a text's set but
for its norm, landmarks, map and regression multiply out to one weight an n-gram
and language: a batch of texts is scored as one product of its 0/1 matrix of
n-grams with that table. N-grams count when ``LEAST_LANDMARKS`` landmarks hold
them; they are told apart by ``TABLE`` hash values.

The fit takes ``SAMPLE_ROWS`` different labelled texts at most, evenly for the
languages: of each, those with the least hashes, a text counted once however often
it is repeated. They are drawn without writing any table. Every text is scored
whole, in one pass without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text when nothing can be learnt; rows with a null language, and a null
id, are scored but not learnt from; equal scores go to the language with more
rows, then by name; rows that are alike get alike predictions; texts of any
length are read whole; an empty table gives an empty result; other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, text_or_empty

NGRAM = 4
TABLE = 1 << 20
SAMPLE_ROWS = 1600
LANDMARKS = 160
LEAST_LANDMARKS = 3
RIDGE = 1e-2
SHARPNESS = 6.0
FOLDS = 5
BATCH = 128


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")


def ngrams(text: str) -> np.ndarray:
    """The hash value of every n-gram of every length, with repeats."""
    c = codes(text)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, min(NGRAM, len(c)) + 1):
        h = h[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
        out.append((h ^ (h >> np.uint32(15))) & np.uint32(TABLE - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _sets(batches):
    for b in batches:
        got = [np.unique(ngrams(t)).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("by"), pa.array(got, pa.binary())], names=["lang", "by", "grams"])


class Model:
    """feature: the column of each hash value, or -1; weights: (features, languages)."""

    def __init__(self, languages: list[str], feature: np.ndarray, weights: np.ndarray):
        self.languages, self.feature, self.weights = languages, feature, weights

    def matrix(self, grams: list[np.ndarray]) -> np.ndarray:
        m = np.zeros((len(grams), len(self.weights)), np.float32)
        for row, g in zip(m, grams, strict=True):
            f = self.feature[g]
            row[f[f >= 0]] = 1
        return m

    def margins(self, texts: list[str]) -> np.ndarray:
        m = self.matrix([ngrams(t) for t in texts])
        norm = np.sqrt(np.maximum(m.sum(axis=1, keepdims=True), 1))
        return (m @ self.weights) / norm

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for i in range(0, len(at), BATCH):
            some = at[i : i + BATCH]
            m = self.margins([texts[k] for k in some]).astype(float)
            e = np.exp(SHARPNESS * (m - m.max(axis=1, keepdims=True)))
            best = m.argmax(axis=1)
            for k, b, s in zip(some, best, e.max(axis=1) / e.sum(axis=1), strict=True):
                langs[k], scores[k] = self.languages[b], float(s)
        return langs, scores


def fit(grams: list[np.ndarray], langs: list[str], languages: list[str], landmarks: int = LANDMARKS) -> Model:
    """grams in a fixed order; languages, the most frequent first."""
    each = max(1, landmarks // len(languages))
    marks = [i for lang in languages for i in [k for k, x in enumerate(langs) if x == lang][:each]]
    seen = np.bincount(np.concatenate([grams[i] for i in marks]), minlength=TABLE)
    kept = np.flatnonzero(seen >= min(LEAST_LANDMARKS, len(marks)))
    feature = np.full(TABLE, -1, np.int32)
    feature[kept] = np.arange(len(kept))
    model = Model(languages, feature, np.zeros((len(kept), len(languages)), np.float32))

    def unit(some):
        m = model.matrix(some)
        return m / np.sqrt(np.maximum(m.sum(axis=1, keepdims=True), 1))

    marked = unit([grams[i] for i in marks])
    values, vectors = np.linalg.eigh((marked @ marked.T).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    phi = np.vstack([unit(grams[i : i + BATCH]) @ marked.T for i in range(0, len(grams), BATCH)]) @ root
    y = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in langs])
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(phi) / len(marks) * np.eye(phi.shape[1]), phi.T @ y)
    model.weights = (marked.T @ (root @ w)).astype(np.float32)
    return model


def train(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learns from rows outside the held-out fold; None where there are none."""
    known = df.where(F.crc32(F.col(id_col).cast("string")) % FOLDS != 0).select(F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text")).where("lang is not null")
    told = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("text").alias("different")).collect()  # a row a language
    if not told:
        return None
    counts = {r["lang"]: r["n"] for r in told}
    languages = sorted(counts, key=lambda k: (-counts[k], k))
    most = max(1, sample_rows // len(languages))
    different = df.sparkSession.createDataFrame(pa.table({k: [r[k] for r in told] for k in ("lang", "different")}))  # from Arrow: no Python workers
    known = known.withColumn("by", F.md5("text"))
    # about twice what is wanted, by the hash itself, of which the least are taken: no language is ordered whole
    place = F.conv(F.substring("by", 1, 8), 16, 10).cast("double") / float(1 << 32)
    few = known.join(F.broadcast(different), "lang").where(place * F.col("different") < 2.0 * most + 20).select("lang", "by").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("by"))
    drawn = few.withColumn("nth", nth).where(F.col("nth") <= most).select("lang", "by")  # sample_rows at most
    sample = known.join(F.broadcast(drawn), ["lang", "by"]).dropDuplicates(["lang", "by"])
    rows = sample.select("lang", "text", "by").mapInArrow(_sets, "lang string, by string, grams binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["by"], r["lang"]))
    return fit([np.frombuffer(bytes(r["grams"]), "<u4") for r in rows], [r["lang"] for r in rows], languages)


def decide(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = train(df, text_col, id_col, lang_col, sample_rows)
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out")
    if model is None:
        return df.select(F.col(id_col).alias("doc_id"), held_out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            langs, scores = held.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    told = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(lean(run), "doc_id long, lang_pred string, score double")
    return told.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
