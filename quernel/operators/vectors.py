"""Exact and approximate nearest neighbours.

Exact search is an expression and a top-k (TakeOrderedAndProject). A batch sends
its bounded list of queries to every row's task, where each keeps its best k
before anything is shuffled. Approximate search assigns rows to cells of k-means
centroids that are trained on a bounded sample; a search reads the cells nearest
to the query and ranks their rows exactly. Filters apply first, so a filtered
search still gives k rows if the cells hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..functions import distance as d
from ..functions.semistructured import metadata_matches
from ..sources.staging import new_path
from .ranges import positions

#: Queries of one batch, and rows that centroids are trained on.
MAX_QUERIES = 10_000
TRAIN_ROWS = 50_000
#: A batch search of cells goes on to further ones until it has met so many rows for each neighbour wanted.
LEAST_ROWS = 30
#: Queries and rows that meet at once, numbers of the pairs that are scored again at once, and a relative rounding error for each dimension.
BLOCK_QUERIES, BLOCK_ROWS, BLOCK_NUMBERS, ERROR = 256, 4096, 1 << 21, 8 * np.finfo(float).eps


def check_dimension(query: Sequence[float], dim: int | None, which: str = "query") -> None:
    if dim is not None and len(query) != dim:
        raise SchemaError(f"{which} has dimension {len(query)}, not {dim}")


def exact_topk(df: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", vector: str = "vector", id_col: str = "id", where: Column | None = None, payload_filter: dict | None = None, payload: str = "payload") -> DataFrame:
    """The k nearest rows with score, ties by id."""
    if where is not None:
        df = df.where(where)
    if payload_filter:
        df = df.where(metadata_matches(F.col(payload), payload_filter))
    return df.withColumn("score", d.distance(F.col(vector), d.vector(query), metric)).orderBy("score", id_col).limit(k)


def batch_topk(df: DataFrame, queries: Sequence[Sequence[float]], k: int, metric: str = "cosine", vector: str = "vector", id_col: str = "id", where: Column | None = None, dim: int | None = None) -> DataFrame:
    """query (its place in the list), rank, id, score. Each task keeps its own k best of every query, in blocks of matrix products; those meet by query."""
    if len(queries) > MAX_QUERIES:
        raise SchemaError(f"a batch has {MAX_QUERIES} queries at most")
    for i, q in enumerate(queries):
        check_dimension(q, dim, f"query {i}")
    if where is not None:
        df = df.where(where)
    q = np.array(queries, float)
    held = df.sparkSession.sparkContext.broadcast(q)
    id_type = dict(df.dtypes)[id_col]

    def best(batches):
        nearest_rows = Nearest(held.value, k, metric)
        for b in batches:
            nearest_rows.show(b.column(0).to_pylist(), matrix(b.column(1)))
        yield from nearest_rows.batches()

    local = df.where(F.col(vector).isNotNull()).select(id_col, vector).mapInArrow(best, f"query long, id {id_type}, score double")
    w = Window.partitionBy("query").orderBy("score", "id")
    return local.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def in_blocks(queries: DataFrame, id_col: str, vector: str, size: int = MAX_QUERIES):
    """Blocks of (first place, ids, vectors) of a table of queries in order of their ids, size of them in the driver at a time."""
    placed = positions(queries.select(id_col, vector), [id_col], "_at")
    placed = placed.withColumn("_block", F.floor((F.col("_at") - 1) / size))
    n = placed.count()
    for k in range(-(-n // size)):
        rows = placed.where(F.col("_block") == k).orderBy("_at").collect()  # size rows at most
        yield k * size, [r[id_col] for r in rows], [[float(x) for x in r[vector]] for r in rows]


def table_topk(df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", vector: str = "vector", id_col: str = "id", block: int = MAX_QUERIES) -> DataFrame:
    """query (its id), rank, id, score: the nearest rows of every row of a table of queries, in blocks of queries against all rows."""
    out = None
    for first, ids, vectors in in_blocks(queries, id_col, vector, block):
        names = df.sparkSession.createDataFrame(list(enumerate(ids)), f"query long, name {dict(queries.dtypes)[id_col]}")
        found = batch_topk(df, vectors, k, metric, vector, id_col).join(F.broadcast(names), "query").select(F.col("name").alias("query"), "rank", "id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else df.sparkSession.createDataFrame([], f"query {dict(queries.dtypes)[id_col]}, rank long, id {dict(df.dtypes)[id_col]}, score double")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the mean share of the exact neighbours (query, id) that were found."""
    hits = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    each = hits.groupBy("query").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return each.agg(F.count("*").alias("queries"), F.avg("share").alias("recall"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows, without a Python object for each number."""
    if not len(vectors):
        return np.empty((0, 0))
    sizes = set(vectors.value_lengths().unique().to_pylist())
    if len(sizes) > 1 or None in sizes:
        raise SchemaError("vectors of one column have different dimensions")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


class Nearest:
    """The k nearest of the rows shown so far for each query, ties by id.

    Rows and queries meet in blocks of a matrix product of BLOCK_QUERIES x BLOCK_ROWS, whatever their numbers. What the
    product can't rule out, within its rounding error, is scored again pair by pair: the scores that are told come from
    differences, and depend on neither blocks nor tasks.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.q, self.k, self.unit = queries, k, metric == "cosine"
        self.norms = np.linalg.norm(queries, axis=1)
        self.top: list[list] = [[] for _ in queries]
        self.bound = np.full(len(queries), np.inf)  # no row beyond it is among the k; Euclidean distances squared

    def show(self, ids: list, v: np.ndarray, some: np.ndarray | None = None) -> None:
        """some: the queries that these rows are for, else all."""
        some = np.arange(len(self.q)) if some is None else some
        for i in range(0, len(v) if self.k > 0 else 0, BLOCK_ROWS):
            block = v[i : i + BLOCK_ROWS]
            norms = np.linalg.norm(block, axis=1)
            for j in range(0, len(some), BLOCK_QUERIES):
                self._block(ids[i : i + BLOCK_ROWS], block, norms, some[j : j + BLOCK_QUERIES])

    def _block(self, ids: list, v: np.ndarray, norms: np.ndarray, some: np.ndarray) -> None:
        rough, error = self._rough(v, norms, some)
        bound = self.bound[some]
        if len(v) > self.k and not np.isfinite(bound).all():
            bound = np.minimum(bound, np.partition(rough + error, self.k - 1, axis=1)[:, self.k - 1])
        at, row = np.nonzero(rough - error <= bound[:, None])
        pairs = max(1, BLOCK_NUMBERS // max(v.shape[1], 1))
        for i in range(0, len(at), pairs):
            n, r = some[at[i : i + pairs]], row[i : i + pairs]
            scores = self._exact(n, v[r], norms[r])
            starts = [*np.flatnonzero(np.diff(n, prepend=-1)).tolist(), len(n)]
            names = [ids[x] for x in r.tolist()]
            told = list(zip(np.isnan(scores).tolist(), scores.tolist(), names, strict=True))  # NaN comes last
            for a, b in zip(starts, starts[1:], strict=False):
                self.top[n[a]] = found = sorted([*self.top[n[a]], *told[a:b]])[: self.k]
                if len(found) == self.k and not found[-1][0]:
                    self.bound[n[a]] = found[-1][1] if self.unit else found[-1][1] ** 2 * (1 + ERROR)

    def _rough(self, v: np.ndarray, norms: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What orders the rows, by a matrix product, and how far that may be off; NaN is infinite."""
        q, own, most = self.q[some], self.norms[some], ERROR * (v.shape[1] + 8)
        with np.errstate(all="ignore"):
            if self.unit:
                scale = own[:, None] * norms[None, :]
                rough = 1 - np.divide(q @ v.T, scale, out=np.zeros((len(q), len(v))), where=scale > 0)
                error = np.full((1, 1), most)
            else:
                both = (own**2)[:, None] + (norms**2)[None, :]
                rough, error = both - 2 * (q @ v.T), most * both
        rough[~np.isfinite(rough)] = np.inf
        return rough, np.where(np.isfinite(error), error, 0)

    def _exact(self, n: np.ndarray, v: np.ndarray, norms: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            if not self.unit:
                return np.sqrt(((self.q[n] - v) ** 2).sum(1))
            scale = self.norms[n] * norms
            return 1 - np.divide((self.q[n] * v).sum(1), scale, out=np.zeros(len(n)), where=scale > 0)

    def batches(self):
        rows = [(i, n, s) for i, found in enumerate(self.top) for _, s, n in found]
        if rows:
            yield pa.RecordBatch.from_pydict({"query": [r[0] for r in rows], "id": [r[1] for r in rows], "score": [r[2] for r in rows]})


def kmeans(x: np.ndarray, k: int, iterations: int = 20, seed: int = 42) -> np.ndarray:
    """Centroids by k-means++ and Lloyd's steps; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centroids = [x[rng.integers(len(x))]]
    near = ((x - centroids[0]) ** 2).sum(1)
    for _ in range(1, k):
        p = near / near.sum() if near.sum() > 0 else None
        centroids.append(x[rng.choice(len(x), p=p)])
        near = np.minimum(near, ((x - centroids[-1]) ** 2).sum(1))
    c = np.array(centroids, float)
    for _ in range(iterations):
        at = nearest(x, c)
        for j in range(k):
            if (at == j).any():
                c[j] = x[at == j].mean(0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]).argmin(1)


def sample_vectors(df: DataFrame, vector: str, id_col: str, rows: int = TRAIN_ROWS) -> np.ndarray:
    """A bounded sample, the same on every run: rows with the least hashes of their ids."""
    drawn = df.where(F.col(vector).isNotNull()).select(F.xxhash64(id_col).alias("h"), vector).orderBy("h").limit(rows).collect()
    return np.array([r[vector] for r in drawn], float)


class CellIndex:
    """Every row with its cell; once written, a table partitioned by cell, of which a search reads few."""

    def __init__(self, df: DataFrame, centroids: np.ndarray, metric: str, vector: str, id_col: str):
        self.df, self.centroids, self.metric, self.vector, self.id_col = df, centroids, metric, vector, id_col

    @staticmethod
    def build(df: DataFrame, cells: int = 16, metric: str = "cosine", vector: str = "vector", id_col: str = "id", train_rows: int = TRAIN_ROWS, seed: int = 42) -> CellIndex:
        x = sample_vectors(df, vector, id_col, train_rows)
        if metric == "cosine" and len(x):
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = kmeans(x, cells, seed=seed) if len(x) else np.zeros((1, 1))
        held = df.sparkSession.sparkContext.broadcast(c)
        unit = metric == "cosine"

        @F.arrow_udf("int")
        def cell(vectors: pa.Array) -> pa.Array:
            v = matrix(vectors)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if unit else v
            return pa.array(nearest(v, held.value).astype(np.int32))

        return CellIndex(df.where(F.col(vector).isNotNull()).withColumn("cell", cell(F.col(vector))), c, metric, vector, id_col)

    def written(self) -> CellIndex:
        """The index as a table with a folder a cell: a search reads its cells alone."""
        path = new_path(self.df.sparkSession, "cells")
        self.df.write.partitionBy("cell").parquet(path)
        rows = self.df.sparkSession.read.schema(self.df.schema).parquet(path)
        return CellIndex(rows, self.centroids, self.metric, self.vector, self.id_col)

    def search_batch(self, queries: DataFrame, k: int, nprobe: int, block: int = MAX_QUERIES) -> DataFrame:
        """query (its id), rank, id, score for every row of a table of queries, which has this table's id and vector columns. Each task scores a cell's rows for the queries that probe the cell, and keeps its own best."""
        names_type, out = dict(queries.dtypes)[self.id_col], None
        for _, ids, vectors in in_blocks(queries, self.id_col, self.vector, block):
            found = self._probe(np.array(vectors, float), k, nprobe)
            names = self.df.sparkSession.createDataFrame(list(enumerate(ids)), f"query long, name {names_type}")
            found = found.join(F.broadcast(names), "query").select(F.col("name").alias("query"), "rank", "id", "score")
            out = found if out is None else out.unionByName(found)
        return out if out is not None else self.df.sparkSession.createDataFrame([], f"query {names_type}, rank long, id {dict(self.df.dtypes)[self.id_col]}, score double")

    def _probe(self, q: np.ndarray, k: int, nprobe: int) -> DataFrame:
        asks: dict[int, list[int]] = {}
        sizes = {r["cell"]: r["count"] for r in self.df.groupBy("cell").count().collect()}  # a row a cell
        for i, v in enumerate(q):
            held_rows = 0
            for n, c in enumerate(self.cells_of(v, len(self.centroids))):
                if n >= nprobe and held_rows >= LEAST_ROWS * k:
                    break
                held_rows += sizes.get(c, 0)
                asks.setdefault(int(c), []).append(i)
        held = self.df.sparkSession.sparkContext.broadcast((q, {c: np.array(x) for c, x in asks.items()}))
        metric, id_type = self.metric, dict(self.df.dtypes)[self.id_col]

        def best(batches):
            qs, by_cell = held.value
            nearest_rows = Nearest(qs, k, metric)
            for b in batches:
                cells = b.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cells).tolist():
                    if (some := by_cell.get(c)) is not None:
                        at = np.flatnonzero(cells == c)
                        nearest_rows.show(b.column(0).take(pa.array(at)).to_pylist(), matrix(b.column(1).take(pa.array(at))), some)
            yield from nearest_rows.batches()

        near = self.df.where(F.col("cell").isin(*sorted(asks))) if asks else self.df.where("false")
        local = near.select(self.id_col, self.vector, "cell").mapInArrow(best, f"query long, id {id_type}, score double")
        w = Window.partitionBy("query").orderBy("score", "id")  # k rows a task and query
        return local.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)

    def cells_of(self, query: Sequence[float], nprobe: int) -> list[int]:
        q = np.array(query, float)
        q = q / max(np.linalg.norm(q), 1e-12) if self.metric == "cosine" else q
        return np.argsort(((self.centroids - q) ** 2).sum(1))[:nprobe].tolist()

    def search(self, query: Sequence[float], k: int, nprobe: int = 4, where: Column | None = None) -> DataFrame:
        near = self.df.where(F.col("cell").isin(*self.cells_of(query, nprobe)))
        return exact_topk(near, query, k, self.metric, self.vector, self.id_col, where)
