"""Product and scalar quantization. Training takes a bounded sample or one aggregate; codes are column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as d
from .vectors import MAX_QUERIES, exact_topk, in_blocks, kmeans, nearest, sample_vectors


def train_scalar(df: DataFrame, vector: str = "vector") -> DataFrame:
    """dim, lo, hi, scale: 255 over the range, 0 for a constant dimension."""
    x = df.select(F.posexplode(vector).alias("dim", "v")).groupBy(F.col("dim").cast("bigint").alias("dim")).agg(F.min(F.col("v").cast("double")).alias("lo"), F.max(F.col("v").cast("double")).alias("hi"))
    span = F.col("hi") - F.col("lo")
    return x.withColumn("scale", F.when(span > 1.1920929e-07, 255.0 / span).otherwise(0.0))


class Scalar:
    def __init__(self, lo: Sequence[float], scale: Sequence[float]):
        self.lo, self.scale = list(map(float, lo)), list(map(float, scale))

    @staticmethod
    def train(df: DataFrame, vector: str = "vector") -> Scalar:
        rows = train_scalar(df, vector).orderBy("dim").collect()  # a row a dimension
        return Scalar([r["lo"] for r in rows], [r["scale"] for r in rows])

    def distance(self, codes: Column, query: Sequence[float], metric: str = "euclidean") -> Column:
        """Distance of a whole query to a coded vector, by what the codes stand for."""
        return d.distance(self.decode(codes), d.vector(query), metric)

    def _params(self) -> Column:
        return F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("scale")) for a, b in zip(self.lo, self.scale, strict=True)])

    def encode(self, v: Column) -> Column:
        """Codes 0 to 255; values outside the range are clamped, of a constant dimension to 0 or 255."""
        def one(x, p):
            scaled = (x.cast("double") - p["lo"]) * p["scale"]
            flat = F.when(x.cast("double") > p["lo"], F.lit(255)).otherwise(F.lit(0))
            return F.when(p["scale"] == 0, flat).otherwise(F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0))).cast("int"))

        return F.zip_with(v, self._params(), one)

    def decode(self, codes: Column) -> Column:
        return F.zip_with(codes, self._params(), lambda c, p: p["lo"] + F.when(p["scale"] == 0, F.lit(0.0)).otherwise(c / p["scale"]))


class Product:
    """Codebooks of m sub-vectors, ksub centroids each."""

    def __init__(self, books: np.ndarray):
        self.books = books  # (m, ksub, dsub)

    @staticmethod
    def train(df: DataFrame, m: int = 8, ksub: int = 16, vector: str = "vector", id_col: str = "id", iterations: int = 15, sample: int = 20_000) -> Product:
        x = sample_vectors(df, vector, id_col, sample)
        if x.shape[1] % m:
            raise ValueError(f"dimension {x.shape[1]} is not a multiple of {m}")
        parts = np.split(x, m, axis=1)
        return Product(np.array([np.vstack([c := kmeans(p, ksub, iterations, seed=42 + i), np.repeat(c[-1:], ksub - len(c), axis=0)]) for i, p in enumerate(parts)]))

    def encode(self, v: Column) -> Column:
        """The nearest centroid of each sub-vector."""
        books = self.books

        @F.arrow_udf("array<int>")
        def code(vectors: pa.Array) -> pa.Array:
            x = np.array(vectors.to_pylist(), float)
            parts = np.split(x, len(books), axis=1)
            return pa.array(np.column_stack([nearest(p, c) for p, c in zip(parts, books, strict=True)]).astype(np.int32).tolist(), pa.list_(pa.int32()))

        return code(v)

    def decode(self, codes: Column) -> Column:
        lits = [F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in book]) for book in self.books]
        return F.flatten(F.array(*[F.get(book, F.get(codes, F.lit(i))) for i, book in enumerate(lits)]))

    def asymmetric(self, codes: Column, query: Sequence[float], metric: str = "euclidean") -> Column:
        """Distance of a whole query to a coded vector, from tables of the query's distances to the centroids; equals the distance to the decoded vector."""
        q = np.array(query, float).reshape(len(self.books), -1)
        look = lambda table: sum((F.get(F.array(*[F.lit(float(x)) for x in row]), F.get(codes, F.lit(i))) for i, row in enumerate(table)), F.lit(0.0))
        if metric == "euclidean":
            return F.sqrt(look(((self.books - q[:, None, :]) ** 2).sum(2)))
        dots, norms = look((self.books * q[:, None, :]).sum(2)), look((self.books**2).sum(2))
        scale = F.sqrt(norms) * F.lit(float(np.linalg.norm(q)))
        similarity = F.least(F.greatest(dots / scale, F.lit(-1.0)), F.lit(1.0))
        return F.when(scale > 0, 1 - similarity).otherwise(1.0)


def search(df: DataFrame, product: Product, query: Sequence[float], k: int, again: int = 20, vector: str = "vector", id_col: str = "id", metric: str = "euclidean") -> DataFrame:
    """The k nearest rows: again * k by their codes, which are ranked by their whole vectors."""
    coded = df.withColumn("_near", product.asymmetric(product.encode(F.col(vector)), query, metric))
    few = coded.orderBy("_near", id_col).limit(again * k).drop("_near")
    return exact_topk(few, query, k, metric, vector, id_col)


def search_batch(df: DataFrame, product: Product, queries: DataFrame, k: int, again: int = 20, vector: str = "vector", id_col: str = "id", block: int = MAX_QUERIES) -> DataFrame:
    """query (its id), rank, id, score for every row of a table of queries: each task takes its best again * k by codes and ranks them by their whole vectors (Euclidean)."""
    spark, out = df.sparkSession, None
    names_type, id_type = dict(queries.dtypes)[id_col], dict(df.dtypes)[id_col]
    for _, ids, vectors in in_blocks(queries, id_col, vector, block):
        q = np.array(vectors, float)
        split = q.reshape(len(q), len(product.books), -1)
        tables = ((product.books[None] - split[:, :, None, :]) ** 2).sum(3)  # queries, parts, centroids
        held = spark.sparkContext.broadcast((q, product.books, tables))

        def best(batches, held=held):
            qs, books, near = held.value
            top: list[list] = [[] for _ in qs]
            for b in batches:
                x = np.array(b.column(1).to_pylist(), float)
                if not len(x):
                    continue
                names = b.column(0).to_pylist()
                codes = [nearest(p, c) for p, c in zip(np.split(x, len(books), axis=1), books, strict=True)]
                for i in range(len(qs)):
                    rough = sum(near[i, j][c] for j, c in enumerate(codes))
                    few = np.argpartition(rough, again * k)[: again * k] if len(rough) > again * k else np.arange(len(rough))
                    exact = np.sqrt(((x[few] - qs[i]) ** 2).sum(1))
                    top[i] = sorted([*top[i], *zip(exact.tolist(), [names[j] for j in few], strict=True)])[:k]
            rows = [(i, n, s) for i, found in enumerate(top) for s, n in found]
            if rows:
                yield pa.RecordBatch.from_pydict({"query": [r[0] for r in rows], "id": [r[1] for r in rows], "score": [r[2] for r in rows]})

        local = df.where(F.col(vector).isNotNull()).select(id_col, vector).mapInArrow(best, f"query long, id {id_type}, score double")
        w = Window.partitionBy("query").orderBy("score", "id")
        names = spark.createDataFrame(list(enumerate(ids)), f"query long, name {names_type}")
        found = local.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).join(F.broadcast(names), "query").select(F.col("name").alias("query"), "rank", "id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query {names_type}, rank long, id {id_type}, score double")


def hybrid_codes(v: Column, product: Product, scalar: Scalar, threshold: int) -> Column:
    """Product codes for vectors of the threshold's length or more, scalar codes for shorter ones."""
    return F.when(F.size(v) >= threshold, product.encode(v)).otherwise(scalar.encode(v))
