"""Property graphs as two DataFrames, and single-hop matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, EngineError

NODES = "id string, properties map<string,string>"
EDGES = "src string, dst string, label string, properties map<string,string>, seq long"


def properties_text(column: str = "properties"):
    """{k: v, ...} with keys in order."""
    pairs = F.array_sort(F.map_entries(column))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "), F.lit("}"))


def match_edges(edges: DataFrame, source: str | None = None, target: str | None = None, label: str | None = None, properties: dict | None = None) -> DataFrame:
    """from, to, label, properties of the edges that fit: ids and label in any case, every property equal."""
    out = edges
    for column, wanted in (("src", source), ("dst", target), ("label", label)):
        if wanted is not None:
            out = out.where(F.lower(column) == wanted.lower())
    for key, value in (properties or {}).items():
        out = out.where(F.col("properties")[key] == str(value))
    return out.select(F.col("src").alias("from"), F.col("dst").alias("to"), "label", properties_text().alias("properties"))


class Graph:
    def __init__(self, spark: SparkSession, nodes: DataFrame | None = None, edges: DataFrame | None = None):
        self.spark = spark
        self.nodes = nodes if nodes is not None else spark.createDataFrame([], NODES)
        self.edges = edges if edges is not None else spark.createDataFrame([], EDGES)
        self.added = 0

    def add_node(self, id_: str, properties: dict) -> None:
        if not self.nodes.where(F.lower("id") == id_.lower()).isEmpty():
            raise ConflictError(f"node {id_} exists")
        self.nodes = self.nodes.unionByName(self.spark.createDataFrame([(id_, properties)], NODES))

    def add_edge(self, source: str, target: str, label: str | None, properties: dict) -> None:
        for end in (source, target):
            if self.nodes.where(F.lower("id") == end.lower()).isEmpty():
                raise EngineError(f"no node {end}")
        self.added += 1
        self.edges = self.edges.unionByName(self.spark.createDataFrame([(source, target, label, properties, self.added)], EDGES))

    def add_edges(self, edges: DataFrame) -> None:
        """Many at once; edges without both ends are an error."""
        ids = self.nodes.select(F.lower("id").alias("_id"))
        for end in ("src", "dst"):
            if not edges.join(ids, F.lower(end) == F.col("_id"), "left_anti").isEmpty():
                raise EngineError(f"an edge has an unknown {end}")
        self.edges = self.edges.unionByName(edges, allowMissingColumns=True)

    def match(self, **wanted) -> DataFrame:
        return match_edges(self.edges.orderBy("seq"), **wanted)
