"""Fixpoints: recursive queries with set semantics, and reachability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..sources.staging import stage, written


def same_row(a: DataFrame, b: DataFrame):
    cond = F.lit(True)
    for x, y in zip(a.columns, b.columns, strict=True):
        cond = cond & a[x].eqNullSafe(b[y])
    return cond


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], linear: bool = False) -> DataFrame:
    """Rows of anchor (repeats stay), and all that step gives of what there is, until nothing is new. Ends on cycles. A linear step, which reads the rows once, is given only the newest ones. Each round writes what is new, so neither lineage nor what is written twice grows."""
    spark = anchor.sparkSession
    paths = [written(anchor, "fixpoint")]
    first = spark.read.schema(anchor.schema).parquet(paths[0])
    newest = first
    while True:
        rows = spark.read.schema(first.schema).parquet(*paths)
        found = step(newest if linear else rows)
        if len(found.columns) != len(first.columns):
            raise SchemaError("both sides of UNION ALL have as many columns")
        found = found.toDF(*first.columns).select(*[F.col(f"`{c}`").cast(t) for c, t in first.dtypes]).distinct()
        path = written(found.join(rows, same_row(found, rows), "left_anti"), "fixpoint-new")
        newest = spark.read.schema(first.schema).parquet(path)
        if newest.isEmpty():
            return rows
        paths.append(path)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): what each start reaches by one edge or more; edges has src and dst, starts has start. Only the newest rows are followed each round."""
    e = edges.select("src", "dst").distinct()
    rows = stage(starts.join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node")).distinct(), "reach")
    front = rows
    while not front.isEmpty():
        found = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = stage(found.join(rows, ["start", "node"], "left_anti"), "reach-new")
        rows = stage(rows.unionByName(front), "reach") if not front.isEmpty() else rows
    return rows


def on_cycle(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: the deadlock test of a wait-for graph.

    Strong components, a round at a time: edges whose source nothing enters or whose target nothing leaves are
    trimmed; then every node takes the greatest node that reaches it, and those that reach that node back inside its
    colour are its component. Edges inside components and between colours go, and the rest starts over. No pairs of
    nodes are ever listed.
    """
    e = stage(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "cycle-edges")
    found = [e.where("src = dst").select(F.col("src").alias("node"))]
    e = e.where("src <> dst")
    while True:
        e = _trimmed(e)
        if e.isEmpty():
            break
        colours = _greatest(e)
        inside = e.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        inside = stage(inside.select("src", "dst", F.col("a").alias("colour")), "cycle-inside")
        back = _back(inside)
        found.append(back.select("node"))
        left = inside.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti")
        e = stage(left.select("src", "dst"), "cycle-edges")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: their source is entered and their target left by others of them."""
    n = e.count()
    while n:
        enters, leaves = e.select(F.col("dst").alias("n")).distinct(), e.select(F.col("src").alias("n")).distinct()
        both = enters.join(leaves, "n")
        e = stage(e.join(both, F.col("src") == F.col("n"), "left_semi").join(both, F.col("dst") == F.col("n"), "left_semi"), "cycle-trim")
        n, before = e.count(), n
        if n == before:
            break
    return e


def _greatest(e: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that reaches each node, itself included. Only nodes that changed send on."""
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    held = stage(nodes.withColumn("colour", F.col("node")).withColumn("new", F.lit(True)), "cycle-colours")
    while not held.where("new").isEmpty():
        sent = held.where("new").join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.max("colour").alias("got"))
        grown = F.col("got") > F.col("colour")
        held = stage(held.join(sent, F.col("node") == F.col("to"), "left").select("node", F.greatest("colour", "got").alias("colour"), F.coalesce(grown, F.lit(False)).alias("new")), "cycle-colours")
    return held.select("node", "colour")


def _back(inside: DataFrame) -> DataFrame:
    """Nodes that reach the node their colour is named after, by edges inside the colour."""
    front = stage(inside.where("dst = colour").select(F.col("colour").alias("node"), "colour").distinct(), "cycle-back")
    paths = front
    while not front.isEmpty():
        came = inside.join(front.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
        front = stage(came.join(paths, ["node", "colour"], "left_anti"), "cycle-back")
        paths = stage(paths.unionByName(front), "cycle-back") if not front.isEmpty() else paths
    return paths
