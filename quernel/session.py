"""The engine's session: one registry of tables, views, graphs and collections, and statements on them.

Tables are Parquet in the shared folder. An INSERT validates its whole batch and
appends one file set; a MERGE writes the table anew. Queries give lazy DataFrames.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConflictError, EngineError, SchemaError
from .operators import graph, joins, ranges, recursive, statistics
from .operators.merge import merge
from .operators.partitioning import LABEL, Scheme
from .operators.predicates import Binder
from .plans import estimator
from .sources.collections import Collection
from .sources.external import ExternalSource, FrameSource
from .sources.staging import new_path, stage
from .sql import ast
from .sql.parser import parse
from .types import SPARK, coerce, kind_of, kind_of_spark

#: The hidden column of a table's row order: the batch that brought the row, and its place there.
SEQ = "__seq"
SEQ_TYPE = "struct<batch: bigint, place: bigint>"
STATS_TABLES = ("table_statistics", "column_statistics")


@dataclass
class Table:
    name: str
    kinds: dict[str, str]  # column: kind
    df: DataFrame
    rows_in: int = 0
    scheme: Scheme | None = None
    path: str | None = None
    external: ExternalSource | None = None
    spark_types: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return list(self.kinds)

    def types(self) -> dict[str, str]:
        return self.spark_types or {c: SPARK[k] for c, k in self.kinds.items()}


@dataclass(frozen=True)
class Execution:
    """How scans run: mode auto, vectorized or row; rows of a batch; partitions of a shuffle; a partition of so many times the median is skewed."""

    mode: str = "auto"
    batch_size: int = 4096
    parallelism: int | None = None
    skew: float = 5.0


@dataclass
class View:
    name: str
    query: ast.Select
    synchronous: bool
    table: Table
    pending_since: float | None = None


@dataclass
class CachedResult:
    """A query's result: its plan at first, and written rows from the first hit on, which later hits read."""

    df: DataFrame
    reads: set[str]
    written: bool = False

    def again(self) -> DataFrame:
        if not self.written:
            self.df, self.written = stage(self.df, "result"), True
        return self.df


class Engine:
    def __init__(self, spark: SparkSession, async_delay: float = 0.05):
        self.spark, self.async_delay = spark, async_delay
        self.tables: dict[str, Table] = {}
        self.views: dict[str, View] = {}
        self.graphs: dict[str, graph.Graph] = {}
        self.collections: dict[str, Collection] = {}
        self.stats: dict[str, tuple[int, float, list[dict], int]] = {}  # table: rows, analyzed at, columns, version
        self.histograms: dict[tuple[str, str], list[tuple[float, float, int]]] = {}
        self.cache: dict[ast.Query, CachedResult] = {}
        self.hits = self.misses = 0
        self.execution, self._last = Execution(), None

    # -- execution

    def set_execution(self, execution: Execution) -> None:
        """Settings of the session that later queries run with."""
        if execution.mode not in ("auto", "vectorized", "row"):
            raise EngineError(f"unknown mode {execution.mode}")
        conf = self.spark.conf
        conf.set("spark.sql.parquet.enableVectorizedReader", str(execution.mode != "row").lower())
        conf.set("spark.sql.parquet.columnarReaderBatchSize", str(max(1, execution.batch_size)))
        conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", str(max(1.0, execution.skew)))
        if execution.parallelism is not None:
            conf.set("spark.sql.shuffle.partitions", str(max(1, execution.parallelism)))
        self.execution = execution

    def measured(self, df: DataFrame, name: str = "rows") -> DataFrame:
        """df, whose rows are counted while it runs; `last_execution` tells the number afterwards."""
        from pyspark.sql import Observation

        seen = Observation(name)
        self._last = (seen, df.rdd.getNumPartitions() if df.isStreaming is False else 0)
        return df.observe(seen, F.count(F.lit(1)).alias("output_rows"))

    def last_execution(self) -> dict:
        """output_rows and partitions of the last measured query that ran."""
        if self._last is None:
            return {"output_rows": 0, "partitions": 0}
        seen, partitions = self._last
        return {**seen.get, "partitions": partitions}

    # -- registry

    def register(self, name: str, source: DataFrame | ExternalSource) -> None:
        """A table that is read only: a DataFrame or an external source."""
        external = FrameSource(source) if isinstance(source, DataFrame) else source
        df = external.read(self.spark)
        self.tables[name.lower()] = Table(name, {c: kind_of_spark(t) for c, t in df.dtypes}, df, external=external, spark_types=dict(df.dtypes))

    def _resolve(self, name: str, ctes: dict[str, Table]) -> Table:
        key = name.lower()
        if key in ctes:
            return ctes[key]
        if key in self.views:
            return self.views[key].table
        if key in self.tables:
            return self.tables[key]
        if key in STATS_TABLES:
            return self._of_frame(name, self.statistics(key))
        raise EngineError(f"unknown table {name}")

    def _of_frame(self, name: str, df: DataFrame) -> Table:
        return Table(name, {c: kind_of_spark(t) for c, t in df.dtypes if c not in (SEQ, LABEL)}, df, spark_types={c: t for c, t in df.dtypes if c not in (SEQ, LABEL)})

    # -- statements

    def execute(self, sql: str) -> DataFrame | None:
        """A DataFrame for a query, None for a statement that only changes something."""
        self.run_pending_refreshes()
        s = parse(sql)
        return getattr(self, f"_{type(s).__name__.lower()}")(s)

    def _query(self, q: ast.Query) -> DataFrame:
        cacheable = not q.ctes and not self._reads_external(q.select)
        key = self._normal(q)
        if cacheable and key in self.cache:
            self.hits += 1
            return self.cache[key].again()
        out = self.select(q.select, self._materialize(q.ctes, q.recursive))
        if cacheable:
            self.misses += 1
            self.cache[key] = CachedResult(out, self._reads(q.select))
        return out

    def _normal(self, q: ast.Query) -> ast.Query:
        """Names in lower case, so that queries that differ in case alone share a result."""

        def lower(x):
            if isinstance(x, ast.ColumnItem):
                return ast.ColumnItem(x.name.lower())
            if isinstance(x, ast.RowNumber):
                return replace(x, partition=x.partition and x.partition.lower(), order=x.order.lower())
            if isinstance(x, ast.Logic):
                return replace(x, parts=tuple(map(lower, x.parts)))
            if isinstance(x, ast.InColumn):
                return ast.InColumn(x.column.lower(), x.table.lower(), x.other.lower())
            return replace(x, column=x.column.lower()) if isinstance(x, ast.Predicate) else x

        s = q.select
        return ast.Query(replace(s, table=s.table.lower(), items=s.items and tuple(map(lower, s.items)), predicate=s.predicate and lower(s.predicate), order=tuple((c.lower(), d) for c, d in s.order)))

    def _reads(self, s: ast.Select) -> set[str]:
        out = {s.table.lower()}

        def walk(p):
            if isinstance(p, ast.InColumn):
                out.add(p.table.lower())
            if isinstance(p, ast.Logic):
                for x in p.parts:
                    walk(x)

        walk(s.predicate)
        view = self._covering(s)
        return out | ({view.name.lower()} if view else set())

    def _reads_external(self, s: ast.Select) -> bool:
        return any(t in self.tables and self.tables[t].external for t in self._reads(s))

    def cache_stats(self) -> dict:
        return {"hits": self.hits, "misses": self.misses, "entries": len(self.cache), "written": sum(c.written for c in self.cache.values())}

    def _covering(self, s: ast.Select) -> View | None:
        """A view whose definition is this query."""
        wanted = self._normal(ast.Query(s))
        return next((v for v in self.views.values() if self._normal(ast.Query(v.query)) == wanted), None)

    def select(self, s: ast.Select, ctes: dict[str, Table] | None = None, use_views: bool = True, keep_order: bool = False) -> DataFrame:
        """keep_order: with the hidden column of the rows' order, if the table has one."""
        ctes = ctes or {}
        view = self._covering(s) if use_views and s.table.lower() not in ctes else None
        if view is not None:
            return view.table.df.select(*view.table.columns)
        t = self._resolve(s.table, ctes)
        df = t.df
        known = {c.lower(): (c, k, t.types()[c]) for c, k in t.kinds.items()}
        if s.predicate is not None:
            if t.scheme is not None and (labels := t.scheme.touched(s.predicate)) is not None:
                df = df.where(F.col(LABEL).isin(*labels)) if labels else df.where("false")
            df = self._where(df, s.predicate, Binder(known), ctes)
        out = []
        for item in s.items or [ast.ColumnItem(c) for c in t.columns]:
            if isinstance(item, ast.RowNumber):
                # places by range of the order, so that neither a whole table nor one hot group is numbered in a task
                real = lambda name: known[name.lower()][0]
                Binder(known).column(item.order)
                by = [real(item.partition)] if item.partition and Binder(known).column(item.partition) else []
                tie = [SEQ] if SEQ in df.columns else [c for c in t.columns if t.kinds[c] not in ("GEOMETRY",) and c != real(item.order)]
                number = f"__number{len(out)}"
                df = ranges.numbered(df, by, [real(item.order), *tie], number)
                out.append(F.col(number).cast("bigint").alias(item.alias))
            else:
                out.append(Binder(known).column(item.name)[0])
        if s.order:
            df = df.orderBy(*[(F.desc_nulls_last if down else F.asc_nulls_first)(known[c.lower()][0]) for c, down in s.order])
        df = df.select(*out, *([SEQ] if keep_order and SEQ in df.columns else []))
        df = df.offset(s.offset) if s.offset else df
        return df.limit(s.limit) if s.limit is not None else df

    def _where(self, df: DataFrame, p: ast.Predicate, binder: Binder, ctes: dict[str, Table]) -> DataFrame:
        """Semi-joins stand alone or in a conjunction; all else is one filter."""
        parts = p.parts if isinstance(p, ast.Logic) and p.op == "and" else (p,)
        for x in parts:
            if isinstance(x, ast.InColumn):
                other = self._resolve(x.table, ctes)
                name = next((c for c in other.columns if c.lower() == x.other.lower()), None)
                if name is None:
                    raise SchemaError(f"unknown column {x.other}")
                df = joins.semi_join(df, other.df, binder.columns[x.column.lower()][0] if x.column.lower() in binder.columns else binder.column(x.column), name)
            else:
                df = df.where(binder.bind(x))
        return df

    def _materialize(self, ctes: tuple, is_recursive: bool) -> dict[str, Table]:
        known: dict[str, Table] = {}
        for c in ctes:
            if c.step is None:
                known[c.name.lower()] = self._of_frame(c.name, self.select(c.query, known, keep_order=True))
                continue
            anchor = self.select(c.query, known)

            def step(rows, c=c):
                return self.select(c.step, known | {c.name.lower(): self._of_frame(c.name, rows)})

            known[c.name.lower()] = self._of_frame(c.name, recursive.fixpoint(anchor, step, self._reads_times(c.step, c.name) == 1))
        return known

    @staticmethod
    def _reads_times(s: ast.Select, name: str) -> int:
        def times(p) -> int:
            if isinstance(p, ast.InColumn):
                return p.table.lower() == name.lower()
            return sum(map(times, p.parts)) if isinstance(p, ast.Logic) else 0

        return (s.table.lower() == name.lower()) + times(s.predicate)

    def _createtable(self, s: ast.CreateTable) -> None:
        key = s.name.lower()
        if key in self.tables or key in self.views or key in STATS_TABLES:
            raise ConflictError(f"table {s.name} exists")
        kinds = {c: kind_of(t) for c, t in s.columns}
        if len({c.lower() for c, _ in s.columns}) < len(s.columns):
            raise SchemaError("two columns have one name")
        scheme = None
        if s.partitioning is not None:
            column = next((c for c in kinds if c.lower() == s.partitioning.column.lower()), None)
            if column is None:
                raise SchemaError(f"unknown column {s.partitioning.column}")
            scheme = Scheme.of(replace(s.partitioning, column=column), kinds[column])
        t = Table(s.name, kinds, self.spark.createDataFrame([], self._schema(kinds, scheme)), scheme=scheme, path=new_path(self.spark, f"table-{s.name}"))
        self.tables[key] = t

    def _schema(self, kinds: dict[str, str], scheme: Scheme | None = None) -> T.StructType:
        cols = ", ".join(f"`{c}` {SPARK[k]}" for c, k in kinds.items())
        return T._parse_datatype_string(f"{cols}, {SEQ} {SEQ_TYPE}" + (f", {LABEL} string" if scheme else ""))

    def _writable(self, name: str) -> Table:
        t = self.tables.get(name.lower())
        if t is None:
            raise EngineError(f"unknown table {name}" if name.lower() not in STATS_TABLES else f"{name} is read only")
        if t.external:
            raise EngineError(f"{name} is read only")
        return t

    def _insert(self, s: ast.Insert) -> None:
        t = self._writable(s.table)
        names = t.columns if s.columns is None else [next((c for c in t.columns if c.lower() == n.lower()), None) or self._unknown(n) for n in s.columns]
        rows = []
        for k, values in enumerate(s.rows):
            if len(values) != len(names):
                raise SchemaError(f"{len(names)} columns, {len(values)} values")
            row = dict(zip(names, values, strict=True))
            rows.append(tuple(coerce(row.get(c), kind) for c, kind in t.kinds.items()) + ((t.rows_in, k),))
        self._append(t, self.spark.createDataFrame(rows, self._schema(t.kinds)))
        t.rows_in += 1

    @staticmethod
    def _unknown(name: str):
        raise SchemaError(f"unknown column {name}")

    def insert_frame(self, name: str, df: DataFrame) -> None:
        """Appends a DataFrame; columns it lacks become null."""
        t = self._writable(name)
        cols = {c.lower(): c for c in df.columns}
        picked = [(F.col(f"`{cols[c.lower()]}`") if c.lower() in cols else F.lit(None)).cast(SPARK[k]).alias(c) for c, k in t.kinds.items()]
        self._append(t, df.select(*picked, F.struct(F.lit(t.rows_in).cast("bigint").alias("batch"), F.monotonically_increasing_id().alias("place")).alias(SEQ)))
        t.rows_in += 1

    def _append(self, t: Table, df: DataFrame) -> None:
        if t.scheme is not None:
            df = df.withColumn(LABEL, t.scheme.label())
            if not df.where(F.col(LABEL).isNull()).isEmpty():
                raise EngineError(f"no partition of {t.name} takes the row")
            df.write.mode("append").partitionBy(LABEL).parquet(t.path)
        else:
            df.write.mode("append").parquet(t.path)
        t.df = self.spark.read.schema(self._schema(t.kinds, t.scheme)).parquet(t.path)
        self._changed(t.name)

    def _merge(self, s: ast.Merge) -> None:
        t = self._writable(s.target)
        source = self._resolve(s.source, self._materialize(s.ctes, s.recursive))
        find = lambda cols, n: next((c for c in cols if c.lower() == n.lower()), None) or self._unknown(n)
        value = lambda v, kind: lambda src, tgt=None: src(find(source.columns, v.value)) if v.side == "source" else tgt(find(t.columns, v.value)) if v.side == "target" else F.lit(coerce(v.value, kind))
        sets = {find(t.columns, c): value(v, t.kinds[find(t.columns, c)]) for c, v in s.sets} if s.sets else None
        inserts = {find(t.columns, c): value(v, t.kinds[find(t.columns, c)]) for c, v in zip(s.insert_columns, s.insert_values, strict=True)} if s.insert_columns else None
        if SEQ in source.df.columns:
            src = ranges.positions(source.df, [SEQ], "__place").drop(SEQ).withColumnRenamed("__place", SEQ)
        else:
            src = stage(source.df.withColumn(SEQ, F.monotonically_increasing_id()), "merge-source")
        batch = F.lit(t.rows_in).cast("bigint").alias("batch")
        if inserts is not None:
            inserts[SEQ] = lambda src_: F.struct(batch, src_(SEQ).alias("place"))
        old = t.df.select(*t.columns, SEQ)
        out = merge(old, src, find(t.columns, s.target_key), find(source.columns, s.source_key), sets, inserts, SEQ, [SEQ], bool(s.sets and any(v.side == "target" for _, v in s.sets)))
        t.path, previous = new_path(self.spark, f"table-{t.name}"), t.path
        try:
            self._append(t, out)
        except EngineError:
            t.path = previous
            raise
        t.rows_in += 1

    def hash_join(self, left: str, right: str, left_column: str, right_column: str) -> DataFrame:
        a, b = self._resolve(left, {}), self._resolve(right, {})
        return joins.inner_join(a.df.select(*a.columns), b.df.select(*b.columns), left_column, right_column, left, right)

    # -- views

    def _createview(self, s: ast.CreateView) -> None:
        key = s.name.lower()
        if key in self.views or key in self.tables:
            raise ConflictError(f"{s.name} exists")
        if self._reads_external(s.query):
            raise EngineError("a materialized view can't read external tables")
        rows = stage(self.select(s.query, use_views=False), f"view-{s.name}")
        self.views[key] = View(s.name, s.query, s.synchronous, self._of_frame(s.name, rows))
        self._forget(s.query.table)

    def _refreshview(self, s: ast.RefreshView) -> None:
        v = self.views.get(s.name.lower())
        if v is None:
            raise EngineError(f"unknown view {s.name}")
        if v.synchronous if s.synchronous is None else s.synchronous:
            self.refresh(v)
        elif v.pending_since is None:
            v.pending_since = time.monotonic()

    def refresh(self, v: View) -> None:
        v.table = self._of_frame(v.name, stage(self.select(v.query, use_views=False), f"view-{v.name}"))
        v.pending_since = None
        self._changed(v.name)

    def run_pending_refreshes(self, force: bool = False) -> int:
        due = [v for v in self.views.values() if v.pending_since is not None and (force or time.monotonic() - v.pending_since >= self.async_delay)]
        for v in due:
            self.refresh(v)
        return len(due)

    def _forget(self, name: str) -> None:
        self.cache = {k: v for k, v in self.cache.items() if name.lower() not in v.reads}

    def _changed(self, name: str) -> None:
        """Drops cached results, then refreshes or schedules what reads the table, views on views too."""
        self._forget(name)
        for v in list(self.views.values()):
            if name.lower() in self._reads(v.query) - {v.name.lower()}:
                if v.synchronous:
                    self.refresh(v)
                elif v.pending_since is None:
                    v.pending_since = time.monotonic()

    # -- graphs

    def _graph(self, name: str) -> graph.Graph:
        try:
            return self.graphs[name.lower()]
        except KeyError:
            raise EngineError(f"unknown graph {name}") from None

    def _creategraph(self, s: ast.CreateGraph) -> None:
        if s.name.lower() in self.graphs:
            raise ConflictError(f"graph {s.name} exists")
        self.graphs[s.name.lower()] = graph.Graph(self.spark)

    def _createnode(self, s: ast.CreateNode) -> None:
        self._graph(s.graph).add_node(s.id, dict(s.properties))

    def _createedge(self, s: ast.CreateEdge) -> None:
        self._graph(s.graph).add_edge(s.source, s.target, s.label, dict(s.properties))

    def _matchgraph(self, s: ast.MatchGraph) -> DataFrame:
        return self._graph(s.graph).match(source=s.source, target=s.target, label=s.label, properties=dict(s.properties))

    # -- statistics

    def _analyze(self, s: ast.Analyze) -> None:
        names = [s.table.lower()] if s.table else [k for k, t in self.tables.items() if not t.external]
        for key in names:
            t = self.tables.get(key)
            if t is None:
                raise EngineError(f"unknown table {s.table}")
            columns = [r.asDict() for r in statistics.column_stats(t.df, t.kinds, t.name).collect()]  # a row a column
            version = self.stats[key][3] + 1 if key in self.stats else 1
            self.stats[key] = (t.df.count(), time.time(), columns, version)
            for c, kind in t.kinds.items():
                if kind not in statistics.NO_HISTOGRAM:
                    rows = statistics.equi_depth(t.df, statistics.as_number(F.col(f"`{c}`"), kind)).collect()  # ten buckets
                    self.histograms[key, c] = [(r["lower"], r["upper"], r["count"]) for r in rows]

    def statistics(self, which: str) -> DataFrame:
        """The catalog tables, as DataFrames."""
        if which == "table_statistics":
            rows = [(self.tables[k].name, n, at, v) for k, (n, at, _, v) in sorted(self.stats.items())]
            return self.spark.createDataFrame(rows, "table_name string, row_count bigint, analyzed_at double, stats_version bigint")
        rows = [(self.tables[k].name, c["column_name"], c["data_type"], c["null_count"], c["distinct_count"], c["min_value"], c["max_value"], at, v) for k, (_, at, cols, v) in sorted(self.stats.items()) for c in cols]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, null_count bigint, distinct_count bigint, min_value string, max_value string, analyzed_at double, stats_version bigint")

    def statistics_summary(self) -> DataFrame:
        """One row: total_tables, analyzed_tables, total_columns, analyzed_columns."""
        own = [t for t in self.tables.values() if not t.external]
        columns = sum(len(c) for _, _, c, _ in self.stats.values())
        row = [(len(own) + len(self.views), len(self.stats), max(columns, 3 * (len(own) + len(self.views))), columns)]
        return self.spark.createDataFrame(row, "total_tables bigint, analyzed_tables bigint, total_columns bigint, analyzed_columns bigint")

    def save_statistics(self, path: str) -> None:
        """Writes the catalogs, a line of JSON a table; a table's line replaces its older one."""
        rows = [(k, json.dumps({"rows": n, "at": at, "columns": cols, "version": v, "histograms": {c: h for (t, c), h in self.histograms.items() if t == k}})) for k, (n, at, cols, v) in sorted(self.stats.items())]
        self.spark.createDataFrame(rows, "table string, value string").write.mode("overwrite").json(path)

    def load_statistics(self, path: str) -> None:
        for r in self.spark.read.schema("table string, value string").json(path).collect():  # a row a table
            v = json.loads(r["value"])
            self.stats[r["table"]] = (v["rows"], v["at"], v["columns"], v["version"])
            for key in [k for k in self.histograms if k[0] == r["table"]]:
                del self.histograms[key]
            for c, buckets in v["histograms"].items():
                self.histograms[r["table"], c] = [tuple(b) for b in buckets]

    def table_stats(self, name: str) -> estimator.TableStats:
        key = name.lower()
        t = self._resolve(name, {})
        if key not in self.stats:
            return estimator.TableStats(t.df.count(), {}, False)
        rows, _, columns, _ = self.stats[key]
        out = {}
        for c in columns:
            buckets = self.histograms.get((key, c["column_name"]), [])
            out[c["column_name"]] = estimator.ColumnStats(c["data_type"], c["null_count"], c["distinct_count"], buckets[0][0] if buckets else None, buckets[-1][1] if buckets else None, buckets)
        return estimator.TableStats(rows, out)

    def estimate(self, sql: str) -> estimator.Estimate:
        q = parse(sql)
        return estimator.estimate_scan(q.select.predicate, self.table_stats(q.select.table))

    def estimate_join(self, left: str, right: str, left_column: str, right_column: str) -> estimator.Estimate:
        return estimator.estimate_join(self.table_stats(left), left_column, self.table_stats(right), right_column)

    def _showtables(self, s: ast.ShowTables) -> DataFrame:
        found = sorted([(t.name, t.df) for t in self.tables.values() if not t.external] + [(v.name, v.table.df) for v in self.views.values()])
        rows = [(name, df.count(), None, None) for name, df in found]
        return self.spark.createDataFrame(rows, "name string, row_count bigint, created_at timestamp, size bigint")

    # -- vectors

    def _createcollection(self, s: ast.CreateCollection) -> None:
        o = dict(s.options)
        if s.name.lower() in self.collections:
            raise ConflictError(f"collection {s.name} exists")
        metric = str(o.get("METRIC", "cosine")).lower()
        index = "brute_force" if str(o.get("INDEX", "bruteforce")).lower() in ("bruteforce", "brute_force", "bf") else "cells"
        made = Collection(self.spark, s.name, int(o.get("DIM", 0)), "euclidean" if metric in ("l2", "euclidean") else metric, index, int(o.get("M", 16)))
        made.nprobe = int(o.get("EF_SEARCH", made.nprobe))
        self.collections[s.name.lower()] = made

    def list_collections(self) -> DataFrame:
        rows = [tuple(c.info()[k] for k in ("name", "dim", "metric", "index", "count", "cells", "nprobe")) for _, c in sorted(self.collections.items())]
        return self.spark.createDataFrame(rows, "name string, dim bigint, metric string, index string, count bigint, cells bigint, nprobe bigint")

    def set_ef_search(self, name: str, nprobe: int) -> None:
        """How many cells a search reads."""
        self._collection(name).nprobe = max(1, nprobe)

    def _collection(self, name: str) -> Collection:
        try:
            return self.collections[name.lower()]
        except KeyError:
            raise EngineError(f"unknown collection {name}") from None

    def _insertpoint(self, s: ast.InsertPoint) -> None:
        o = dict(s.options)
        row = [(str(o.get("ID")), [float(x) for x in o["VECTOR"]], o.get("PAYLOAD"))]
        self._collection(s.collection).upsert(self.spark.createDataFrame(row, "id string, vector array<float>, payload string"))

    def _search(self, s: ast.Search) -> DataFrame:
        o = dict(s.options)
        wanted = json.loads(o["FILTER"]) if o.get("FILTER") else None
        return self._collection(s.collection).search([float(x) for x in o["VECTOR"]], int(o.get("TOPK", 10)), wanted)
