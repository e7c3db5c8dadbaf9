"""The engine's operators as queries over the standard tables, each with the SQL that an independent engine must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import distance, semistructured, text
from .operators import graph, joins, monitor, oplog, partitioning, quantization, recursive, statistics, vectors, versioned
from .session import Engine
from .sources.external import ParquetSource
from .sql import ast
from .streaming import streams

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Q: dict = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    e = Engine(spark)
    for t in tables:
        e.register(t, ParquetSource(f"{sf_dir}/{t}.parquet"))
    return e


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def statement(name: str, tables: tuple[str, ...], sql: str, oracle: str | None = None) -> None:
    """A query that the SQL surface takes as it is."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, *tables).execute(sql)

    Q[name], SQL[name] = run, oracle or sql


# -- scans, projections, predicates

statement("scan_project", ("orders",), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
statement("scan_all", ("nation",), "SELECT * FROM nation")
statement("filter_eq", ("orders",), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
statement("filter_ge", ("orders",), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000")
statement("filter_between", ("lineitem",), "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
statement("between_swapped", ("lineitem",), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 20 AND 10", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
statement("filter_timestamp", ("orders",), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1996-06-01'", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01'")
statement("filter_logic", ("customer",), "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT c_nationkey IN (1, 2) AND c_name LIKE '%1%'")
statement("in_table_column", ("customer", "orders"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN orders.o_custkey", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
statement("in_external_column", ("part", "lineitem"), "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN lineitem.l_partkey", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
statement("order_limit", ("orders",), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 25")


@query("SELECT event_id FROM events WHERE nullif(event_type, 'error') IS NULL")
def is_null(spark, sf_dir):
    e = Engine(spark)
    e.register("ev", read(spark, sf_dir, "events").withColumn("kind", F.expr("nullif(event_type, 'error')")))
    return e.execute("SELECT event_id FROM ev WHERE kind IS NULL")


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_discount >= 0.05")
def external_pushdown(spark, sf_dir):
    return ParquetSource(f"{sf_dir}/lineitem.parquet").scan(spark, F.col("l_discount") >= 0.05, ["l_orderkey", "l_linenumber", "l_shipdate"])


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey BETWEEN 100 AND 900 ORDER BY p_partkey LIMIT 50")
def ordered_range_limit(spark, sf_dir):
    return oplog.key_range(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", 100, 900, 50)


# -- joins, windows, recursion, MERGE, graphs


@query("SELECT o_orderkey AS orders_o_orderkey, o_custkey AS orders_o_custkey, c_custkey AS customer_c_custkey, c_name AS customer_c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def hash_join_inner(spark, sf_dir):
    e = engine(spark, sf_dir, "orders", "customer")
    return e.hash_join("orders", "customer", "o_custkey", "c_custkey").select("orders_o_orderkey", "orders_o_custkey", "customer_c_custkey", "customer_c_name")


@query("WITH t AS (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type) SELECT event_id, event_type, n FROM events JOIN t ON event_type = kind")
def hash_join_skewed(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select("event_id", "event_type")
    return joins.salted_join(ev, ev.groupBy("event_type").agg(F.count("*").alias("n")), "event_type").select("event_id", "event_type", "n")


statement("row_number_global", ("supplier",), "SELECT s_suppkey, ROW_NUMBER() OVER (ORDER BY s_suppkey) AS rn FROM supplier WHERE s_acctbal >= 0")
statement(
    "row_number_partitioned",
    ("orders",),
    "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_number FROM orders",
)
statement(
    "cte_chain",
    ("orders", "customer"),
    "WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 300000), who AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey IN big.o_custkey) SELECT c_name FROM who",
    "WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 300000) SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM big)",
)
TREE = "SELECT p_partkey AS id, p_partkey // 2 AS parent FROM part"


@query(f"WITH RECURSIVE t AS ({TREE}), r AS (SELECT id, parent FROM t WHERE id = 3 UNION SELECT t.id, t.parent FROM t JOIN r ON t.parent = r.id) SELECT id, parent FROM r")
def recursive_hierarchy(spark, sf_dir):
    e = Engine(spark)
    e.register("t", read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 2).cast("bigint").alias("parent")))
    return e.execute("WITH RECURSIVE r AS (SELECT id, parent FROM t WHERE id = 3 UNION ALL SELECT id, parent FROM t WHERE parent IN r.id) SELECT id, parent FROM r")


WAITS = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey"


@query(f"WITH RECURSIVE e AS ({WAITS}), r AS (SELECT src AS start, dst AS node FROM e UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src) SELECT start AS node FROM r WHERE start = node")
def wait_cycles(spark, sf_dir):
    """Suppliers wait for the parts of their lines; numbers that are both a supplier's and a part's close the cycles."""
    li = read(spark, sf_dir, "lineitem")
    return recursive.on_cycle(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).where("src <> dst"))


@query(
    "WITH u AS (SELECT s_suppkey + 10 AS k, 's' || (s_suppkey + 10)::VARCHAR AS n, s_acctbal * 2 AS b FROM supplier) "
    "SELECT coalesce(s_suppkey, k) AS s_suppkey, coalesce(n, s_name) AS s_name, coalesce(b, s_acctbal) AS s_acctbal FROM supplier FULL JOIN u ON s_suppkey = k"
)
def merge_upsert(spark, sf_dir):
    e = Engine(spark)
    s = read(spark, sf_dir, "supplier")
    e.execute("CREATE TABLE target (s_suppkey INT, s_name TEXT, s_acctbal FLOAT)")
    e.insert_frame("target", s)
    e.register("u", s.select((F.col("s_suppkey") + 10).alias("k"), F.concat(F.lit("s"), (F.col("s_suppkey") + 10).cast("string")).alias("n"), (F.col("s_acctbal") * 2).alias("b")))
    e.execute("MERGE INTO target AS t USING u ON t.s_suppkey = u.k WHEN MATCHED THEN UPDATE SET s_name = u.n, s_acctbal = u.b WHEN NOT MATCHED THEN INSERT (s_suppkey, s_name, s_acctbal) VALUES (k, n, b)")
    return e.execute("SELECT s_suppkey, s_name, s_acctbal FROM target")


@query(
    "WITH s AS (SELECT user_id AS k, event_type AS v, event_id AS seq FROM events), e AS (SELECT k, arg_min(v, seq) AS f, arg_max(v, seq) AS l, count(*) AS n FROM s GROUP BY k), "
    "t AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer) SELECT coalesce(t.k, e.k) AS k, CASE WHEN e.k IS NULL THEN t.v ELSE e.l END AS v FROM t FULL JOIN e ON t.k = e.k"
)
def merge_duplicate_source(spark, sf_dir):
    from .operators.merge import merge

    s = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), F.col("event_id").alias("seq"))
    t = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return merge(t, s, "k", "k", {"v": lambda src, tgt: src("v")}, {"k": lambda src: src("k"), "v": lambda src: src("v")}, "seq", ["k"])


@query("SELECT 'n' || n_nationkey AS \"from\", 'r' || n_regionkey AS \"to\", r_name AS label, '{name: ' || n_name || '}' AS properties FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'asia'")
def graph_match(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    edges = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("n"), n.n_nationkey.cast("string")).alias("src"), F.concat(F.lit("r"), n.n_regionkey.cast("string")).alias("dst"), F.col("r_name").alias("label"), F.create_map(F.lit("name"), "n_name").alias("properties")
    )
    return graph.match_edges(edges, label="Asia")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 400000")
def materialized_view(spark, sf_dir):
    e = Engine(spark)
    e.execute("CREATE TABLE t (o_orderkey INT, o_custkey INT, o_totalprice FLOAT)")
    e.execute("CREATE MATERIALIZED VIEW big AS SELECT o_orderkey, o_custkey FROM t WHERE o_totalprice >= 400000")
    e.insert_frame("t", read(spark, sf_dir, "orders"))
    return e.execute("SELECT * FROM big")


# -- text

TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def _stem_sql(stop, endings) -> str:
    rules = " ".join(f"WHEN suffix(t, '{e}') AND strlen(t) > {n} THEN left(t, length(t) - {cut}) || '{add}'" for e, n, cut, add in endings)
    words = ", ".join(f"'{w}'" for w in stop)
    return f"list_transform(list_filter({TOKENS}, lambda t: t NOT IN ({words})), lambda t: CASE {rules} ELSE t END)"


def fulltext(name: str, q: str, language: str | None = None) -> None:
    tokens = TOKENS if language is None else _stem_sql(*text.ANALYZERS[language])
    wanted = ", ".join(f"'{t}'" for t in text.analyze_literal(q, language))
    suffix = f" LANGUAGE '{language}'" if language else ""
    statement(name, ("documents",), f"SELECT doc_id FROM documents WHERE text @@ '{q}'{suffix}", f"SELECT doc_id FROM documents WHERE list_has_all({tokens}, [{wanted}])")


fulltext("fulltext_plain", "the and")
fulltext("fulltext_english", "heating thes", "english")


@query(f"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens FROM documents")
def text_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


# -- JSON, geometry


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def metadata_filter(spark, sf_dir):
    return read(spark, sf_dir, "events").where(semistructured.metadata_matches(F.col("props"), {"k": 7})).select("event_id")


@query("SELECT event_id, json(props)::VARCHAR AS canonical FROM events")
def json_canonical(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", semistructured.canonical_json(F.col("props")).alias("canonical"))


# -- vectors

ONE = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"


def _vector(spark, sf_dir, vec_id: int = 7) -> list[float]:
    return [float(x) for x in read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("score", 9).alias("score"))


@query(f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {ONE}), 9) AS score FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {ONE}), vec_id LIMIT 10")
def vector_topk_cosine(spark, sf_dir):
    return _ranked(vectors.exact_topk(read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10, "cosine", "embedding", "vec_id"))


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {ONE}), 9) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {ONE}), vec_id LIMIT 10")
def vector_topk_l2(spark, sf_dir):
    return _ranked(vectors.exact_topk(read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10, "euclidean", "embedding", "vec_id"))


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {ONE}), 9) AS score FROM embeddings WHERE label = 3 ORDER BY list_distance(embedding::DOUBLE[], {ONE}), vec_id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    return _ranked(vectors.exact_topk(read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10, "euclidean", "embedding", "vec_id", F.col("label") == 3))


@query(
    "WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS id, list_distance(embedding::DOUBLE[], v) AS d FROM embeddings, q), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM s) SELECT query, rank, id, round(d, 9) AS score FROM r WHERE rank <= 5"
)
def vector_topk_batch(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return vectors.table_topk(e, e.where("vec_id % 100 = 0"), 5, "euclidean", "embedding", "vec_id").withColumn("score", F.round("score", 9))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distances(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    x, y = F.col("embedding"), F.col("vb")
    return e.join(b, F.col("vec_id") == F.col("a")).select("a", "b", F.round(distance.cosine(x, y), 9).alias("cosine"), F.round(distance.euclidean(x, y), 9).alias("l2"))


DIMS = "SELECT unnest(generate_series(0, len(embedding) - 1))::BIGINT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings"


@query(f"WITH x AS ({DIMS}) SELECT dim, min(v) AS lo, max(v) AS hi, round(CASE WHEN max(v) - min(v) > 1.1920929e-07 THEN 255.0::DOUBLE / (max(v) - min(v)) ELSE 0 END, 9) AS scale FROM x GROUP BY dim")
def sq_train(spark, sf_dir):
    return quantization.train_scalar(read(spark, sf_dir, "embeddings"), "embedding").withColumn("scale", F.round("scale", 9))


@query(
    "WITH x AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1))::BIGINT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM x GROUP BY dim) "
    "SELECT vec_id, sum(floor(least(greatest((v - lo) * (255.0::DOUBLE / (hi - lo)), 0), 255)))::BIGINT AS code_sum FROM x JOIN p USING (dim) GROUP BY vec_id"
)
def sq_encode(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    codes = quantization.Scalar.train(e, "embedding").encode(F.col("embedding"))
    return e.select("vec_id", F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("code_sum"))


# -- statistics


@query("SELECT 'orders' AS table_name, count(*) AS row_count FROM orders")
def analyze_table(spark, sf_dir):
    return statistics.table_stats(read(spark, sf_dir, "orders"), "orders")


@query(
    "SELECT 'orders' AS table_name, 'o_orderkey' AS column_name, 'INTEGER' AS data_type, count(*) FILTER (o_orderkey IS NULL) AS null_count, count(DISTINCT o_orderkey) AS distinct_count, min(o_orderkey)::VARCHAR AS min_value, max(o_orderkey)::VARCHAR AS max_value FROM orders "
    "UNION ALL SELECT 'orders', 'o_orderstatus', 'TEXT', count(*) FILTER (o_orderstatus IS NULL), count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders "
    "UNION ALL SELECT 'orders', 'o_custkey', 'INTEGER', count(*) FILTER (o_custkey IS NULL), count(DISTINCT o_custkey), min(o_custkey)::VARCHAR, max(o_custkey)::VARCHAR FROM orders"
)
def analyze_columns(spark, sf_dir):
    return statistics.column_stats(read(spark, sf_dir, "orders"), {"o_orderkey": "INTEGER", "o_orderstatus": "TEXT", "o_custkey": "INTEGER"}, "orders")


@query(
    "WITH x AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS r, count(*) OVER () AS n FROM orders), y AS (SELECT ((r + 1) * 10 - 1) // n AS bucket, v FROM x), "
    "g AS (SELECT bucket, min(v) AS lower, max(v) AS upper, count(*) AS count FROM y GROUP BY bucket) SELECT bucket::BIGINT AS bucket, lower, upper, count, (sum(count) OVER (ORDER BY bucket))::BIGINT AS cumulative FROM g"
)
def hist_equi_depth(spark, sf_dir):
    return statistics.equi_depth(read(spark, sf_dir, "orders"), F.col("o_totalprice"))


@query(
    "WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders), b AS (SELECT unnest(range(10)) AS bucket), "
    "c AS (SELECT least(floor((o_totalprice - lo) / w), 9)::BIGINT AS bucket, count(*) AS n FROM orders, e GROUP BY 1) "
    "SELECT b.bucket, round(lo + w * b.bucket, 6) AS lower, round(lo + w * (b.bucket + 1), 6) AS upper, coalesce(n, 0) AS count, (sum(coalesce(n, 0)) OVER (ORDER BY b.bucket))::BIGINT AS cumulative FROM b LEFT JOIN c ON b.bucket = c.bucket CROSS JOIN e"
)
def hist_equi_width(spark, sf_dir):
    h = statistics.equi_width(read(spark, sf_dir, "orders"), F.col("o_totalprice"))
    return h.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@query("WITH x AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT g AS o_orderpriority, v AS value FROM x WHERE r = least(floor(0.9::DOUBLE * n)::BIGINT, n - 1)")
def rank_percentiles(spark, sf_dir):
    return statistics.rank_percentile(read(spark, sf_dir, "orders"), "o_totalprice", 0.9, ["o_orderpriority"])


# -- partitioning


@query("SELECT CASE WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'a' WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'b' ELSE 'c' END AS part, count(*) AS n FROM orders GROUP BY 1")
def range_partition(spark, sf_dir):
    p = ast.Partitioning("range", "o_orderdate", (("a", ("1994-01-01",)), ("b", ("1997-01-01",)), ("c", None)))
    scheme = partitioning.Scheme.of(p, "TIMESTAMP")
    return read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).groupBy(scheme.label().alias("part")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'rest' END AS part, count(*) AS n FROM orders GROUP BY 1")
def list_partition(spark, sf_dir):
    scheme = partitioning.Scheme.of(ast.Partitioning("list", "o_orderstatus", (("rest", None), ("done", ("F",)), ("open", ("O", "P")))), "TEXT")
    return read(spark, sf_dir, "orders").groupBy(scheme.label().alias("part")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 12 AND 18")
def pruned_scan(spark, sf_dir):
    e = Engine(spark)
    e.execute("CREATE TABLE t (l_orderkey INT, l_linenumber INT, l_quantity FLOAT) PARTITION BY RANGE(l_quantity) (VALUES LESS THAN (11), VALUES LESS THAN (21), VALUES LESS THAN MAXVALUE)")
    e.insert_frame("t", read(spark, sf_dir, "lineitem"))
    return e.execute("SELECT l_orderkey, l_linenumber FROM t WHERE l_quantity BETWEEN 12 AND 18")


# -- logs and versions

LOG = "SELECT user_id AS id, event_id AS lsn, ts, event_type AS op, value FROM events"


def _log(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("lsn"), "ts", F.col("event_type").alias("op"), "value")


def _replayed(where: str = "true") -> str:
    return f"WITH l AS ({LOG}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS n FROM l WHERE {where}) SELECT id, lsn, value FROM r WHERE n = 1 AND op <> 'error'"


@query(_replayed())
def oplog_latest(spark, sf_dir):
    return oplog.replay(_log(spark, sf_dir), "id", "lsn", F.col("op") == "error").select("id", "lsn", "value")


@query(_replayed("lsn <= 4000"))
def oplog_as_of(spark, sf_dir):
    return oplog.replay(_log(spark, sf_dir), "id", "lsn", F.col("op") == "error", upto_lsn=4000).select("id", "lsn", "value")


@query("SELECT event_id AS lsn, user_id AS id FROM events WHERE event_id >= 9000")
def oplog_tail(spark, sf_dir):
    return oplog.tail(_log(spark, sf_dir), "lsn", 9000).select("lsn", "id")


@query(f"WITH l AS ({LOG}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS n FROM l) SELECT id, lsn, CASE WHEN op = 'error' THEN NULL ELSE value END AS value FROM r WHERE n = 1")
def lsm_compact(spark, sf_dir):
    runs = _log(spark, sf_dir).withColumn("value", F.when(F.col("op") != "error", F.col("value"))).select("id", "lsn", "value")
    return oplog.compact(runs, "id", "lsn", "value")


VERSIONS = "SELECT user_id AS id, event_id AS begin_xid, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS end_xid FROM events"
SEEN = "({c} < 5000 AND {c} NOT IN (100, 200, 300))"


def _versions(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    ev = read(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("id"), F.col("event_id").alias("begin_xid"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("end_xid"))


@query(f"WITH v AS ({VERSIONS}) SELECT id, begin_xid, coalesce(end_xid, -1) AS end_xid FROM v WHERE {SEEN.format(c='begin_xid')} AND NOT coalesce({SEEN.format(c='end_xid')}, false)")
def mvcc_visible(spark, sf_dir):
    return versioned.visible(_versions(spark, sf_dir), xmin=50, xmax=5000, active=[100, 200, 300]).withColumn("end_xid", F.coalesce("end_xid", F.lit(-1)))


@query(f"WITH v AS ({VERSIONS}) SELECT id, begin_xid, coalesce(end_xid, -1) AS end_xid FROM v WHERE end_xid IS NULL OR end_xid >= 6000")
def mvcc_gc(spark, sf_dir):
    return versioned.collect_garbage(_versions(spark, sf_dir), "id", 6000).withColumn("end_xid", F.coalesce("end_xid", F.lit(-1)))


PAGES = "SELECT o_orderkey // 256 AS page_id, CASE WHEN o_orderstatus = 'F' THEN 1 END AS deleted_xid, 20 AS row_bytes FROM orders"
PAGE_ROWS = f"WITH r AS ({PAGES}), p AS (SELECT page_id, count(deleted_xid) AS dead_rows, count(*) - count(deleted_xid) AS live_rows, sum(row_bytes)::BIGINT AS used_bytes, greatest(8192 - sum(row_bytes), 0)::BIGINT AS free_bytes, count(deleted_xid) / count(*) AS dead_ratio FROM r GROUP BY page_id)"


def _pages(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 256).cast("bigint").alias("page_id"), F.when(F.col("o_orderstatus") == "F", 1).alias("deleted_xid"), F.lit(20).alias("row_bytes"))


@query(f"{PAGE_ROWS} SELECT page_id, dead_rows, live_rows, used_bytes, free_bytes, round(dead_ratio, 9) AS dead_ratio FROM p")
def vacuum_pages(spark, sf_dir):
    return versioned.page_analysis(_pages(spark, sf_dir)).withColumn("dead_ratio", F.round("dead_ratio", 9))


@query(f"{PAGE_ROWS} SELECT page_id, dead_rows, free_bytes, floor(dead_ratio * 100 + (1 - free_bytes / 8192) * 50 + 336)::BIGINT AS priority FROM p WHERE dead_ratio > 0.1 ORDER BY priority DESC, page_id LIMIT 100")
def vacuum_candidates(spark, sf_dir):
    return versioned.vacuum_candidates(versioned.page_analysis(_pages(spark, sf_dir)), "manual")


@query(
    f"{PAGE_ROWS}, t AS (SELECT count(*) AS pages, sum(dead_rows)::BIGINT AS dead_rows, sum(live_rows)::BIGINT AS live_rows, round(avg(1 - free_bytes / 8192), 9) AS utilisation FROM p) "
    "SELECT *, CASE WHEN dead_rows / (dead_rows + live_rows) > 0.5 THEN 'full' WHEN dead_rows / (dead_rows + live_rows) > 0.2 THEN 'immediate' WHEN dead_rows / (dead_rows + live_rows) > 0.05 THEN 'scheduled' ELSE 'none' END AS recommendation FROM t"
)
def vacuum_recommendation(spark, sf_dir):
    return versioned.database_analysis(versioned.page_analysis(_pages(spark, sf_dir)))


@query(f"WITH r AS ({PAGES}) SELECT count(*) AS rows_reclaimed, sum(row_bytes)::BIGINT AS bytes_reclaimed FROM r WHERE deleted_xid IS NOT NULL")
def vacuum_run(spark, sf_dir):
    return versioned.vacuum(_pages(spark, sf_dir))[1]


@query("WITH x AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) SELECT min(event_id) AS start, event_type AS value, count(*) AS length FROM x GROUP BY event_type, g")
def rle_runs(spark, sf_dir):
    return oplog.run_lengths(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def dictionary_encode(spark, sf_dir):
    return oplog.dictionary_codes(read(spark, sf_dir, "part"), "p_brand")[1].select("p_partkey", "code")


# -- monitoring


@query("WITH x AS (SELECT event_type AS g, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT g AS event_type, any_value(n) AS n, round(avg(v), 6) AS avg_ms, max(v) FILTER (r = least(floor(0.95::DOUBLE * n)::BIGINT, n - 1)) AS p95_ms FROM x GROUP BY g")
def latency_p95(spark, sf_dir):
    return monitor.latency_summary(read(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("avg_ms", F.round("avg_ms", 6))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 6) AS error_rate FROM events GROUP BY user_id")
def error_rate(spark, sf_dir):
    return monitor.error_rate(read(spark, sf_dir, "events"), F.col("event_type") == "error", ["user_id"]).withColumn("error_rate", F.round("error_rate", 6))


@query(
    "WITH x AS (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) "
    "SELECT event_id, value > m + 2 * s AND n >= 50 AS anomaly FROM x"
)
def anomaly_latency(spark, sf_dir):
    a = monitor.anomalies(read(spark, sf_dir, "events"), "value", "event_id", by=["event_type"])
    return a.select("event_id", "anomaly")


@query(
    "WITH x AS (SELECT event_type AS rule_id, event_id, value > 60 AS f FROM events), y AS (SELECT *, f AND NOT coalesce(lag(f) OVER (PARTITION BY rule_id ORDER BY event_id), false) AS st FROM x), "
    "z AS (SELECT *, sum(st::INT) OVER (PARTITION BY rule_id ORDER BY event_id) AS g FROM y) SELECT rule_id, min(event_id) AS opened, coalesce(min(event_id) FILTER (NOT f), -1) AS resolved, count(*) FILTER (f) AS samples FROM z WHERE g > 0 GROUP BY rule_id, g"
)
def alert_intervals(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "event_id", "value")
    rules = ev.select("metric").distinct().select(F.col("metric").alias("id"), "metric", F.lit(">").alias("operator"), F.lit(60.0).alias("threshold"), F.lit(True).alias("enabled"))
    return monitor.alert_intervals(monitor.evaluate_rules(ev, rules, "event_id"), "event_id").withColumn("resolved", F.coalesce("resolved", F.lit(-1)))


TRACES = "SELECT conv_id AS trace_id, sum(length(text))::DOUBLE AS duration_ms, CASE WHEN count(*) > 8 THEN 'error' ELSE 'ok' END AS status FROM conversations GROUP BY conv_id"


@query(
    f"WITH t AS ({TRACES}), x AS (SELECT *, row_number() OVER (ORDER BY duration_ms, trace_id) - 1 AS r, count(*) OVER () AS n FROM t) "
    "SELECT count(*) AS total, round(count(*) FILTER (status = 'error') * 100.0 / count(*), 6) AS error_rate, round(avg(duration_ms), 6) AS avg_ms, arg_max(trace_id, r) AS slowest, "
    "max(duration_ms) FILTER (r = least(floor(0.95::DOUBLE * n)::BIGINT, n - 1)) AS p95_ms, max(duration_ms) FILTER (r = least(floor(0.99::DOUBLE * n)::BIGINT, n - 1)) AS p99_ms FROM x"
)
def trace_summary(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("trace_id")).agg(F.sum(F.length("text")).cast("double").alias("duration_ms"), F.when(F.count("*") > 8, "error").otherwise("ok").alias("status"))
    return monitor.trace_summary(c).withColumns({"error_rate": F.round("error_rate", 6), "avg_ms": F.round("avg_ms", 6)})


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 1000")
def metrics_ring(spark, sf_dir):
    return monitor.ring(read(spark, sf_dir, "events").select("event_id", "value"), "event_id")


@query("SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def prometheus_lines(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
    return monitor.prometheus(counts, "events_total", ["type"], "n")


# -- event time (extensions)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def tumbling_windows(spark, sf_dir):
    return streams.tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")])
