"""Queries over what statements, logs, collections, transactions and monitoring leave behind, each with the SQL that an independent engine must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import distance, semistructured
from .operators import codecs, membership, monitor, oplog, quantization, statistics, transactions, vectors, versioned
from .operators.partitioning import Scheme
from .plans import estimator
from .plans.refresh import Refresher
from .queries import Q, _log, _vector, engine, query, read, statement
from .session import Engine, Execution
from .sources.collections import LOG as POINT_LOG
from .sources.collections import Collection
from .sources.staging import new_path, written
from .sql import ast

# -- statements


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region UNION ALL SELECT 1000, 'first' UNION ALL SELECT 1001, NULL")
def insert_rows(spark, sf_dir):
    e = Engine(spark)
    e.execute("CREATE TABLE t (k INT, v TEXT)")
    e.insert_frame("t", read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))
    e.insert_frame("t", read(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("k"), F.col("r_name").alias("v")))
    e.execute("INSERT INTO t (v, k) VALUES ('first', 1000)")
    e.execute("INSERT INTO t (k) VALUES (1001)")
    return e.execute("SELECT k, v FROM t")


@query(
    "WITH t AS (SELECT o_orderkey AS k, 0 AS b FROM orders UNION ALL SELECT o_orderkey, 1 FROM orders UNION ALL SELECT 0, 2), x AS (SELECT k, row_number() OVER (ORDER BY b, k) AS place FROM t) "
    "SELECT k, place FROM x"
)
def insertion_order(spark, sf_dir):
    """Rows that tie are numbered in the order in which they came, over several inserts."""
    e = Engine(spark)
    e.execute("CREATE TABLE t (k INT, same INT)")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(7).alias("same")).repartitionByRange(8, "k").sortWithinPartitions("k")
    e.insert_frame("t", rows)
    e.insert_frame("t", rows)
    e.execute("INSERT INTO t (k, same) VALUES (0, 7)")
    return e.execute("SELECT k, ROW_NUMBER() OVER (ORDER BY same) AS place FROM t")


@query("SELECT event_id, nullif(event_type, 'error') AS kind FROM events WHERE nullif(event_type, 'error') <> 'click'")
def not_equal_nulls(spark, sf_dir):
    e = Engine(spark)
    e.register("ev", read(spark, sf_dir, "events").select("event_id", F.expr("nullif(event_type, 'error')").alias("kind")))
    assert e.execute("SELECT event_id FROM ev WHERE kind <> NULL").isEmpty() and e.execute("SELECT event_id FROM ev WHERE NOT kind = NULL").isEmpty()
    return e.execute("SELECT event_id, kind FROM ev WHERE kind <> 'click'")


statement("order_offset", ("part",), "SELECT p_partkey, p_size FROM part ORDER BY p_partkey LIMIT 20 OFFSET 15")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k')::VARCHAR = '7'")
def json_lookup(spark, sf_dir):
    """Equality of JSON values whatever their spacing: the column is written with spaces, the literal without."""
    e = Engine(spark)
    e.execute("CREATE TABLE t (event_id INT, props JSONB)")
    props = F.regexp_replace(F.regexp_replace("props", ":", " :  "), ",", " , ")
    e.insert_frame("t", read(spark, sf_dir, "events").select("event_id", props.alias("props")))
    return e.execute("SELECT event_id FROM t WHERE props = '{\"k\":7}'")


ROOTS = "CASE p_size % 3 WHEN 0 THEN 'part' WHEN 1 THEN 'item' ELSE 'thing' END"


@query(f"SELECT p_partkey, {ROOTS} AS root FROM part WHERE {ROOTS} <> 'item'")
def xml_roots(spark, sf_dir):
    root = F.expr(ROOTS)
    xml = F.concat(F.lit("<?xml version='1.0'?><!-- c --><"), root, F.lit(" xmlns:a='u' n='"), F.col("p_partkey").cast("string"), F.lit("'><a:in>x</a:in></"), root, F.lit(">"))
    p = read(spark, sf_dir, "part").select("p_partkey", xml.alias("doc"))
    return p.withColumn("root", semistructured.xml_root_name(F.col("doc"))).where("root <> 'item'").select("p_partkey", "root")


@query("SELECT p_partkey FROM part WHERE p_partkey % 50 <= 12 AND 10 <= p_partkey % 50 + 5 AND p_size <= 30 AND 12 <= p_size + 2")
def spatial_overlap(spark, sf_dir):
    x, y = (F.col("p_partkey") % 50).cast("double"), F.col("p_size").cast("double")
    box = F.format_string("[%s,%s,%s,%s]", x.cast("string"), y.cast("string"), (x + 5).cast("string"), (y + 2).cast("string"))
    g = read(spark, sf_dir, "part").withColumn("g", semistructured.parse_geometry(box))
    return g.where(semistructured.overlaps(F.col("g"), semistructured.geometry_literal(("bbox", 10.0, 12.0, 12.0, 30.0)))).select("p_partkey")


@query("SELECT p_partkey, 'POINT(' || (p_partkey % 7)::DOUBLE || ' ' || (-p_size)::DOUBLE || ')' AS shape FROM part UNION ALL SELECT -p_partkey, '[' || 0.0 || ',' || (-p_size)::DOUBLE || ',' || p_size::DOUBLE || ',' || 5.0 || ']' FROM part")
def geometry_round_trip(spark, sf_dir):
    """Points and boxes of several spellings, parsed and printed; a box with its corners swapped is put right."""
    p = read(spark, sf_dir, "part")
    point = F.format_string("  point( %s ,%s )", (F.col("p_partkey") % 7).cast("string"), (-F.col("p_size")).cast("string"))
    box = F.format_string('{"type": "bbox", "coordinates": [%s, 5, 0, %s]}', F.col("p_size").cast("string"), (-F.col("p_size")).cast("string"))
    both = p.select("p_partkey", point.alias("t")).unionByName(p.select((-F.col("p_partkey")).alias("p_partkey"), box.alias("t")))
    return both.select("p_partkey", semistructured.print_geometry(semistructured.parse_geometry(F.col("t"))).alias("shape"))


statement(
    "fulltext_spanish",
    ("docs",),
    "",
    "SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 IN (0, 1)",
)


def _spanish(spark, sf_dir):
    """Plural and other forms of a word meet by their stems; stop words don't count."""
    forms = F.element_at(F.array(*[F.lit(x) for x in ("las flores rojas", "una flor roja", "la casa", "estaciones")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    e = Engine(spark)
    e.register("docs", read(spark, sf_dir, "supplier").select("s_suppkey", forms.alias("t")))
    return e.execute("SELECT s_suppkey FROM docs WHERE t @@ 'los flor' LANGUAGE 'spanish'")


_spanish.__name__ = "fulltext_spanish"
Q["fulltext_spanish"] = _spanish


@query(
    "SELECT 'customer' AS table_name, 'c_custkey' AS column_name, count(DISTINCT c_custkey) AS distinct_count, min(c_custkey)::VARCHAR AS min_value, max(c_custkey)::VARCHAR AS max_value FROM customer "
    "UNION ALL SELECT 'customer', 'c_mktsegment', count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer"
)
def catalog_scan(spark, sf_dir):
    """The statistics catalog read by statement, after it went through its file."""
    e = Engine(spark)
    e.execute("CREATE TABLE customer (c_custkey INT, c_mktsegment TEXT)")
    e.insert_frame("customer", read(spark, sf_dir, "customer"))
    e.execute("ANALYZE customer")
    path = new_path(spark, "catalog")
    e.save_statistics(path)
    e.stats.clear()
    e.histograms.clear()
    e.load_statistics(path)
    return e.execute("SELECT table_name, column_name, distinct_count, min_value, max_value FROM column_statistics")


@query("SELECT 'big' AS name, count(*) FILTER (n_regionkey >= 2) AS row_count FROM nation UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def show_tables(spark, sf_dir):
    e = Engine(spark)
    e.execute("CREATE TABLE region (r_regionkey INT, r_name TEXT)")
    e.execute("CREATE TABLE nation (n_nationkey INT, n_regionkey INT)")
    e.insert_frame("region", read(spark, sf_dir, "region"))
    e.insert_frame("nation", read(spark, sf_dir, "nation"))
    e.execute("CREATE MATERIALIZED VIEW big AS SELECT n_nationkey FROM nation WHERE n_regionkey >= 2")
    return e.execute("SHOW TABLES").select("name", "row_count")


@query("SELECT 3::BIGINT AS total_tables, 1::BIGINT AS analyzed_tables, 9::BIGINT AS total_columns, 2::BIGINT AS analyzed_columns")
def statistics_summary(spark, sf_dir):
    e = Engine(spark)
    for name in ("a", "b"):
        e.execute(f"CREATE TABLE {name} (k INT, v TEXT)")
        e.insert_frame(name, read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))
    e.execute("CREATE MATERIALIZED VIEW v AS SELECT k FROM a WHERE k >= 3")
    e.execute("ANALYZE a")
    return e.statistics_summary()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000")
def execution_modes(spark, sf_dir):
    """One query by rows and in batches."""
    e = engine(spark, sf_dir, "orders")
    found = []
    for mode in ("row", "vectorized"):
        e.set_execution(Execution(mode, 1024))
        df = e.measured(e.execute("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000"))
        found.append(spark.read.schema(df.schema).parquet(written(df, "mode")))
        assert e.last_execution()["output_rows"] == found[-1].count()
    e.set_execution(Execution("auto"))
    return found[0].unionByName(found[1])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def result_cache(spark, sf_dir):
    """A repeated query reads its written result."""
    e = Engine(spark)
    e.execute("CREATE TABLE t (o_orderkey INT, o_orderstatus TEXT)")
    e.insert_frame("t", read(spark, sf_dir, "orders"))
    sql = "SELECT o_orderkey FROM t WHERE o_orderstatus = 'P'"
    e.execute(sql)
    out = e.execute(sql.replace("t ", "T "))
    assert e.cache_stats() == {"hits": 1, "misses": 1, "entries": 1, "written": 1}
    return out


def _views(spark, sf_dir, mode: str) -> tuple[Engine, DataFrame]:
    e = Engine(spark, async_delay=1e9)
    o = read(spark, sf_dir, "orders")
    e.execute("CREATE TABLE t (o_orderkey INT, o_custkey INT, o_totalprice FLOAT)")
    e.insert_frame("t", o.where("o_orderstatus = 'F'"))
    e.execute(f"CREATE MATERIALIZED VIEW big {mode} AS SELECT o_orderkey, o_custkey, o_totalprice FROM t WHERE o_totalprice >= 150000")
    e.execute(f"CREATE MATERIALIZED VIEW biggest {mode} AS SELECT o_orderkey, o_custkey FROM big WHERE o_totalprice >= 300000")
    return e, o


BIGGEST = "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 300000 AND o_orderstatus IN ('F', 'O')"


@query(BIGGEST)
def view_cascade(spark, sf_dir):
    """A view on a view follows what is inserted below both."""
    e, o = _views(spark, sf_dir, "")
    e.insert_frame("t", o.where("o_orderstatus = 'O'"))
    return e.execute("SELECT * FROM biggest")


@query(BIGGEST)
def view_refresh(spark, sf_dir):
    """Delayed views stay as they were until they are refreshed: one by statement, what reads it by the queue."""
    e, o = _views(spark, sf_dir, "REFRESH ASYNCHRONOUS")
    before = e.execute("SELECT * FROM biggest").count()
    e.insert_frame("t", o.where("o_orderstatus = 'O'"))
    assert e.execute("SELECT * FROM biggest").count() == before
    e.execute("REFRESH MATERIALIZED VIEW big SYNCHRONOUS")
    while e.run_pending_refreshes(force=True):
        pass
    return e.execute("SELECT * FROM biggest")


@query("SELECT 'n' || n_nationkey AS \"from\", 'r' || n_regionkey AS \"to\", 'In' AS label, '{}' AS properties FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'a', 'r1', 'In', '{since: 7}'")
def graph_edit(spark, sf_dir):
    """Nodes and edges by statement and in bulk; ids and labels match in any case."""
    e = Engine(spark)
    e.execute("CREATE GRAPH g")
    e.execute("CREATE NODE g ID 'a'")
    e.execute("CREATE NODE g ID 'r1'")
    e.execute("CREATE EDGE g FROM 'a' TO 'r1' LABEL 'In' WITH PROPERTIES (since='7')")
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    ids = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")).unionByName(r.where("r_regionkey <> 1").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id")))
    g = e.graphs["g"]
    none = F.create_map().cast("map<string,string>")
    g.nodes = g.nodes.unionByName(ids.withColumn("properties", none))
    g.add_edges(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("In").alias("label"), none.alias("properties")))
    return e.execute("MATCH GRAPH g TO 'R1' LABEL 'in'")


# -- logs, versions, keys


@query(
    "WITH x AS (SELECT user_id AS id, event_id AS lsn, event_type AS op, value FROM events WHERE event_id <= 3000), l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS n FROM x) "
    "SELECT 'u' || id AS id, lsn::VARCHAR AS payload FROM l WHERE n = 1 AND op <> 'error'"
)
def collection_log(spark, sf_dir):
    """Batch upserts and deletes of a collection, a snapshot on the way, and recovery from the newest snapshot and the rest of the log."""
    ev = _log(spark, sf_dir).where("lsn <= 3000")
    ops = ev.select("lsn", "ts", F.when(F.col("op") == "error", "remove").otherwise("upsert").alias("op"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("id"), F.array(F.col("value").cast("float"), F.lit(1.0).cast("float")).alias("vector"), F.col("lsn").cast("string").alias("payload"))
    ops = ops.select(*[F.col(c) for c in spark.createDataFrame([], POINT_LOG).columns])
    folder = new_path(spark, "snapshots")
    first = Collection(spark, "c", 2, "euclidean")
    first.upsert(oplog.latest(ops.where("lsn <= 1000"), "id", "lsn").where("op = 'upsert'").select("id", "vector", "payload"))
    first.save_snapshot(folder, 500)
    first.delete(oplog.latest(ops.where("lsn <= 2000"), "id", "lsn").where("op = 'remove'").select("id"))
    first.upsert(oplog.latest(ops.where("lsn <= 2000"), "id", "lsn").where("op = 'upsert'").select("id", "vector", "payload"))
    first.save_snapshot(folder, 2000)
    again = Collection(spark, "d", 2, "euclidean")
    again.recover(folder, ops.where("lsn > 2000"))
    return again.points().select("id", "payload")


@query("SELECT 'u' || vec_id AS id, 'disk' AS tier FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT 'u' || vec_id, 'hybrid' FROM embeddings WHERE vec_id % 5 <> 0")
def collection_tiers(spark, sf_dir):
    c = Collection(spark, "c", 64, "cosine")
    e = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("u"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("payload"), (F.col("vec_id") % 5 == 0).alias("gone"))
    c.upsert(e.drop("gone"))
    c.delete(e.where("gone").select("id"))
    return c.held("disk").select("id", F.lit("disk").alias("tier")).unionByName(c.held("hybrid").select("id", F.lit("hybrid").alias("tier")))


@query("SELECT 'docs' AS name, 64::BIGINT AS dim, 'cosine' AS metric, 'cells' AS index, 0::BIGINT AS count, 8::BIGINT AS cells, 5::BIGINT AS nprobe UNION ALL SELECT 'pics', 3, 'euclidean', 'brute_force', 0, 16, 2")
def collections_listed(spark, sf_dir):
    e = Engine(spark)
    e.execute("CREATE COLLECTION docs (DIM = 64, METRIC = 'cosine', INDEX = 'hnsw', M = 8, EF_SEARCH = 3)")
    e.execute("CREATE COLLECTION pics (DIM = 3, METRIC = 'l2', INDEX = 'bruteforce')")
    e.set_ef_search("docs", 5)
    e.set_ef_search("pics", 2)
    return e.list_collections()


@query("SELECT 'log_size_bytes{collection=\"' || event_type || '\"} ' || count(*) * 40 AS line FROM events GROUP BY event_type UNION ALL SELECT 'log_seconds_since_truncate{collection=\"' || event_type || '\"} inf' FROM events GROUP BY event_type UNION ALL SELECT 'log_bytes_since_truncate{collection=\"' || event_type || '\"} ' || count(*) * 40 FROM events GROUP BY event_type")
def log_gauges(spark, sf_dir):
    size = F.count("*") * 40
    logs = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("collection")).agg(size.alias("bytes"), F.lit(None).cast("double").alias("since_truncate"), size.alias("bytes_since_truncate"))
    return monitor.log_gauges(logs)


@query("SELECT user_id AS id, arg_max(value, event_id) AS value FROM events WHERE user_id BETWEEN 10 AND 40 GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def key_reads(spark, sf_dir):
    """Newest values of a range of keys, tombstones left out; puts and deletes are rows of the log."""
    log = _log(spark, sf_dir).select("id", "lsn", F.when(F.col("op") != "error", F.col("value")).alias("value"))
    found = oplog.latest(oplog.key_range(log, "id", 10, 40), "id", "lsn").where("value is not null").select("id", "value")
    one = oplog.key_get(log, "id", "lsn", 11, "value")
    assert one.join(found, ["id", "value"], "left_anti").isEmpty()
    return found


@query("SELECT o_custkey AS k, o_orderkey AS row_id FROM orders WHERE o_custkey >= 20 AND o_custkey < 60")
def duplicate_key_cursor(spark, sf_dir):
    """All rows of a range of keys, in order of key and row, where keys repeat."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("row_id"))
    return oplog.key_range(o, "k", 20, None).where("k < 60").orderBy("k", "row_id")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'new' ELSE n_name END AS v FROM nation WHERE n_nationkey % 5 <> 1 UNION ALL SELECT 500, 'more'")
def versioned_writes(spark, sf_dir):
    """Inserts by transaction 1 and 4, updates by 2, deletes by 3, and what a snapshot after them sees."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("v"))
    none = spark.createDataFrame([], "id bigint, v string, begin_xid bigint, end_xid bigint")
    t = versioned.insert_versions(none, n, 1)
    t = versioned.update_versions(t, n.where("id % 5 = 0").withColumn("v", F.lit("new")), "id", 2, xmin=2, xmax=2, active=[])
    t = versioned.end_versions(t, n.where("id % 5 = 1"), "id", 3, xmin=3, xmax=3, active=[])
    t = versioned.insert_versions(t, spark.createDataFrame([(500, "more")], "id bigint, v string"), 4)
    return versioned.visible(t, xmin=5, xmax=5, active=[]).select("id", "v")


STATES = "CASE event_type WHEN 'error' THEN 'aborted' WHEN 'click' THEN 'committed' ELSE 'active' END"


@query(f"SELECT count(*) FILTER (s = 'active') AS active, count(*) FILTER (s = 'committed') AS committed, count(*) FILTER (s = 'aborted') AS aborted, min(event_id) FILTER (s = 'active') AS oldest_active FROM (SELECT event_id, {STATES} AS s FROM events)")
def transaction_counts(spark, sf_dir):
    return versioned.transaction_stats(read(spark, sf_dir, "events").select(F.col("event_id").alias("xid"), F.expr(STATES).alias("state"), F.col("event_id").alias("started")))


TXN = "SELECT event_id AS xid, user_id AS page, event_type IN ('click', 'error') AS writes, event_id * 10 AS begun, event_id * 10 + 5 + (event_id * 7919) % 4001 AS committed, event_id % 3 <> 0 AS checked FROM events"


@query(
    f"WITH t AS ({TXN}) SELECT DISTINCT a.xid FROM t a JOIN t b ON a.page = b.page AND a.xid <> b.xid AND (a.writes OR b.writes) AND b.begun <= a.committed AND (b.committed > a.committed OR (b.committed = a.committed AND b.xid > a.xid)) WHERE a.checked"
)
def transaction_conflicts(spark, sf_dir):
    t = read(spark, sf_dir, "events").selectExpr("event_id AS xid", "user_id AS page", "event_type IN ('click', 'error') AS writes", "event_id * 10 AS begun", "event_id * 10 + 5 + (event_id * 7919) % 4001 AS committed", "event_id % 3 <> 0 AS checked")
    return transactions.conflicts(t.select("xid", "page", "writes"), t.select("xid", "begun", "committed", "checked"))


MODES = "CASE {c} % 3 WHEN 0 THEN 'shared' WHEN 1 THEN 'update' ELSE 'exclusive' END"


@query(
    f"WITH h AS (SELECT o_custkey AS resource, {MODES.format(c='o_orderkey')} AS mode FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT c_custkey AS resource, {MODES.format(c='c_nationkey')} AS mode FROM customer) "
    "SELECT r.resource, r.mode, CASE r.mode WHEN 'shared' THEN count(*) FILTER (h.mode = 'exclusive') = 0 WHEN 'update' THEN count(*) FILTER (h.mode IN ('exclusive', 'update')) = 0 ELSE count(h.mode) = 0 END AS granted "
    "FROM r LEFT JOIN h ON r.resource = h.resource GROUP BY r.resource, r.mode"
)
def lock_requests(spark, sf_dir):
    held = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("o_custkey AS resource", f"{MODES.format(c='o_orderkey')} AS mode")
    return transactions.lock_requests(held, read(spark, sf_dir, "customer").selectExpr("c_custkey AS resource", f"{MODES.format(c='c_nationkey')} AS mode"))


@query("SELECT event_id AS lsn, event_type AS op FROM events WHERE event_id >= 500")
def stream_tail(spark, sf_dir):
    """The log as a stream from a position on, drained once."""
    schema = read(spark, sf_dir, "events").schema
    folder = new_path(spark, "tail")
    read(spark, sf_dir, "events").write.parquet(f"{folder}/in")
    live = spark.readStream.schema(schema).parquet(f"{folder}/in").select(F.col("event_id").alias("lsn"), F.col("event_type").alias("op"))
    run = oplog.tail(live, "lsn", 500).writeStream.format("parquet").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("lsn", "op")


# -- codecs, filters


@query("SELECT event_id, value FROM events")
def delta_round_trip(spark, sf_dir):
    """Differences in order and back; whole numbers, so sums are exact."""
    ev = read(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 1_000_000).cast("bigint").alias("v"), "value")
    back = codecs.undelta(codecs.deltas(ev, "event_id", "v"), "event_id").withColumnRenamed("value", "w")
    assert ev.join(back, "event_id").where("v <> w").isEmpty()
    return ev.join(back.where("w is not null").select("event_id"), "event_id").select("event_id", "value")


@query("SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) < 64 THEN 'none' ELSE 'lz4' END AS codec, md5(text) AS digest FROM documents")
def codec_round_trip(spark, sf_dir):
    """Every codec packs and unpacks every text; the adaptive choice is shown."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", codecs.choose(F.octet_length(F.coalesce("text", F.lit("")))).alias("codec"))
    shared = b"the of and a in is to that it for on with as was by " * 8
    back = codecs.round_trip(F.col("text"), ["lz4", "zstd", "delta", "dictionary", F.col("codec")], shared)
    return d.select("doc_id", "codec", F.md5(back).alias("digest"))


@query("SELECT place::BIGINT AS place, event_type AS value FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, event_type FROM events)")
def rle_round_trip(spark, sf_dir):
    return oplog.run_values(oplog.run_lengths(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type"))


@query("SELECT p_partkey, p_brand AS decoded FROM part")
def dictionary_round_trip(spark, sf_dir):
    words, coded = oplog.dictionary_codes(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand")
    return oplog.dictionary_values(coded.select("p_partkey", "code"), words).select("p_partkey", "decoded")


@query("SELECT count(*) AS keys, count(*) AS found, true AS few_others FROM (SELECT DISTINCT o_custkey FROM orders)")
def bloom_filter(spark, sf_dir):
    """No key that was put in is missed, and few others pass."""
    keys = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    f = membership.BloomFilter.build(keys, "k")
    hits = f.probe(keys, "k").agg(F.count("*").alias("keys"), F.sum(F.col("hit").cast("bigint")).alias("found"))
    others = f.probe(keys.select((F.col("k") + 1_000_000_000).alias("k")), "k").agg((F.avg(F.col("hit").cast("int")) < 0.05).alias("few_others"))
    return hits.crossJoin(F.broadcast(others))  # one row each


# -- vectors

IDS = "vec_id % 100 = 0"


@query(f"SELECT count(*) FILTER ({IDS}) AS queries, true AS enough, true AS on_unit FROM embeddings")
def ann_recall(spark, sf_dir):
    """Recall of cells on every row whose id is divisible by 100, against brute force over all rows, by both metrics."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    told = []
    for metric in ("euclidean", "cosine"):
        index = vectors.CellIndex.build(e, CELLS, metric, "embedding", "vec_id").written()
        exact = vectors.table_topk(e, e.where(IDS), 10, metric, "embedding", "vec_id")
        told.append(vectors.recall(index.search_batch(e.where(IDS), 10, PROBED), exact).first())  # one row
    row = [(told[0]["queries"], told[0]["recall"] >= 0.9, told[1]["recall"] >= 0.9)]
    return spark.createDataFrame(row, "queries bigint, enough boolean, on_unit boolean")


#: Cells, and those that a search reads: recall of 0.9 on tables without clusters, as `embeddings` are, needs most of them.
CELLS, PROBED = 16, 14


@query()
def ann_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = vectors.CellIndex.build(e, CELLS, "euclidean", "embedding", "vec_id").written().search_batch(e.where(IDS), 10, PROBED)
    return found.withColumn("score", F.round("score", 9))


@query(f"SELECT count(*) FILTER ({IDS}) AS queries, true AS enough FROM embeddings")
def pq_recall(spark, sf_dir):
    """Recall of product codes, re-ranked by whole vectors, on every row whose id is divisible by 100."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pq = quantization.Product.train(e, 16, 16, "embedding", "vec_id")
    found = quantization.search_batch(e, pq, e.where(IDS), 10, 30, "embedding", "vec_id")
    got = vectors.recall(found, vectors.table_topk(e, e.where(IDS), 10, "euclidean", "embedding", "vec_id")).first()
    return spark.createDataFrame([(got["queries"], got["recall"] >= 0.9)], "queries bigint, enough boolean")


@query()
def pq_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pq = quantization.Product.train(e, 16, 16, "embedding", "vec_id")
    return quantization.search_batch(e, pq, e.where(IDS), 10, 30, "embedding", "vec_id").withColumn("score", F.round("score", 9))


@query("SELECT vec_id, 16::BIGINT AS parts, true AS in_range, true AS same FROM embeddings")
def pq_codes(spark, sf_dir):
    """Codes are centroids' numbers, the distance by tables is that to the decoded vector, and a vector's own centroid is its nearest."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pq = quantization.Product.train(e, 16, 16, "embedding", "vec_id")
    q = _vector(spark, sf_dir)
    coded = e.select("vec_id", pq.encode(F.col("embedding")).alias("codes"))
    by_table, by_vector = pq.asymmetric(F.col("codes"), q), distance.euclidean(pq.decode(F.col("codes")), distance.vector(q))
    return coded.select("vec_id", F.size("codes").cast("bigint").alias("parts"), F.forall("codes", lambda c: (c >= 0) & (c < 16)).alias("in_range"), (F.abs(by_table - by_vector) < 1e-9).alias("same"))


P = "WITH x AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1))::BIGINT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM x GROUP BY dim), q AS (SELECT dim, v AS qv FROM x WHERE vec_id = 7)"


@query(f"{P} SELECT vec_id, round(sqrt(sum((lo + floor(least(greatest((v - lo) * (255.0::DOUBLE / (hi - lo)), 0), 255)) / (255.0::DOUBLE / (hi - lo)) - qv) ** 2)), 6) AS score FROM x JOIN p USING (dim) JOIN q USING (dim) GROUP BY vec_id")
def sq_distance(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    sq = quantization.Scalar.train(e, "embedding")
    return e.select("vec_id", F.round(sq.distance(sq.encode(F.col("embedding")), _vector(spark, sf_dir)), 6).alias("score"))


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 16 ELSE 8 END::BIGINT AS codes FROM embeddings")
def hybrid_quantizer(spark, sf_dir):
    """Long vectors by product codes, short ones by a code a dimension."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    short = e.where("vec_id % 2 = 1").select("vec_id", F.slice("embedding", 1, 8).alias("embedding"))
    pq, sq = quantization.Product.train(e, 16, 16, "embedding", "vec_id"), quantization.Scalar.train(short, "embedding")
    sized = lambda df: df.select("vec_id", F.size(quantization.hybrid_codes(F.col("embedding"), pq, sq, 64)).cast("bigint").alias("codes"))
    return sized(e.where("vec_id % 2 = 0")).unionByName(short.select("vec_id", F.size(sq.encode(F.col("embedding"))).cast("bigint").alias("codes")))


# -- statistics, partitions, plans


@query(
    "WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT unnest(range(10)) AS bucket), "
    "v AS (SELECT o_totalprice AS v, CASE WHEN o_orderkey % 4 = 0 THEN 1 WHEN o_orderkey % 4 = 1 THEN 0 ELSE 1 END AS n FROM orders), "
    "c AS (SELECT least(floor((v - lo) / w), 9)::BIGINT AS bucket, sum(n) AS n FROM v, e WHERE v >= lo AND v <= lo + 10 * w GROUP BY 1) SELECT b.bucket, coalesce(n, 0)::BIGINT AS count FROM b LEFT JOIN c ON b.bucket = c.bucket"
)
def histogram_updates(spark, sf_dir):
    """An equal-width histogram that follows inserts and deletes."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    h = statistics.equi_width(o.where("o_orderkey % 4 <> 0"), F.col("v"))
    changes = o.where("o_orderkey % 4 = 0").select("v", F.lit(1).alias("delta")).unionByName(o.where("o_orderkey % 4 = 1").select("v", F.lit(-1).alias("delta")))
    return statistics.apply_updates(h, changes)[0].select("bucket", "count")


@query("SELECT 10::BIGINT AS buckets, count(*) AS rows, 2::BIGINT AS runs FROM orders")
def scheduled_refresh(spark, sf_dir):
    """Histograms that a scheduled job keeps up; a cancelled job no longer runs."""
    e = Engine(spark)
    e.execute("CREATE TABLE t (o_totalprice FLOAT)")
    refresher = Refresher(e)
    o = read(spark, sf_dir, "orders")
    e.insert_frame("t", o.where("o_orderkey % 2 = 0"))
    job = refresher.schedule("t", 60.0)
    refresher.run_due(now=0.0)
    e.insert_frame("t", o.where("o_orderkey % 2 = 1"))
    refresher.run_due(now=30.0)
    refresher.run_due(now=61.0)
    runs = refresher.jobs[job].runs
    refresher.cancel(job)
    refresher.run_due(now=1000.0)
    h = e.histograms["t", "o_totalprice"]
    return spark.createDataFrame([(len(h), sum(n for _, _, n in h), runs)], "buckets bigint, rows bigint, runs bigint")


@query("WITH x AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT g AS o_orderpriority, max(v) FILTER (r = round((n - 1) * 0.5::DOUBLE)) AS p50, max(v) FILTER (r = round((n - 1) * 0.99::DOUBLE)) AS p99 FROM x GROUP BY g")
def bench_percentiles(spark, sf_dir):
    return statistics.rank_percentiles(read(spark, sf_dir, "orders"), "o_totalprice", {"p50": 0.5, "p99": 0.99}, ["o_orderpriority"], rounded=True)


@query("SELECT count(*) AS rows, count(DISTINCT o_custkey) AS keys, 0::BIGINT AS split_keys, 8::BIGINT AS parts, true AS even FROM orders")
def hash_partition(spark, sf_dir):
    """Every row has one of the partitions, a key is in one alone, and keys are spread evenly."""
    scheme = Scheme.of(ast.Partitioning("hash", "o_custkey", count=8), "INTEGER")
    rows = read(spark, sf_dir, "orders").select("o_custkey", scheme.label().alias("part"))
    keys = rows.groupBy("o_custkey").agg(F.count_distinct("part").alias("in_parts"), F.any_value("part").alias("part"), F.count("*").alias("n"))
    by_part = keys.groupBy("part").agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.sum((F.col("in_parts") > 1).cast("bigint")).alias("split_keys"))
    return by_part.agg(F.sum("rows").alias("rows"), F.sum("keys").alias("keys"), F.sum("split_keys").alias("split_keys"), F.count("*").alias("parts"), (F.max("keys") < 4 * F.min("keys")).alias("even"))


@query("SELECT CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 30 THEN 'mid' ELSE 'high' END AS part, count(*) AS n FROM part GROUP BY 1")
def partition_changes(spark, sf_dir):
    """A partition dropped and others added."""
    scheme = Scheme.of(ast.Partitioning("range", "p_size", (("low", (10,)), ("gone", (20,)), ("high", None))), "INTEGER")
    scheme = scheme.drop("gone").add("mid", 30)
    return read(spark, sf_dir, "part").groupBy(scheme.label().alias("part")).agg(F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT count(*) AS n FROM embeddings) SELECT CASE WHEN n < 10000 THEN 'brute_force' ELSE 'cells' END AS index, round(n * 64 * 1e-6, 9) AS exact_ms, round(ln(n) / ln(2) * 50 * 64 * 2e-6, 9) AS cells_ms, n * 64 * 4 AS exact_bytes, n * 64 * 4 + n * 64 AS cells_bytes, "
    "'row' AS storage FROM s"
)
def index_advice(spark, sf_dir):
    n = read(spark, sf_dir, "embeddings").count()
    row = (estimator.recommend_index(estimator.Workload(n, 64)), round(estimator.predict_latency_ms("brute_force", n, 64), 9), round(estimator.predict_latency_ms("cells", n, 64), 9), estimator.predict_memory("brute_force", n, 64), estimator.predict_memory("cells", n, 64), estimator.storage_mode(n, 300, [n]))
    return spark.createDataFrame([row], "index string, exact_ms double, cells_ms double, exact_bytes bigint, cells_bytes bigint, storage string")


# -- monitoring

TRACES = "SELECT conv_id AS trace_id, min(turn) AS start, sum(length(text))::DOUBLE AS duration_ms, CASE WHEN count(*) > 8 THEN 'error' ELSE 'ok' END AS status FROM conversations GROUP BY conv_id"


def _traces(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("trace_id"))
    return c.agg(F.min("turn").alias("start"), F.sum(F.length("text")).cast("double").alias("duration_ms"), F.when(F.count("*") > 8, "error").otherwise("ok").alias("status"))


@query(f"SELECT trace_id, 'slow' AS found FROM ({TRACES}) WHERE duration_ms > 800 UNION ALL SELECT trace_id, 'failed' FROM ({TRACES}) WHERE status = 'ok' UNION ALL SELECT trace_id, 'early' FROM ({TRACES}) WHERE start <= 1")
def trace_lookups(spark, sf_dir):
    t = _traces(spark, sf_dir)
    named = lambda df, name: df.select("trace_id", F.lit(name).alias("found"))
    return named(monitor.find_traces(t, slower_than=800.0), "slow").unionByName(named(monitor.find_traces(t, status="ok"), "failed")).unionByName(named(monitor.find_traces(t, start=0, end=1), "early"))


@query("SELECT event_id FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.25")
def trace_sampling(spark, sf_dir):
    return monitor.sample_traces(read(spark, sf_dir, "events").select("event_id"), 0.25, "event_id")


@query(
    "WITH x AS (SELECT value, event_type, ts, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events), s AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, avg(value) AS a, max(value) FILTER (r = least(floor(0.95::DOUBLE * n)::BIGINT, n - 1)) AS p, epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS span FROM x) "
    "SELECT 0 AS place, '# Performance report' AS line UNION ALL SELECT 1, '## Summary' UNION ALL SELECT 2, '- queries: ' || n FROM s UNION ALL SELECT 3, '- errors: ' || errors FROM s UNION ALL SELECT 4, '- average latency ms: ' || printf('%.2f', a) FROM s "
    "UNION ALL SELECT 5, '- p95 latency ms: ' || printf('%.2f', p) FROM s UNION ALL SELECT 6, '- queries a second: ' || printf('%.4f', n / greatest(span, 1)) FROM s UNION ALL SELECT 7, '## Recent'"
)
def performance_report(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    return monitor.performance_report(ev, "value", F.col("event_type") == "error", "ts").where("place < 8")


@query(
    "WITH x AS (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) "
    "SELECT event_id, (value > m + 2 * s OR value < m - 2 * s) AND value > 0 AND n >= 50 AS anomaly FROM x"
)
def anomaly_both_sides(spark, sf_dir):
    return monitor.anomalies(read(spark, sf_dir, "events"), "value", "event_id", "both", ["event_type"], least=0.0).select("event_id", "anomaly")


CHECKS = "SELECT event_id AS name, CASE event_id % 3 WHEN 0 THEN 'memory_percent' WHEN 1 THEN 'disk_percent' ELSE 'api_ms' END AS metric, CASE WHEN event_id % 3 = 2 THEN value * 10 ELSE value END AS value FROM events"


@query(
    f"WITH c AS ({CHECKS}), t AS (SELECT name, metric, CASE metric WHEN 'memory_percent' THEN CASE WHEN value > 90 THEN 'critical' WHEN value > 75 THEN 'warning' ELSE 'healthy' END WHEN 'disk_percent' THEN CASE WHEN value > 95 THEN 'critical' WHEN value > 85 THEN 'warning' ELSE 'healthy' END "
    "ELSE CASE WHEN value > 1000 THEN 'critical' WHEN value > 500 THEN 'warning' ELSE 'healthy' END END AS status FROM c) SELECT name::VARCHAR AS name, status FROM t "
    "UNION ALL SELECT 'overall', CASE WHEN count(*) FILTER (status = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (status = 'warning') > 0 THEN 'warning' ELSE 'healthy' END FROM t"
)
def health_checks(spark, sf_dir):
    checked = monitor.health(read(spark, sf_dir, "events").selectExpr("event_id AS name", "CASE event_id % 3 WHEN 0 THEN 'memory_percent' WHEN 1 THEN 'disk_percent' ELSE 'api_ms' END AS metric", "CASE WHEN event_id % 3 = 2 THEN value * 10 ELSE value END AS value"))
    return checked.select(F.col("name").cast("string").alias("name"), "status").unionByName(monitor.overall_health(checked).select(F.lit("overall").alias("name"), "status"))


@query("WITH x AS (SELECT user_id % 10 AS k, value AS v, row_number() OVER (PARTITION BY user_id % 10 ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY user_id % 10) AS n FROM events WHERE event_id >= 100) SELECT k, any_value(n) AS n, round(avg(v), 6) AS avg_ms, max(v) FILTER (r = least(floor(0.95::DOUBLE * n)::BIGINT, n - 1)) AS p95_ms FROM x GROUP BY k")
def workload_stats(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("k"), "event_id", "value")
    return monitor.workload(ev, 100, "event_id", "value").withColumn("avg_ms", F.round("avg_ms", 6))
