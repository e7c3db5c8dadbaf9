"""Statements end to end on small literal tables."""

import pytest
from pyspark.sql import functions as F

from quernel.errors import ConflictError, EngineError, ParseError, SchemaError
from quernel.session import Engine
from quernel.sources.external import ParquetSource
from quernel.sql import ast
from quernel.sql.parser import parse


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def e(spark):
    return Engine(spark, async_delay=3600)


def run(e, *sql):
    out = None
    for s in sql:
        out = e.execute(s)
    return out


def test_insert_select_and_boolean(e):
    run(e, "CREATE TABLE users (id INT, name TEXT, active BOOLEAN)", "INSERT INTO users VALUES (1, 'Alice', TRUE), (2, 'Bob', FALSE)")
    assert rows(e.execute("select NAME from USERS where Active = 'true'")) == [("Alice",)]
    assert rows(e.execute("SHOW TABLES"))[0][:2] == ("users", 2)


def test_json_xml_geometry(e):
    run(e, "CREATE TABLE d (id INT, data JSON, meta JSONB, body XML, area GEOMETRY)")
    run(e, """INSERT INTO d VALUES (1, '{"k": 1, "a": 2}', {"s": true}, '<r><i/></r>', POINT(1 2)), (2, '{"k":2}', '{"s":false}', '<a></a>', [0,0,5,5]), (3, '{"a":2,"k":1}', NULL, NULL, 'POINT(1 2)')""")
    assert rows(e.execute("""SELECT id FROM d WHERE data = '{"a": 2, "k": 1}'""")) == [(1,), (3,)]
    assert rows(e.execute("SELECT id FROM d WHERE area = POINT(1 2)")) == [(1,), (3,)]
    assert rows(e.execute("SELECT id FROM d WHERE body = '<r><i/></r>'")) == [(1,)]
    for bad in ("(4, '{', NULL, NULL, NULL)", "(4, NULL, NULL, '<a>', NULL)", "(4, NULL, NULL, NULL, 'LINE(1)')"):
        with pytest.raises(SchemaError):
            e.execute(f"INSERT INTO d VALUES {bad}")
    assert e.execute("SELECT * FROM d").count() == 3


def test_insert_is_checked_as_a_whole(e):
    run(e, "CREATE TABLE t (id INT, note TEXT)")
    with pytest.raises(SchemaError):
        e.execute("INSERT INTO t VALUES (1, 'a'), ('abc', 'b')")
    assert e.execute("SELECT * FROM t").count() == 0
    run(e, "INSERT INTO t (note) VALUES ('x')")
    assert rows(e.execute("SELECT id, note FROM t WHERE id IS NULL")) == [(None, "x")]


def test_range_partitions_prune_and_keep_results(e):
    run(e, "CREATE TABLE r (ts TIMESTAMP, v INT) PARTITION BY RANGE(ts) (PARTITION a VALUES LESS THAN ('2023-01-02'), PARTITION b VALUES LESS THAN ('2023-01-03'), VALUES LESS THAN MAXVALUE)")
    run(e, "INSERT INTO r VALUES ('2023-01-01', 10), ('2023-01-02T00:00:00Z', 20), ('2023-01-05', 30)")
    df = e.execute("SELECT v FROM r WHERE ts BETWEEN '2023-01-02 12:00:00' AND '2023-01-01'")
    assert rows(df) == [(10,), (20,)]
    assert "PartitionFilters: [isnotnull" in df._jdf.queryExecution().toString() or "PartitionFilters: [__part" in df._jdf.queryExecution().toString()
    run(e, "CREATE TABLE s (v INT) PARTITION BY RANGE(v) (VALUES LESS THAN (5))")
    with pytest.raises(EngineError):
        e.execute("INSERT INTO s VALUES (7)")
    run(e, "INSERT INTO s VALUES (3)")
    assert rows(e.execute("SELECT v FROM s WHERE v BETWEEN 1 AND 100")) == [(3,)]


def test_hash_and_list_partitions(e):
    run(e, "CREATE TABLE h (k INT) PARTITION BY HASH(k) PARTITIONS 4", "INSERT INTO h VALUES (1), (2), (3)")
    assert rows(e.execute("SELECT k FROM h WHERE k = 2")) == [(2,)]
    run(e, "CREATE TABLE l (k TEXT) PARTITION BY LIST(k) (PARTITION rest DEFAULT, PARTITION ab VALUES IN ('a', 'b'))", "INSERT INTO l VALUES ('a'), ('z')")
    assert rows(e.execute("SELECT k FROM l WHERE k = 'a'")) == [("a",)]
    with pytest.raises(SchemaError):
        e.execute("CREATE TABLE bad (k TEXT) PARTITION BY LIST(k) (PARTITION x VALUES IN ('a'), PARTITION y VALUES IN ('a'))")


def test_row_number_orders_by_input_on_ties(e):
    run(e, "CREATE TABLE s (region TEXT, amount INT)", "INSERT INTO s VALUES ('east', 100), ('east', 50), ('west', 75), ('east', 50)")
    got = rows(e.execute("SELECT region, amount, ROW_NUMBER() OVER (PARTITION BY region ORDER BY amount) AS n FROM s"))
    assert got == [("east", 50, 1), ("east", 50, 2), ("east", 100, 3), ("west", 75, 1)]
    assert "row_number" in e.execute("SELECT ROW_NUMBER() OVER (ORDER BY amount) FROM s").columns


def test_ctes_and_recursion(e):
    run(e, "CREATE TABLE c (id INT, parent_id INT, name TEXT)", "INSERT INTO c VALUES (1, NULL, 'root'), (2, 1, 'child'), (3, 2, 'grandchild'), (4, NULL, 'alone')")
    q = "WITH RECURSIVE t AS (SELECT id, name FROM c WHERE parent_id IS NULL UNION ALL SELECT id, name FROM c WHERE parent_id IN t.id) SELECT name FROM t"
    assert rows(e.execute(q)) == [("alone",), ("child",), ("grandchild",), ("root",)]
    run(e, "CREATE TABLE loop (id INT, next INT)", "INSERT INTO loop VALUES (1, 2), (2, 1)")
    assert rows(e.execute("WITH RECURSIVE t AS (SELECT id FROM loop WHERE id = 1 UNION ALL SELECT id FROM loop WHERE next IN t.id) SELECT id FROM t")) == [(1,), (2,)]
    with pytest.raises(ParseError):
        parse("WITH a AS (SELECT x FROM t), A AS (SELECT x FROM t) SELECT x FROM a")


def test_merge(e):
    run(e, "CREATE TABLE target (id INT, amount INT)", "CREATE TABLE updates (id INT, amount INT)", "INSERT INTO target VALUES (1, 10)", "INSERT INTO updates VALUES (1, 100), (2, 200), (2, 300), (NULL, 5)")
    run(e, "MERGE INTO target AS t USING updates AS u ON t.id = u.id WHEN MATCHED THEN UPDATE SET amount = u.amount WHEN NOT MATCHED THEN INSERT (id, amount) VALUES (u.id, u.amount)")
    assert sorted(map(tuple, e.execute("SELECT * FROM target").collect()), key=str) == [(1, 100), (2, 300), (None, 5)]
    with pytest.raises(ConflictError):
        e.execute("MERGE INTO target AS t USING updates AS u ON t.id = u.id WHEN MATCHED THEN UPDATE SET amount = t.amount")


def test_merge_from_cte_inserts_first(e):
    run(e, "CREATE TABLE dest (id INT, name TEXT)", "CREATE TABLE staging (id INT, name TEXT)", "INSERT INTO dest VALUES (1, 'old')", "INSERT INTO staging VALUES (1, 'new'), (3, 'third'), (3, 'later')")
    run(e, "WITH s AS (SELECT id, name FROM staging) MERGE INTO dest USING s ON dest.id = s.id WHEN NOT MATCHED THEN INSERT (id, name) VALUES (s.id, s.name)")
    assert rows(e.execute("SELECT * FROM dest")) == [(1, "old"), (3, "third")]


def test_full_text(e):
    run(e, "CREATE TABLE a (id INT, content TEXT)", "INSERT INTO a VALUES (1, 'The future of systems design'), (2, 'Rust excels at systems work'), (3, NULL)")
    assert rows(e.execute("SELECT id FROM a WHERE content @@ 'the systems'")) == [(1,)]
    assert rows(e.execute("SELECT id FROM a WHERE content @@ 'the systems' LANGUAGE 'English'")) == [(1,), (2,)]
    assert rows(e.execute("SELECT id FROM a WHERE content @@ '...'")) == []
    run(e, "CREATE TABLE s (id INT, t TEXT)", "INSERT INTO s VALUES (1, 'Los sistemas distribuidos'), (2, 'Arquitectura de sistemas complejos')")
    assert rows(e.execute("SELECT id FROM s WHERE t @@ 'los sistemas' LANGUAGE 'spanish'")) == [(1,), (2,)]


def test_views_refresh_and_answer_covered_queries(e):
    run(e, "CREATE TABLE u (id INT, active BOOLEAN)", "INSERT INTO u VALUES (1, TRUE), (2, FALSE)")
    run(e, "CREATE MATERIALIZED VIEW act AS SELECT id FROM u WHERE active = TRUE", "INSERT INTO u VALUES (3, TRUE)")
    assert rows(e.execute("SELECT * FROM act")) == [(1,), (3,)]
    assert rows(e.execute("SELECT id FROM act WHERE id = 3")) == [(3,)]
    run(e, "CREATE MATERIALIZED VIEW slow REFRESH ASYNCHRONOUS AS SELECT id FROM u", "INSERT INTO u VALUES (4, TRUE)")
    assert e.execute("SELECT id FROM u").count() == 3  # the stale view covers it
    assert e.run_pending_refreshes(force=True) == 1
    assert e.execute("SELECT id FROM u").count() == 4
    run(e, "CREATE MATERIALIZED VIEW second AS SELECT id FROM act WHERE id >= 3", "INSERT INTO u VALUES (9, TRUE)")
    assert rows(e.execute("SELECT * FROM second")) == [(3,), (4,), (9,)]


def test_cache(e):
    run(e, "CREATE TABLE t (id INT)", "INSERT INTO t VALUES (1)")
    run(e, "SELECT id FROM t", "select ID from T")
    assert e.cache_stats()["hits"] == 1
    run(e, "INSERT INTO t VALUES (2)")
    assert e.execute("SELECT id FROM t").count() == 2
    assert e.cache_stats()["misses"] == 2


def test_analyze_and_estimates(e, spark):
    run(e, "CREATE TABLE m (id INT, score FLOAT, label TEXT)", "INSERT INTO m VALUES (1, 0.5, 'a'), (2, 0.7, 'b'), (3, 0.7, NULL)", "ANALYZE m", "ANALYZE")
    got = {r["column_name"]: r for r in e.execute("SELECT * FROM column_statistics").collect()}
    assert (got["score"]["distinct_count"], got["score"]["min_value"], got["label"]["null_count"], got["id"]["stats_version"]) == (2, "0.5", 1, 2)
    with pytest.raises(EngineError):
        e.execute("ANALYZE nowhere")
    with pytest.raises(EngineError):
        e.execute("INSERT INTO table_statistics VALUES (1)")
    run(e, "CREATE TABLE c (id INT)", "CREATE TABLE o (cid INT)", "INSERT INTO c VALUES (1),(2),(3),(4),(5)", "INSERT INTO o VALUES (1),(1),(2),(3),(4),(5),(5),(NULL),(99)", "ANALYZE")
    seen = e.hash_join("c", "o", "id", "cid").count()
    assert seen == 7 and abs(e.estimate_join("c", "o", "id", "cid").rows - seen) <= 0.25 * seen
    assert 0 < e.estimate("SELECT id FROM m WHERE id >= 2").rows <= 3


def test_graph(e):
    run(e, "CREATE GRAPH g", "CREATE NODE g ID 'alice' WITH PROPERTIES (role='admin')", "CREATE NODE g ID 'bob'", "CREATE EDGE g FROM 'alice' TO 'bob' LABEL 'FOLLOWS' WITH PROPERTIES (since='2023-01-01', a='1')")
    assert rows(e.execute("MATCH GRAPH g FROM 'ALICE' LABEL 'follows' WITH PROPERTIES (since='2023-01-01')")) == [("alice", "bob", "FOLLOWS", "{a: 1, since: 2023-01-01}")]
    assert e.execute("MATCH GRAPH g TO 'alice'").count() == 0
    for bad in ("CREATE GRAPH G", "CREATE NODE g ID 'Bob'", "CREATE EDGE g FROM 'bob' TO 'eve'"):
        with pytest.raises(EngineError):
            e.execute(bad)


def test_federation(e, spark, tmp_path):
    spark.createDataFrame([("A", 10), ("C", 30)], "city string, population long").write.parquet(str(tmp_path / "x"))
    source = ParquetSource(str(tmp_path / "x"))
    e.register("city_stats", source)
    run(e, "CREATE TABLE residents (id INT, city TEXT)", "INSERT INTO residents VALUES (1, 'A'), (2, 'B'), (3, NULL)")
    assert rows(e.execute("SELECT id FROM residents WHERE city IN city_stats.city")) == [(1,)]
    plan = e.execute("SELECT city FROM city_stats WHERE population >= 20")
    assert rows(plan) == [("C",)] and "PushedFilters: [IsNotNull(population), GreaterThanOrEqual(population,20)]" in plan._jdf.queryExecution().toString()
    source.scan(spark, F.col("population") > 1)
    assert source.pushdowns == 1


def test_collections_by_statement(e):
    run(e, "CREATE COLLECTION c (DIM=2, METRIC=cosine, INDEX='bruteforce')")
    run(e, "INSERT INTO c VALUES (ID='a', VECTOR=[1, 0], PAYLOAD={\"kind\":\"doc\"})", "INSERT INTO c VALUES (ID='b', VECTOR=[0, 1], PAYLOAD={\"kind\":\"x\"})", "INSERT INTO c VALUES (ID='a', VECTOR=[1, 1], PAYLOAD={\"kind\":\"doc\"})")
    got = e.execute("SEARCH c (VECTOR=[0, 1], TOPK=2)").collect()
    assert [r["id"] for r in got] == ["b", "a"] and got[0]["score"] == pytest.approx(0)
    assert rows(e.execute("SEARCH c (VECTOR=[0, 1], TOPK=2, FILTER={\"kind\":\"doc\"})").select("id")) == [("a",)]
    with pytest.raises(SchemaError):
        e.execute("SEARCH c (VECTOR=[0, 1, 2], TOPK=2)")


@pytest.mark.parametrize("sql", ["DROP TABLE t", "SELECT", "SELECT a FROM t WHERE", "CREATE TABLE t (a VARCHAR(10))", "SELECT a FROM t WHERE a = 'x", "ANALYZEfoo", "WITH a AS (SELECT x FROM t UNION ALL SELECT x FROM t) SELECT x FROM a", "SELECT a FROM t extra"])
def test_rejected(sql):
    with pytest.raises(ParseError):
        parse(sql)


def test_column_named_like_a_keyword_part():
    assert parse("SELECT fromage FROM t").select.items == (ast.ColumnItem("fromage"),)


def test_unknown_things(e):
    run(e, "CREATE TABLE t (id INT)")
    for bad in ("SELECT x FROM t", "SELECT id FROM nowhere", "CREATE TABLE T (id INT)", "CREATE TABLE u (id BLOB)", "INSERT INTO t VALUES (1, 2)", "SELECT id FROM t WHERE id = 'abc'"):
        with pytest.raises(EngineError):
            e.execute(bad)
