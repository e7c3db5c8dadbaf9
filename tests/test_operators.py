"""Operators against small fixtures and plain Python."""

import itertools
import math
import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.errors import ConflictError, EngineError, SchemaError
from quernel.functions import distance, semistructured, text
from quernel.operators import codecs, joins, monitor, oplog, quantization, ranges, recursive, statistics, vectors, versioned
from quernel.operators.partitioning import Scheme
from quernel.plans import estimator
from quernel.plans.refresh import Refresher
from quernel.session import Engine
from quernel.sources.collections import Collection
from quernel.sql import ast
from quernel.streaming import streams


def values(df, column="v"):
    return [r[column] for r in df.collect()]


@pytest.mark.parametrize(
    ("word", "language", "stem"),
    [("queries", "english", "query"), ("ties", "english", "tie"), ("running", "english", "runn"), ("used", "english", "us"), ("boxes", "english", "box"), ("cats", "english", "cat"), ("gas", "english", "gas"), ("rapidamente", "spanish", "rapida"), ("estaciones", "spanish", "esta"), ("aciones", "spanish", "acion"), ("flores", "spanish", "flor"), ("casas", "spanish", "casa"), ("the", "english", None)],
)
def test_stems(spark, word, language, stem):
    got = spark.createDataFrame([(word,)], "t string").select(text.analyze(F.col("t"), language).alias("v")).first()["v"]
    assert got == ([stem] if stem else []) == text.analyze_literal(word, language)


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([3.0, 4.0], [3.0, 4.0, 9.0])], "a array<float>, b array<float>")
    assert values(df.select(distance.cosine(F.col("a"), F.col("b")).alias("v"))) == pytest.approx([1, 1, 1, 0])
    assert values(df.select(distance.euclidean(F.col("a"), F.col("b")).alias("v"))) == pytest.approx([math.sqrt(2), math.sqrt(2), math.inf, 0])


def test_metadata_filter(spark):
    df = spark.createDataFrame([('{"kind":"doc","n":1}',), ('{"kind":"x"}',), (None,), ("broken",)], "p string")
    hit = lambda w: values(df.select(semistructured.metadata_matches(F.col("p"), w).alias("v")))
    assert hit({"kind": "doc"}) == [True, False, False, False]
    assert hit({"kind": "doc", "n": 1}) == [True, False, False, False]
    assert hit({"missing": 1}) == [False] * 4 and hit({}) == [True] * 4


def test_geometry(spark):
    df = spark.createDataFrame([("POINT(1 2)",), ("[5,5,0,0]",), ('{"type":"bbox","coordinates":[0,0,1,1]}',), ("x",)], "t string")
    g = df.select(semistructured.parse_geometry(F.col("t")).alias("v"))
    assert [tuple(v) if v else None for v in values(g)] == [("point", 1, 2, 1, 2), ("bbox", 0, 0, 5, 5), ("bbox", 0, 0, 1, 1), None]
    assert values(g.select(semistructured.print_geometry(F.col("v")).alias("v")))[:2] == ["POINT(1.0 2.0)", "[0.0,0.0,5.0,5.0]"]


def test_xml_root(spark):
    assert values(spark.createDataFrame([("<a:r xmlns:a='x'><b/></a:r>",)], "t string").select(semistructured.xml_root_name(F.col("t")).alias("v"))) == ["r"]


def test_join_of_a_third(spark):
    a = spark.range(2000).withColumnRenamed("id", "k")
    b = spark.range(2000).where("id % 3 = 0").withColumnRenamed("id", "k")
    assert joins.inner_join(a, b, "k", "k", "a", "b").count() == 667
    with pytest.raises(SchemaError):
        joins.inner_join(a, b.select(F.col("k").cast("string").alias("k")), "k", "k", "a", "b")
    assert joins.salted_join(a, b, "k").count() == 667


@pytest.mark.parametrize("n", [0, 1, 7, 12, 103])
def test_equi_depth(spark, n):
    r = random.Random(n)
    data = sorted(r.randint(0, 20) for _ in range(n))
    got = [(x["lower"], x["upper"], x["count"]) for x in statistics.equi_depth(spark.createDataFrame([(v,) for v in data], "v long"), F.col("v")).orderBy("bucket").collect()]
    b = min(10, n)
    cuts = [data[i * n // b : (i + 1) * n // b] for i in range(b)]
    assert got == [(c[0], c[-1], len(c)) for c in cuts]


def test_equi_width_and_updates(spark):
    df = spark.range(20).select(F.col("id").alias("v"))
    h = statistics.equi_width(df, F.col("v"), 5)
    assert values(h.orderBy("bucket"), "count") == [4] * 5 and values(h.orderBy("bucket"), "cumulative") == [4, 8, 12, 16, 20]
    flat = statistics.equi_width(df.select(F.lit(3).alias("v")), F.col("v"), 4)
    assert values(flat.orderBy("bucket"), "count") == [20, 0, 0, 0]
    new, rebuild = statistics.apply_updates(h, spark.createDataFrame([(2.0, 1), (-5.0, 1), (19.0, -1)], "v double, delta int"))
    assert values(new.orderBy("bucket"), "count") == [5, 4, 4, 4, 3] and rebuild
    assert statistics.apply_updates(h, spark.createDataFrame([(2.0, 1)], "v double, delta int"), "equi_depth")[1]


def test_schemes():
    s = Scheme.of(ast.Partitioning("range", "v", (("b", (20,)), ("a", (10,)), ("rest", None))), "INTEGER")
    assert [x[0] for x in s.parts] == ["a", "b", "rest"]
    assert s.touched(ast.Between("V", 25, 5)) == ["a", "b", "rest"] and s.touched(ast.Compare("v", "=", 10)) == ["b"] and s.touched(ast.Compare("v", ">=", 20)) == ["rest"]
    assert s.touched(ast.Compare("w", "=", 1)) is None
    assert [x[0] for x in s.drop("b").parts] == ["a", "rest"] and len(s.add("c", 15).parts) == 4
    with pytest.raises(EngineError):
        s.add("a", 3)
    h = Scheme.of(ast.Partitioning("hash", "v", count=2), "INTEGER")
    with pytest.raises(EngineError):
        h.drop("p0")


def unit_vectors(n, d, seed=42):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def points(spark):
    x = unit_vectors(600, 16)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache(), x


def test_topk_agrees_with_numpy(points):
    df, x = points
    d = np.linalg.norm(x - x[5], axis=1)
    want = np.lexsort((np.arange(len(x)), d))[:10].tolist()
    assert values(vectors.exact_topk(df, x[5].tolist(), 10, "euclidean"), "id") == want
    batch = vectors.batch_topk(df, [x[5].tolist(), x[9].tolist()], 10, "euclidean").where("query = 0").orderBy("rank")
    assert values(batch, "id") == want
    with pytest.raises(SchemaError):
        vectors.batch_topk(df, [[1.0]], 3, dim=16)


def test_cells_reach_recall(points):
    df, x = points
    index = vectors.CellIndex.build(df, 8, "euclidean")
    hits = 0
    for q in range(0, 40, 4):
        want = set(np.argsort(np.linalg.norm(x - x[q], axis=1))[:10].tolist())
        hits += len(want & set(values(index.search(x[q].tolist(), 10, nprobe=6), "id")))
    assert hits / 100 >= 0.9
    assert values(index.search(x[1].tolist(), 3, 8, F.col("id") < 50), "id")[0] == 1


def test_quantizers(spark, points):
    df, x = points
    pq = quantization.Product.train(df, 4, 16)
    coded = df.limit(20).select("id", pq.encode(F.col("vector")).alias("c"))
    got = coded.select(pq.asymmetric(F.col("c"), x[3].tolist()).alias("a"), distance.euclidean(pq.decode(F.col("c")), distance.vector(x[3])).alias("b"), pq.asymmetric(F.col("c"), x[3].tolist(), "cosine").alias("ca"), distance.cosine(pq.decode(F.col("c")), distance.vector(x[3])).alias("cb"))
    for r in got.collect():
        assert r["a"] == pytest.approx(r["b"]) and r["ca"] == pytest.approx(r["cb"])
    flat = spark.createDataFrame([([0.0, 1.0, 7.0],), ([1.0, 3.0, 7.0],)], "vector array<double>")
    sq = quantization.Scalar.train(flat)
    probe = spark.createDataFrame([([-5.0, 10.0, 8.0],), ([0.5, 2.0, 7.0],)], "vector array<double>")
    assert values(probe.select(sq.encode(F.col("vector")).alias("v"))) == [[0, 255, 255], [127, 127, 0]]
    assert values(probe.select(sq.decode(sq.encode(F.col("vector"))).alias("v")))[1] == pytest.approx([0.5, 2.0, 7.0], abs=0.01)


def test_collection_log(spark):
    c = Collection(spark, "c", 2)
    put = lambda *rows: c.upsert(spark.createDataFrame(list(rows), "id string, vector array<float>, payload string"))
    put(("a", [1.0, 0.0], '{"name":"a1"}'), ("b", [0.0, 1.0], None))
    put(("a", [0.0, 1.0], '{"name":"a2"}'))
    assert c.delete(spark.createDataFrame([("b",)], "id string")) and not c.delete(spark.createDataFrame([("zz",)], "id string"))
    assert [(r["id"], r["payload"]) for r in c.points().collect()] == [("a", '{"name":"a2"}')]
    assert {r["id"]: r["payload"] for r in c.points(upto_lsn=1).collect()} == {"a": '{"name":"a1"}', "b": None}
    c.compact()
    put(("d", [1.0, 1.0], None))
    assert c.info()["count"] == 2
    with pytest.raises(SchemaError):
        put(("e", [1.0], None))


def test_log_views(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None), ("c", 4, "z"), ("b", 5, "w")], "k string, seq long, v string")
    assert sorted(values(oplog.compact(log, "k", "seq", "v", keep_tombstones=False))) == ["w", "z"]
    assert oplog.key_get(log, "k", "seq", "a", "v").count() == 0 and values(oplog.key_get(log, "k", "seq", "b", "v")) == ["w"]
    keys = spark.range(50).select(F.col("id").alias("k"))
    assert oplog.key_range(keys, "k", 10, 20).count() == 11
    runs = spark.createDataFrame(list(enumerate([1, 1, 1, 2, 2, 3, 3, 3, 3])), "i long, v long")
    assert [(r["value"], r["length"]) for r in oplog.run_lengths(runs, "i", "v").orderBy("start").collect()] == [(1, 3), (2, 2), (3, 4)]
    words = spark.createDataFrame([("alpha",), ("beta",), ("alpha",), (None,), ("gamma",)], "w string")
    assert sorted(values(oplog.dictionary_codes(words, "w")[1], "code"), key=str) == [0, 0, 1, 2, None]
    assert oplog.bit_width(runs, "v").first()["bits"] == 2


def test_versions(spark):
    v = spark.createDataFrame([], "id long, v string, begin_xid long, end_xid long")
    v = versioned.insert_versions(v, spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), 5)
    v = versioned.update_versions(v, spark.createDataFrame([(1, "a2")], "id long, v string"), "id", 7, xmin=6, xmax=7, active=[])
    see = lambda **s: sorted(values(versioned.visible(v, **s)))
    assert see(xmin=6, xmax=7, active=[]) == ["a", "b"]
    assert see(xmin=8, xmax=8, active=[]) == ["a2", "b"] and see(xmin=5, xmax=8, active=[7]) == ["a", "b"]
    assert see(xmin=8, xmax=8, active=[], aborted=[7]) == ["a", "b"]
    assert see(xmin=6, xmax=7, active=[], own=7) == ["a2", "b"]
    with pytest.raises(ConflictError):
        versioned.update_versions(v, spark.createDataFrame([(9, "z")], "id long, v string"), "id", 9, xmin=8, xmax=9, active=[])
    assert versioned.collect_garbage(v, "id", 8).count() == 2


def test_recursion_keeps_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "x long")
    assert recursive.fixpoint(a, lambda r: r.select((F.col("x") + 1).alias("x")).where("x < 4")).count() == 4
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    assert sorted(values(recursive.on_cycle(e), "node")) == [1, 2, 3]


def test_anomaly_starts_with_enough_samples(spark):
    data = [(i, 10.0 + i % 2) for i in range(60)] + [(60, 100.0)]
    df = monitor.anomalies(spark.createDataFrame(data, "ts long, v double"), "v", "ts")
    assert values(df.where("anomaly"), "ts") == [60]
    early = monitor.anomalies(spark.createDataFrame([(i, 1.0) for i in range(40)] + [(41, 99.0)], "ts long, v double"), "v", "ts")
    assert early.where("anomaly").count() == 0


def test_health_and_rules(spark):
    c = monitor.health(spark.createDataFrame([("m", "memory_percent", 76.0), ("d", "disk_percent", 10.0)], "name string, metric string, value double"))
    assert values(c.orderBy("name"), "status") == ["healthy", "warning"] and values(monitor.overall_health(c), "status") == ["warning"]
    rules = spark.createDataFrame([(*r[:1], r[2], r[3], r[4], True) for r in monitor.DEFAULT_RULES], "id string, metric string, operator string, threshold double, enabled boolean")
    s = spark.createDataFrame([(1, "qps", 0.5), (2, "qps", 3.0), (3, "error_rate", 9.0)], "ts long, metric string, value double")
    assert sorted((r["rule_id"], r["ts"]) for r in monitor.evaluate_rules(s, rules).where("firing").collect()) == [("high_error_rate", 3), ("low_qps", 1)]
    ema = monitor.moving_average(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "g string, ts long, v double"), "v", "ts", "g")
    assert values(ema, "ema") == pytest.approx([1.1])


def test_predictors():
    assert estimator.recommend_index(estimator.Workload(100, 8)) == "brute_force"
    assert estimator.recommend_index(estimator.Workload(200_000, 8, memory_pressure=0.9)) == "quantized_cells"
    assert estimator.predict_latency_ms("brute_force", 10_000, 768) == pytest.approx(7.68)
    assert estimator.predict_memory("cells", 10, 4) == 800
    assert estimator.storage_mode(20_000, 300, [10]) == "columnar" and estimator.storage_mode(5, 300, [1]) == "row"


def test_stream_of_a_log(spark, tmp_path):
    schema = "id string, lsn long, v string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(str(tmp_path / "in"))
    put(("a", 1, "x"), ("b", 2, "y"))
    for more in ([("a", 3, "z")], []):
        s = streams.follow(spark, str(tmp_path / "in"), schema)
        streams.upsert_into(s, str(tmp_path / "state"), "id", "lsn", str(tmp_path / "cp")).awaitTermination()
        if more:
            put(*more)
    assert sorted(values(streams.read_state(spark, str(tmp_path / "state"), schema))) == ["y", "z"]


def test_sessions(spark):
    df = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:04:00"), ("u", "2024-01-01 01:00:00")], "u string, t string").select("u", F.to_timestamp("t").alias("ts"))
    assert sorted(values(streams.sessions(df, "ts", "5 minutes", ["u"], [F.count("*").alias("n")]), "n")) == [1, 2]


def test_positions_over_ranges(spark):
    """Places in order and in groups, where one group has most rows and keys tie or are null."""
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([1, 2, None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(5)
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
    got = {x["id"]: x["at"] for x in ranges.positions(df, ["v", "id"], "at").collect()}
    assert [got[x[2]] for x in order] == list(range(1, 501))
    by_group = {x["id"]: x["at"] for x in ranges.numbered(df, ["g"], ["v", "id"], "at").collect()}
    for g in ("a", "b", None):
        assert [by_group[x[2]] for x in order if x[0] == g] == list(range(1, sum(x[0] == g for x in rows) + 1))
    assert ranges.positions(df.where("false"), ["v"]).count() == 0


def test_windows_over_chunks(spark, monkeypatch):
    """Trailing windows, alerts and runs that cross the borders of chunks."""
    r = random.Random(2)
    rows = [(i, r.choice("xy"), float(r.randint(0, 100)), r.random() < 0.6) for i in range(400)]
    df = spark.createDataFrame(rows, "ts long, rule_id string, value double, firing boolean").repartition(4)
    whole = (
        {(x["ts"], x["anomaly"], x["mean"]) for x in monitor.anomalies(df, "value", "ts", "both", ["rule_id"], baseline=20, sigmas=1.0).collect()},
        {tuple(x) for x in monitor.alert_intervals(df, "ts").collect()},
        {tuple(x) for x in oplog.run_lengths(df.select("ts", "rule_id"), "ts", "rule_id").collect()},
    )
    chunked = ranges.in_chunks
    for name in ("monitor", "oplog"):
        module = {"monitor": monitor, "oplog": oplog}[name]
        monkeypatch.setattr(module, "in_chunks", lambda *a, **k: chunked(*a, **{**k, "size": 23}))
    assert {(x["ts"], x["anomaly"], x["mean"]) for x in monitor.anomalies(df, "value", "ts", "both", ["rule_id"], baseline=20, sigmas=1.0).collect()} == whole[0]
    assert {tuple(x) for x in monitor.alert_intervals(df, "ts").collect()} == whole[1]
    assert {tuple(x) for x in oplog.run_lengths(df.select("ts", "rule_id"), "ts", "rule_id").collect()} == whole[2]
    runs = [len(list(g)) for _, g in itertools.groupby(r[1] for r in rows)]
    assert sorted(x[2] for x in whole[2]) == sorted(runs)


@pytest.mark.parametrize("seed", range(3))
def test_cycles_by_brute_force(spark, seed):
    r = random.Random(seed)
    edges = {(r.randint(0, 14), r.randint(0, 14)) for _ in range(18)}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    got = recursive.on_cycle(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert sorted(values(got, "node")) == sorted({a for a, b in reach if a == b})


def test_refresher_runs_and_stops(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE t (k INT)")
    e.insert_frame("t", spark.range(5).withColumnRenamed("id", "k"))
    refresher = Refresher(e)
    job = refresher.schedule("t", 0.0)
    refresher.start(0.01)
    for _ in range(600):
        if refresher.jobs[job].runs:
            break
        time.sleep(0.1)
    assert refresher.cancel(job) and not refresher.cancel(job)
    refresher.stop()
    assert e.stats["t"][0] == 5


def test_codecs_in_turn_share_a_worker(spark):
    """Each evaluation in a plan is a Python worker a task, which holds a batch."""
    kinds = ["none", "lz4", "zstd", "delta", "dictionary"]
    texts = [None, "", "a", "é" * 40, "the of and " * 500, *[chr(97 + i) * i for i in range(20)]]
    df = spark.createDataFrame([(i, t, kinds[i % 5]) for i, t in enumerate(texts)], "id int, v string, codec string")
    held = b"the of and a in is to"
    back = df.select("id", codecs.round_trip(F.col("v"), [*kinds, F.col("codec"), "none", F.col("codec")], held).cast("string").alias("w"))
    assert dict(back.collect()) == dict(enumerate(texts))
    packed = df.select("id", "v", "codec", *[codecs.compress(F.col("v"), c, held).alias(f"p{i}") for i, c in enumerate([*kinds, F.col("codec")])])
    for r in packed.select("*", *[codecs.decompress(F.col(f"p{i}"), c, held).cast("string").alias(f"u{i}") for i, c in enumerate([*kinds, F.col("codec")])]).collect():
        assert {r[f"u{i}"] for i in range(6)} == {r["v"]} and r["p5"] == r[f"p{kinds.index(r['codec'])}"]
    chain = df.select(codecs.decompress(codecs.compress(F.col("v"), "lz4"), "lz4").alias("w"))
    for one in (back, chain):
        assert one._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_codec_query_has_a_worker_a_task(spark):
    import __spark_entry__ as entry

    assert entry.queries()["codec_round_trip"](spark, entry.SMALL)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_nearest_by_brute_force(monkeypatch, metric):
    """Blocks of any size, rows in any parts, ties, copies, zeros, huge and missing numbers."""
    r = np.random.default_rng(5)
    for trial in range(60):
        n, k = int(r.integers(1, 60)), int(r.integers(1, 13))
        for name in ("BLOCK_QUERIES", "BLOCK_ROWS", "BLOCK_NUMBERS"):
            monkeypatch.setattr(vectors, name, int(r.integers(1, 20)))
        v = r.integers(-2, 3, size=(n, 3)) * r.choice([1, 1e-3, 1e6])
        q = v[r.integers(n, size=7)]
        v[r.integers(n)] = [1, np.nan, 0, 1e200][trial % 4]
        ids, cut = r.permutation(n).tolist(), int(r.integers(0, n + 1))
        found = vectors.Nearest(q, k, metric)
        with np.errstate(all="ignore"):
            found.show(ids[:cut], v[:cut])
            found.show(ids[cut:], v[cut:])
            got = [(x["query"], x["id"], x["score"]) for b in found.batches() for x in b.to_pylist()]
            scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
            pairs = q[:, None, :], v[None, :, :]
            s = np.sqrt(((pairs[0] - pairs[1]) ** 2).sum(2)) if metric == "euclidean" else 1 - np.divide((pairs[0] * pairs[1]).sum(2), scale, out=np.zeros(scale.shape), where=scale > 0)
        want = [(i, name, x) for i, row in enumerate(s.tolist()) for _, x, name in sorted((math.isnan(x), x, name) for x, name in zip(row, ids, strict=True))[:k]]
        assert repr(got) == repr(want)


def test_nearest_memory_is_bounded():
    """All of 3000 queries and 10000 rows would meet in 240 MB."""
    x, q = unit_vectors(10_000, 32), unit_vectors(3_000, 32, 7)
    found = vectors.Nearest(q, 10, "euclidean")
    tracemalloc.start()
    found.show(list(range(len(x))), x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6


def test_batches_of_many_queries_are_exact(spark):
    """A vector is at no distance from itself, whatever the number of queries: 800 meet 1000 rows in a task."""
    x = unit_vectors(4000, 64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4).cache()
    found = vectors.batch_topk(df, x[:800].tolist(), 2, "euclidean").collect()
    assert len(found) == 1600 and all(r["id"] == r["query"] and r["score"] == 0 for r in found if r["rank"] == 1)
    index = vectors.CellIndex.build(df, 2, "euclidean").written()
    found = index.search_batch(df.where("id < 800"), 2, 2).collect()
    assert len(found) == 1600 and all(r["id"] == r["query"] and r["score"] == 0 for r in found if r["rank"] == 1)


def test_vectors_of_a_batch_have_one_dimension(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0])], "id long, vector array<double>").coalesce(1)
    with pytest.raises(Exception, match="different dimensions"):
        vectors.batch_topk(df, [[1.0, 2.0]], 1).collect()


def test_copies_tie_by_id_in_brute_force(spark):
    """A copy's score depends on neither its task nor its place in a batch; both metrics, queries in several blocks."""
    x = unit_vectors(150, 64) * np.random.default_rng(3).uniform(0.5, 2, size=(150, 1))
    df = spark.createDataFrame([(i, x[i % 150].tolist()) for i in range(1200)], "id long, vector array<double>").repartition(3).cache()
    for metric in ("cosine", "euclidean"):
        found = vectors.table_topk(df, df.where("id < 40"), 12, metric, block=16).orderBy("query", "rank").collect()
        assert len(found) == 480
        for q in range(40):
            d = np.linalg.norm(x - x[q], axis=1) if metric == "euclidean" else 1 - x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
            near = np.argsort(d)[:2].tolist()
            assert [r["id"] for r in found[q * 12 : q * 12 + 12]] == ([i for i in range(1200) if i % 150 == near[0]] + [i for i in range(1200) if i % 150 == near[1]])[:12]
