"""The corpus pipeline, stage by stage, against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernel.llm import mixing, quality_rules

from .test_llm import DOCS, brute_classes, brute_dedup, edited, words


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    out = []
    for g in range(30):
        base = [f"w{r.randint(0, 900)}" for _ in range(r.choice([25, 60, 150]))]
        out += [edited(r, base, r.choice([0, 1, 2])) for _ in range(r.choice([1, 2, 4]))]
    out += ["junk | " * 40, "short text", "", None]
    return [(i, t, "en", f"s{i % 4}", 1) for i, t in enumerate(out)]


def test_stages(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, step(spark, docs, str(tmp_path))
        if name != "best-fit packing":
            assert docs.columns == before.columns
        kept[name] = docs.collect()
    by_rule = {x["doc_id"] for x in quality_rules.decide(spark.createDataFrame(rows, DOCS)).where("kept").collect()}
    assert {r["doc_id"] for r in kept["quality rules"]} == by_rule
    left = [r for r in rows if r[0] in by_rule]
    once = sorted(r[0] for r in brute_dedup(left) if r[3])
    assert sorted(r["doc_id"] for r in kept["exact dedup"]) == once
    texts = [rows[i][1] for i in once]
    assert sorted(r["doc_id"] for r in kept["n-gram Jaccard join"]) == sorted({once[k] for k in brute_classes(texts, 5, 80)[1]})
    near = spark.createDataFrame([tuple(r) for r in kept["n-gram Jaccard join"]], DOCS)
    times = {x["doc_id"]: x["taken"] // x["size"] for x in mixing.decide(near).collect() if x["taken"]}
    assert collections.Counter(r["doc_id"] for r in kept["mixing"]) == times
    pieces = kept["best-fit packing"]
    assert collections.Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == times
    assert all(words(r["text"]) for r in kept["mixing"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rs: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert key(whole) == key(pieces) and len({r["sequence_id"] for r in whole}) == len({r["sequence_id"] for r in pieces})


def test_odd_rows(spark, rows, tmp_path):
    """Null and repeated ids, repeated rows, equal texts, a very long text, clashing names, and an empty table."""
    long = " ".join(f"l{i}" for i in range(30000)) + "."
    some = [(*r[:3], r[3], 1) for r in rows[:12]]
    odd = [*some, some[0], (None, some[1][1], "en", "s0", 1), (None, some[1][1], "en", "s0", 1), (some[2][0], some[3][1], None, None, None), (9000, long, "en", "s9", 1), (9001, long, "en", "s9", 1), (9002, None, None, None, None)]
    df = spark.createDataFrame(odd, DOCS).withColumn("row", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("size", F.lit(3)).withColumn("sha", F.lit(4))
    for data in (df, df.where("false")):
        docs = data
        for name, step in corpus_pipeline.STAGES:
            before, docs = docs, step(spark, docs, str(tmp_path))
            if name != "best-fit packing":
                assert docs.columns == df.columns
                docs = spark.createDataFrame(docs.collect(), df.schema)
        found = docs.collect()
        if data is not df:
            assert found == []
            continue
        kept = {x["doc_id"] for x in found}
        assert 9000 in kept and 9001 not in kept and 9002 not in kept and None not in kept
        pieces = [x for x in found if x["doc_id"] == 9000]
        assert max(x["start"] + x["length"] for x in pieces) > 30000
