"""Line numbers, sidecar schemas, nested paths, the chunk cache, log tails and prefix sums, by hand-made cases."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sievework.operators import select, storage, vector
from sievework.sources import cache, files
from sievework.streaming import monitor


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 5000), ("b.jsonl", 3)):
        (tmp_path / name).write_text("".join("\n" if i % 10 == 9 else json.dumps({"v": i}) + "\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.numbered_lines(spark, str(tmp_path)).collect()
        assert len(got) == 5003
        assert all(r.value == ("" if r.line % 10 == 9 else json.dumps({"v": r.line})) for r in got)
        part = files.json_lines(spark, f"{tmp_path}/a.jsonl", "v long", start=1000, limit=20).collect()
        assert sorted((r.line, r.v) for r in part) == [(i, i) for i in range(1000, 1020) if i % 10 != 9]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "c.jsonl").write_text('{"v": 1}\n\n{"w": 2}\nnone\n{"v": 3}')
    bad = files.json_lines_errors(spark, f"{tmp_path}/c.jsonl", "v long", ["v"]).collect()
    assert sorted((r.line, r.text) for r in bad) == [(3, '{"w": 2}'), (4, "none")]


def test_schema_sidecar_merges(spark, tmp_path):
    folder = f"file://{tmp_path}/raw"
    files.merge_schema(spark, folder, "images", [10, 32, 32, 4], "uint8", {"image_size": 32, "channels": 4})
    merged = files.merge_schema(spark, folder, "hashes", [10], "int64", {"image_size": 16})
    assert json.loads((tmp_path / "raw" / "schema.json").read_text()) == merged
    assert merged["image_size"] == 16 and merged["channels"] == 4 and set(merged["files"]) == {"images", "hashes"}


def test_nested_paths(spark):
    df = spark.createDataFrame([({"a": ["x", "/home/u"], "b": {"k": "C:\\\\z"}, "n": 3}, None), (None, "~/y")], "s struct<a: array<string>, b: map<string, string>, n: int>, t string")
    assert sorted((r.column, r.value) for r in files.local_paths(df, ["s", "t"]).collect()) == [("s", "/home/u"), ("s", "C:\\\\z"), ("t", "~/y")]
    assert files.local_paths(spark.range(3), ["id"]).count() == 0


def test_cache_resumes_and_notices_changes(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/cache", "chunk long, index long, feature string"

    def compute(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["chunk"], b["index"], pa.array([x * 2 for x in b["value"].to_pylist()])], names=["chunk", "index", "feature"])

    rows = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id long, v string")
    fill = lambda df, who="one": cache.fill(df, "id", "v", folder, who, compute, schema, chunk=10)
    assert fill(rows.filter("id < 20")) == 2 and fill(rows) == 3 and fill(rows) == 0
    assert {r["index"]: r.feature for r in cache.read(spark, folder, schema).collect()} == {i: f"v{i}v{i}" for i in range(50)}
    assert cache.violations(spark, folder, schema).count() == 0
    with pytest.raises(ValueError, match="filled by 'one'"):
        fill(rows, "two")
    run = cache.manifest(spark, folder).filter("chunk = 0").first()["run"]
    spark.createDataFrame([(0, 0, "other"), (1, 10, "v")], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/data/run={run}")
    assert {(r.chunk, r.rule) for r in cache.violations(spark, folder, schema).collect()} == {(0, "changed"), (1, "changed")}


def test_tail_counts_bad_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.jsonl").write_text('{"step": 1}\nnone\n{"step": 2}\n{"step": ')
    stream = monitor.tail_json(spark, f"{tmp_path}/log", "step long", bad="bad")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(monitor.count_lines(spark.read.schema("step long, bad string").parquet(f"{tmp_path}/out"), "bad").first()) == (4, 2)


def test_pair_gaps_without_pairs(spark):
    rnd = random.Random(1)
    rows = [(g, rnd.choice([0.0, 1.5, rnd.random() * 100])) for g in "abc" for _ in range(200)] + [("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None)]
    got = {r.g: (r.pairs, r.gap) for r in vector.mean_pair_gap(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", blocks=7).collect()}
    for g in ("a", "b", "c", "same"):
        v = [x for h, x in rows if h == g]
        gaps = [abs(x - y) for i, x in enumerate(v) for y in v[:i]]
        assert got[g][0] == len(gaps) and abs(got[g][1] - sum(gaps) / len(gaps)) < 1e-9
    assert got["one"] == (0, None) and "none" not in got


def test_selection_is_the_same_for_any_partitioning(spark):
    rows = [(i, f"s{i % 4}", f"p{i % 9}", i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, s string, p string, v int")
    runs = [
        lambda d: select.capped_round_robin(d, "s", "p", "id", 25, 2, ["s1", "s0", "s3"]),
        lambda d: select.cap_after_union([d.filter("v < 3").select("id", "p"), d.filter("v > 1").select("id", "p")], "id", "p", 3, 20, 4),
        lambda d: select.top_per_group(d, ["s"], [F.desc("v"), "id"], 3),
        lambda d: select.cyclic_successor(d.select("id", "p"), "p", "id"),
    ]
    for run in runs:
        a, b = (sorted(map(tuple, run(d).collect())) for d in (df.repartition(2), df.orderBy(F.desc("id")).repartition(6)))
        assert a == b and a


def test_shared_folder_is_asked_for(spark):
    class Far:
        master = "spark://far:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = type("C", (), {"get": lambda self, k, d=None: d})(), Far()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_base(Session())
    assert storage.shared_folder(spark, "x") != storage.shared_folder(spark, "x")
