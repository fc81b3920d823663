"""Hand-made rows and brute-force twins of operators that SQL does not show."""

import json
import random
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from sievework.functions import pixels, repair
from sievework.functions import text as X
from sievework.operators import dedup, graph, joins, ledger, select, splits, storage, windows
from sievework.sources import files
from sievework.streaming import monitor


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (None, 3)]
    edges += [(1000, 1001 + i) for i in range(80)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), splits.checkpointed).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), splits.checkpointed).count() == 0


def test_transitive_split_ignores_order(spark):
    rows = [("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "z")]
    out = []
    for r in (rows, rows[::-1]):
        df = splits.transitive_split(spark.createDataFrame(r, "lineage string, content string"), "lineage", "content", seed=3)
        out.append({(x.lineage, x.content): (x.split_group, x.split) for x in df.collect()})
    assert out[0] == out[1]
    assert len({g for g, _ in out[0].values()}) == 2 and out[0]["a", "x"][0] == "c:x"


def test_holdout_quarantines_every_copy(spark):
    df = spark.createDataFrame([("p", "h", 1), ("q", "h", 2), ("p", "i", 3), ("q", "h", 4)], "project string, content string, id int")
    out = splits.project_holdout(df, "project", "content", assignments={"p": "train", "q": "val"})
    assert {r.id: (r.split, r.quarantined) for r in out.collect()} == {1: ("train", True), 2: ("val", True), 3: ("train", False), 4: ("val", True)}
    assert [r.project for r in splits.unknown_assignments(df, "project", {"p": "val", "zz": "val"}).collect()] == ["zz"]
    with pytest.raises(ValueError, match="violations"):
        splits.fail_closed(splits.unknown_assignments(df, "project", {"zz": "val"}))


def test_group_key_parts_and_fallback(spark):
    df = spark.createDataFrame([(1, "a", "b", "f"), (2, "a", "", "f"), (3, None, "b", None)], "id int, x string, y string, z string")
    out = {r.id: (r.group, r.by_row) for r in splits.group_split(df, ["x", "y"], "id", fallback=["z"]).collect()}
    assert out == {1: ("a|b", False), 2: ("f", False), 3: ("__row__3", True)}


def test_capped_round_robin_equals_a_loop(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("abc"), f"p{rnd.randrange(6)}") for i in range(200)]
    queues = {s: sorted((i, p) for i, t, p in rows if t == s) for s in "abc"}
    used, want, moved = {}, [], True
    while len(want) < 14 and moved:
        moved = False
        for s in "cab":
            for k, (i, p) in enumerate(queues[s]):
                if used.get(p, 0) < 3 and len(want) < 14:
                    used[p] = used.get(p, 0) + 1
                    want.append(i)
                    queues[s] = queues[s][k + 1 :]
                    moved = True
                    break
            else:
                queues[s] = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "id long, stratum string, project string").repartition(parts)
        got = select.capped_round_robin(df, "stratum", "project", "id", 14, 3, ["c", "a", "b"]).collect()
        assert sorted(r.id for r in got) == sorted(want)


def test_selection_ignores_partitioning(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, f"t{i % 5}", f"n{i % 11}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    order = [F.sha2(F.col("id").cast("string"), 256)]
    runs = [
        lambda d: select.round_robin(d, "a", order, 40),
        lambda d: select.nested_round_robin(d, "a", "b", "c", "id", 40, 2),
        lambda d: select.proportional(d, "b", order, 37),
        lambda d: select.capped_rounds(d, "id", [(F.col("id") > 50, "a", 4), (F.col("id") < 200, "b", 3)], order[0], 60),
        lambda d: select.reservoir(d, "a", "id", 5, 1),
        lambda d: dedup.first_wins(d, ["c"], ["id"]),
    ]
    for run in runs:
        a, b = (sorted(r.id for r in run(d).collect()) for d in (df.repartition(2), df.orderBy(F.desc("id")).repartition(6)))
        assert a == b and a


def test_proportional_cases(spark):
    def take(sizes, n):
        rows = [(s, i) for s, k in sizes.items() for i in range(k)]
        got = select.proportional(spark.createDataFrame(rows, "s string, i int"), "s", ["i"], n).groupBy("s").count().collect()
        return {r.s: r["count"] for r in got}

    assert take({"a": 50, "b": 50}, 64) == {"a": 32, "b": 32}
    assert take({"a": 5, "b": 3}, 20) == {"a": 5, "b": 3}
    assert take({"a": 5, "b": 3, "c": 3}, 4) == {"a": 2, "b": 1, "c": 1}
    assert take({"a": 10, "b": 1, "c": 1}, 11) == {"a": 10, "b": 0 or 1}


def test_greedy_near_duplicates_compare_with_kept_rows_only(spark):
    rows = [(1, 1, [0.0]), (1, 2, [3.0]), (1, 3, [6.0]), (2, 4, [0.0])]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>")
    got = {r.key: r.kept_by for r in dedup.greedy_near_duplicates(df, "g", "id", "v", 4.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_paired_difference_is_fail_closed(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double"), spark.createDataFrame([(1, 5.0)], "k int, v double")
    with pytest.raises(Exception, match="different keys"):
        joins.paired_difference(a, b, ["k"], "v").collect()


def test_json_repair():
    assert repair.extracted('x ```json\n{"a": 1}\n``` y') == {"a": 1}
    assert repair.extracted('{"a": [1, {"b": "c"}, {"d": "un') == {"a": [1, {"b": "c"}, {}]}
    assert repair.extracted('{"a": "x\\"y", "b": tru') == {"a": 'x"y'}
    assert repair.extracted("no json") is None and repair.extracted(None) is None and repair.extracted("") is None
    assert repair.first_object('see {"a": {"b": 2}} and {"c": 3}') == {"a": {"b": 2}}
    whole = json.dumps({"s": "a{b}[c", "n": [1, 2, {"k": None}], "t": True})
    for cut in range(len(whole)):
        found = repair.extracted(whole[:cut])
        assert found is None or set(found) <= {"s", "n", "t"}


def test_undo_is_a_stack(spark):
    rnd = random.Random(3)
    rows, stack = [], []
    for revision in range(1, 200):
        if stack and rnd.random() < 0.4:
            rows.append((revision, 0, "keep", True))
            stack.pop()
        else:
            rows.append((revision, rnd.randrange(9), rnd.choice(ledger.STATES), False))
            stack.append(rows[-1])
    df = spark.createDataFrame([(r, p, s, False, "", "", u) for r, p, s, u in rows], "revision long, pair_id long, state string, selected boolean, reason string, note string, undo boolean")
    assert sorted(r.revision for r in ledger.live_events(df).collect()) == [r[0] for r in stack]
    assert {r.pair_id: r.state for r in ledger.current(df).collect()} == {p: s for _, p, s, _ in stack}


def test_guard_batch_equals_stream_and_resumes(spark, tmp_path):
    rnd = random.Random(2)
    policy = windows.GuardPolicy(warmup=5, calibration=7, window=6, patience=2, gradient_clip=1.0, gradient_ratio=2.0, clipped_fraction=0.5, loss_ratio=1.1)
    rows = [(log, i, 1 + (i / 40 if log == "bad" else 0) + rnd.random() / 10, 0.5 + (i / 8 if log == "bad" else 0)) for log in ("bad", "good") for i in range(80)]
    df = spark.createDataFrame(rows, "log string, step long, loss double, gradient double")
    batch = {(r.log, r.window): (r.unhealthy, r.bad_windows, r.stop) for r in windows.stability_windows(df, ["log"], ["step"], "loss", "gradient", policy).collect()}
    assert any(s for *_, s in batch.values())
    for size in (1, 3, 17, 80):  # however the rows are cut into batches
        got = {}
        for log in ("bad", "good"):
            state, mine = None, pd.DataFrame([r[1:] for r in rows if r[0] == log], columns=["step", "loss", "gradient"])
            for at in range(0, 80, size):
                out, state = monitor.judge(policy, log, mine[at : at + size], json.loads(json.dumps(state)))
                got |= {(r.log, r.window): (r.unhealthy, r.bad_windows, r.stop) for r in out.itertuples()}
                assert len(state["kept"]) < max(policy.window, policy.calibration)
        assert got == batch
    with pytest.raises(ValueError, match="does not come after"):
        monitor.judge(policy, "good", mine[3:4], state)
    odd = pd.DataFrame([(100, float("nan"), 1.0), (101, 1.0, float("inf")), (102, 1.0, 1.0)], columns=["step", "loss", "gradient"])
    out, after = monitor.judge(policy, "good", odd, state)
    assert list(zip(out["step"], out["reason"], out["stop"], strict=True)) == [(100, "not_finite", True), (101, "not_finite", True)]
    assert after["rows"] == state["rows"] + 1 and after["step"] == 102
    assert monitor.judge(policy, "new", odd[:0])[1]["rows"] == 0
    files.write_sorted_json(df.filter("step < 37").coalesce(1), f"{tmp_path}/log")
    for part in (0, 1):  # the second run goes on from the checkpoint
        if part:
            df.filter("step >= 37").select(F.to_json(F.struct("*"))).coalesce(1).write.mode("append").text(f"{tmp_path}/log")
        q = monitor.guard_stream(monitor.tail_json(spark, f"{tmp_path}/log", "log string, step long, loss double, gradient double"), policy)
        q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    stream = spark.read.schema(monitor.GUARD_ROWS).parquet(f"{tmp_path}/out").collect()
    assert {(r.log, r.window): (r.unhealthy, r.bad_windows, r.stop) for r in stream} == batch


def test_idempotent_sink_and_retries(spark, tmp_path):
    sink = monitor.idempotent_sink(f"{tmp_path}/sink", "k")
    for batch_id, keys in ((0, [1, 2, 2]), (1, [2, 3]), (1, [2, 3]), (2, [])):
        sink(spark.createDataFrame([(k,) for k in keys], "k long"), batch_id)
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/sink").collect()) == [1, 2, 3]

    def worker(x):
        if x == "bad":
            raise RuntimeError("no")
        return x * 2

    out = monitor.annotate(spark.createDataFrame([(1, "a"), (2, "bad")], "k int, v string"), "k", "v", worker, tries=2, wait_s=0.0)
    assert {r.key: (r.value, r.error, r.attempts) for r in out.collect()} == {"1": ("aa", None, 1), "2": (None, "RuntimeError: no", 2)}
    assert tuple(monitor.tally(out).first()) == (1, 1)


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/pack.zip", "w") as z:
        z.writestr("assets/mod/textures/item/red_rod.png", b"1234")
        z.writestr("assets/mod/textures/item/readme.txt", b"x")
    (tmp_path / "in/broken.zip").write_bytes(b"no zip")
    (tmp_path / "in/plain.png").write_bytes(b"12")
    found = files.members(spark, f"{tmp_path}/in", (".png",))
    assert {(r.member, r.size) for r in found.collect() if r.error is None} == {("assets/mod/textures/item/red_rod.png", 4), ("plain.png", 2)}
    assert found.filter("error is not null").count() == 1
    assert [r.member for r in files.members(spark, f"{tmp_path}/in", (".png",), sizes=(2,)).filter("error is null").collect()] == ["plain.png"]
    names = spark.createDataFrame([("item.mod.red_rod", "Red rod")], "key string, name string")
    assert [tuple(r)[1:] for r in files.texture_folder(found, names).collect()] == [("mod", "item", "red_rod", "Red rod")]
    (tmp_path / "raw.bin").write_bytes(bytes(10))
    with pytest.raises(Exception, match="no multiple"):
        files.raw_records(spark, f"{tmp_path}/raw.bin", 4).collect()
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3}\n')
    assert [(r.line, r.a) for r in files.json_lines(spark, f"{tmp_path}/lines.jsonl", "a int", start=1, limit=2).collect()] == [(2, 2)]
    (tmp_path / "sheet.csv").write_text("﻿id,note\n1,x\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_review_sheet(spark, f"{tmp_path}/sheet.csv", "id string, note string").collect()] == [("1", "x")]


def test_catalog_refuses_changes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(20)], "id long, v string")
    folder = f"file://{tmp_path}/cat"
    meta = files.write_catalog(df.repartition(3), "id", folder, version=2, provenance={})
    assert files.read_catalog(spark, "id", folder, version=2).count() == 20 == meta["rows"]
    with pytest.raises(ValueError, match="version"):
        files.read_catalog(spark, "id", folder, version=3)
    spark.createDataFrame([(99, "new")], "id long, v string").write.mode("append").parquet(f"{folder}/rows")
    with pytest.raises(ValueError, match="changed"):
        files.read_catalog(spark, "id", folder, version=2)


def test_grids(spark):
    big = [c for y in range(4) for x in range(4) for c in (10 * (y // 2), 5 * (x // 2), 0, 255)]
    df = spark.createDataFrame([(1, big, 4, 4), (2, big[:-4] + [9, 9, 9, 0], 4, 4)], "id int, g array<int>, h int, w int")
    got = {r.id: r for r in df.select("id", pixels.lossless_cell("g", "h", "w").alias("cell"), pixels.unique_colors("g").alias("colors"), pixels.alpha_class("g").alias("alpha"), pixels.quantize("g", F.array(*map(F.lit, [0, 0, 0, 255, 0, 0]))).alias("q")).collect()}
    assert got[1].cell == [2, 2] and got[2].cell == [4, 4]
    assert got[1].colors == 4 and (got[1].alpha, got[2].alpha) == ("opaque", "binary") and set(got[1].q[::4]) == {0}
    hidden = spark.createDataFrame([(1, [1, 2, 3, 0]), (2, [9, 9, 9, 0]), (3, [9, 9, 9, 1])], "id int, g array<int>")
    h = {r.id: r.h for r in hidden.select("id", pixels.grid_hash("g", F.lit(1), F.lit(1)).alias("h")).collect()}
    assert h[1] == h[2] != h[3]


def test_text_edges(spark):
    df = spark.createDataFrame([("a_a-B.12 x",), ("",), (None,)], "s string")
    got = [r.t for r in df.select(X.concept_tokens("s", ["x"]).alias("t")).collect()]
    assert got == [["a", "b"], [], None]
    grid = [r.g for r in spark.createDataFrame([("t_16x16",), ("16x32",), ("116x16",)], "s string").select(X.grid_hint("s").alias("g")).collect()]
    assert grid == [16, None, None]
    licence = X.classify_license("s", F.lit("warranty"), ["mit"], ["gpl"], ["nc"], ["arr"])
    rows = spark.createDataFrame([(" MIT ",), ("gpl",), ("cc-nc",), ("odd",), (None,)], "s string").select(licence.alias("c")).collect()
    assert [r.c for r in rows] == ["allow", "review", "deny", "deny", "deny"]


def test_streaks_and_sessions(spark):
    df = spark.createDataFrame([("l", i, float(v)) for i, v in enumerate([1, 5, 6, 2, 7, 8, 9])], "log string, i int, v double")
    got = [r.streak for r in windows.streaks(df, ["log"], ["i"], F.col("v") > 4).orderBy("i").collect()]
    assert got == [0, 1, 2, 0, 1, 2, 3]
    assert [r.session for r in windows.sessions(df, ["log"], ["i"], "v").orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 1]
    best = windows.running_best(df, ["log"], ["i"], "v").orderBy("i").collect()
    assert [r.record for r in best] == [True] + [False] * 6


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in found.split("\n") if "shuffle_" in x}


def test_checkpoints_and_rounds_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(storage.REMOVAL, None)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    found = graph.connected_components(edges, storage.checkpointed)
    for _ in range(50):  # executors remove them a moment later
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(storage.REMOVAL, None) == setting
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(61)}


def test_query_runs_again_without_its_shuffle_files(spark):
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    with storage.shuffles_removed(spark):
        doubled = sums.join(sums.withColumnRenamed("n", "m"), "k").select("k", (F.col("n") + F.col("m")).alias("n"))
        once = storage.checkpointed(doubled).collect()
        first, again = doubled.collect(), doubled.collect()
    assert sorted(once) == sorted(first) == sorted(again) and sum(r.n for r in once) == 999_000
