"""Live metric logs and resumable work as Structured Streaming."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import GuardPolicy


def tail_json(spark: SparkSession, folder: str, schema: str, *, files_per_trigger: int = 1000, bad: str | None = None) -> DataFrame:
    """A stream of JSON lines from files that appear complete in a folder.

    Lines that are none are left aside; with ``bad`` they come as rows that hold
    the line in this column, so that they can be counted. The checkpoint
    remembers what was read, so a file is never taken twice; a last line without
    a newline counts as a line, as files are complete when they appear.
    ``files_per_trigger`` is the back-pressure.
    """
    reader = spark.readStream.schema(f"{schema}, `{bad}` string" if bad else schema).option("maxFilesPerTrigger", files_per_trigger)
    reader = reader.option("columnNameOfCorruptRecord", bad) if bad else reader.option("mode", "DROPMALFORMED")
    return reader.json(folder)


def count_lines(stream: DataFrame, bad: str) -> DataFrame:
    """One row with the lines that were read and those that were no JSON of the schema."""
    return stream.agg(F.count("*").alias("lines"), F.count(bad).alias("bad_lines"))


GUARD_ROWS = "log string, step long, window long, loss_median double, gradient_median double, clipped double, unhealthy boolean, bad_windows long, stop boolean, reason string"
#: Fixed values of the guard: the least baseline, and the reasons it gives.
LEAST_BASELINE = 1e-12
GROWTH, NOT_FINITE = "sustained_growth", "not_finite"


def judge(policy: GuardPolicy, log: str, rows: pd.DataFrame, state: dict | None = None) -> tuple[pd.DataFrame, dict]:
    """N2 for the next ``(step, loss, gradient)`` rows of a log: verdicts, and the state for the rows after them.

    Finite rows are numbered since the log began. Their numbers say which belong
    to the warm-up, to the calibration and to which window; a window is judged
    by array operations once its last row is there, and the rows of an
    unfinished one are kept. A value that is not finite is reported at once and
    takes no number. Steps must grow.
    """
    state = state or {"step": None, "rows": 0, "kept": [], "baseline": None, "best": None, "streak": 0}
    rows = rows.sort_values("step", kind="stable")
    step = rows["step"].to_numpy(np.int64)
    known = step if state["step"] is None else np.r_[state["step"], step]
    if (back := np.flatnonzero(np.diff(known) <= 0)).size:
        raise ValueError(f"step {known[back[0] + 1]} does not come after {known[back[0]]}")
    values = rows[["loss", "gradient"]].to_numpy(np.float64)
    finite = np.isfinite(values).all(axis=1)
    begin = policy.warmup + policy.calibration

    # rows at hand: those kept, then the new finite ones; a column each for number, step, loss, gradient
    numbers = state["rows"] + np.arange(finite.sum())
    held = np.array([*state["kept"], *np.column_stack([numbers, step[finite], values[finite]]).tolist()], np.float64).reshape(-1, 4)
    seen = state["rows"] + len(numbers)
    baseline = state["baseline"]
    if baseline is None and seen >= begin:
        early = held[(held[:, 0] >= policy.warmup) & (held[:, 0] < begin), 3]
        baseline = max(float(np.median(early)), LEAST_BASELINE) if len(early) else LEAST_BASELINE
    first = int(held[held[:, 0] >= begin, 0].min() - begin) // policy.window if (held[:, 0] >= begin).any() else 0
    ready = max(0, (seen - begin) // policy.window) - first
    full = held[held[:, 0] >= begin][: max(0, ready) * policy.window].reshape(-1, policy.window, 4)

    loss, gradient = np.median(full[:, :, 2], axis=1), np.median(full[:, :, 3], axis=1)
    clipped = (full[:, :, 3] > policy.gradient_clip).mean(axis=1)
    best = np.minimum.accumulate(loss if state["best"] is None else np.r_[state["best"], loss])[-len(loss) or len(loss) :]
    limit = max(1.5 * policy.gradient_clip, policy.gradient_ratio * (baseline or 0.0))
    bad = (gradient > limit) & (clipped >= policy.clipped_fraction) & (loss > policy.loss_ratio * best)
    at = np.arange(len(bad))
    healthy = np.maximum.accumulate(np.where(bad, -1, at)) if len(bad) else at
    streak = np.where(healthy < 0, at + 1 + state["streak"], at - healthy)
    ends = full[:, -1, 1].astype(np.int64)
    stop = streak >= policy.patience
    verdicts = pd.DataFrame({"step": ends, "window": first + at, "loss_median": loss, "gradient_median": gradient, "clipped": clipped, "unhealthy": bad, "bad_windows": streak, "stop": stop, "reason": np.where(stop, GROWTH, None)})

    # rows that are not finite say how the windows before them stood
    odd = step[~finite]
    before = np.searchsorted(ends, odd)
    standing = np.r_[state["streak"], streak].astype(np.int64)
    errors = pd.DataFrame({"step": odd, "window": first + before, "loss_median": None, "gradient_median": None, "clipped": None, "unhealthy": False, "bad_windows": standing[before], "stop": True, "reason": NOT_FINITE})
    parts = [p for p in (verdicts, errors) if len(p)]
    out = pd.concat(parts).sort_values("step") if parts else verdicts
    out.insert(0, "log", log)

    low = policy.warmup if seen < begin else begin + (first + max(0, ready)) * policy.window
    later = {"step": int(known[-1]) if len(known) else None, "rows": int(seen), "kept": held[held[:, 0] >= low].tolist(), "baseline": baseline, "best": float(best[-1]) if len(best) else state["best"], "streak": int(standing[-1])}
    return out, later


def guard_stream(stream: DataFrame, policy: GuardPolicy) -> DataFrame:
    """N2 over a stream of ``(log, step, loss, gradient)``; one guard per log, its state kept by Spark.

    Rows of one micro-batch are taken in order of step; a step that does not
    come after those of earlier batches fails the query.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out, later = judge(policy, key[0], pd.concat(list(frames)), json.loads(state.get[0]) if state.exists else None)
        state.update((json.dumps(later),))
        if len(out):
            yield out

    return stream.groupBy("log").applyInPandasWithState(run, GUARD_ROWS, "state string", "append", "NoTimeout")


def event_windows(stream: DataFrame, ts: str, width: str, slide: str | None, groups: list[str], value: str, late: str) -> DataFrame:
    """ext: event-time windows with a watermark. A zone-less time is read as UTC, which the session zone must be."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    w = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    return rows.groupBy(w, *groups).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *groups, "n", "total")


def idempotent_sink(folder: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends only keys not stored yet, each once, and replays a batch into its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(path):
            earlier = spark.read.option("basePath", folder).parquet(folder).filter(F.col("batch") != batch_id).select(key)
            fresh = fresh.join(earlier, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def annotate(df: DataFrame, key: str, value: str, worker: Callable[[str], str], *, tries: int = 3, wait_s: float = 0.5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """N5, N7, 2.13: a worker's answer for each row as ``(key, value, error, latency_s, attempts)``.

    A failing call is tried again after waits that double; the last error is
    kept as text and the row stays. Tasks are the queue's workers.
    """

    def run(batches):
        for b in batches:
            rows = []
            for k, v in zip(b["k"].to_pylist(), b["v"].to_pylist(), strict=True):
                began, answer, error = clock(), None, None
                for attempt in range(1, tries + 1):
                    try:
                        answer, error = worker(v), None
                        break
                    except Exception as e:  # a worker may fail in any way; the row says how
                        error = f"{type(e).__name__}: {e}"
                        if attempt < tries:
                            sleep(wait_s * 2 ** (attempt - 1))
                rows.append({"key": k, "value": answer, "error": error, "latency_s": clock() - began, "attempts": attempt})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("value", pa.string()), ("error", pa.string()), ("latency_s", pa.float64()), ("attempts", pa.int32())]))

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))
    return rows.mapInArrow(run, "key string, value string, error string, latency_s double, attempts int")


def tally(annotated: DataFrame) -> DataFrame:
    """How many rows succeeded and failed."""
    failed: Column = F.col("error").isNotNull()
    return annotated.agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"))
