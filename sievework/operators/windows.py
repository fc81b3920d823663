"""Metric logs: moving, running and count-based windows, streaks, resumption."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_mean(df: DataFrame, log: list[str], order: list[str], value: str, n: int, out: str = "moving") -> DataFrame:
    """E5: the mean of the last n values of each log."""
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*log).orderBy(*order).rowsBetween(1 - n, 0)))


def running_best(df: DataFrame, log: list[str], order: list[str], value: str) -> DataFrame:
    """The least value so far, and whether this row set it (an equal one does not)."""
    w = Window.partitionBy(*log).orderBy(*order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({"best": F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "record": F.coalesce(F.col(value) < before, F.col(value).isNotNull())})


def sessions(df: DataFrame, log: list[str], order: list[str], elapsed: str) -> DataFrame:
    """A new session starts where ``elapsed`` falls."""
    w = Window.partitionBy(*log).orderBy(*order)
    start = F.when(F.col(elapsed) < F.lag(elapsed).over(w), 1).otherwise(0)
    return df.withColumn("_start", start).withColumn("session", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def count_windows(df: DataFrame, log: list[str], order: list[str], size: int, skip: int = 0) -> DataFrame:
    """Numbers complete windows of ``size`` rows after the first ``skip``; rows outside them go."""
    w = Window.partitionBy(*log).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*log))
    out = df.withColumns({"_n": F.row_number().over(w) - 1 - skip, "_all": n - skip}).filter("_n >= 0")
    return out.withColumn("window", F.expr(f"_n div {size}")).filter((F.col("window") + 1) * size <= F.col("_all")).drop("_n", "_all")


def streaks(df: DataFrame, log: list[str], order: list[str], bad: Column | str, out: str = "streak") -> DataFrame:
    """How many bad rows in a row end here; a good row resets it."""
    w = Window.partitionBy(*log).orderBy(*order)
    bad = F.col(bad) if isinstance(bad, str) else bad
    marked = df.withColumns({"_bad": F.coalesce(bad, F.lit(False)), "_island": F.sum(F.when(F.coalesce(bad, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    inside = Window.partitionBy(*log, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(out, F.sum(F.when(F.col("_bad"), 1).otherwise(0)).over(inside)).drop("_bad", "_island")


@dataclass(frozen=True)
class GuardPolicy:
    warmup: int = 20
    calibration: int = 30
    window: int = 20
    patience: int = 3
    gradient_clip: float = 1.0
    gradient_ratio: float = 4.0
    clipped_fraction: float = 0.9
    loss_ratio: float = 1.15


def stability_windows(df: DataFrame, log: list[str], order: list[str], loss: str, gradient: str, policy: GuardPolicy) -> DataFrame:
    """N2 in batch (E8 + E9): each complete window after warm-up and calibration with its medians, verdict and streak.

    Unhealthy: the gradient's median above threshold, most of the window
    clipped, and the loss's median above its best by a ratio. ``stop`` once the
    streak reaches the patience. A non-finite value must be looked for separately.
    """
    w = Window.partitionBy(*log).orderBy(*order)
    rows = df.withColumn("_r", F.row_number().over(w))
    base = rows.filter((F.col("_r") > policy.warmup) & (F.col("_r") <= policy.warmup + policy.calibration))
    base = base.groupBy(*log).agg(F.greatest(F.median(gradient), F.lit(1e-12)).alias("baseline"))
    wins = count_windows(df, log, order, policy.window, policy.warmup + policy.calibration)
    agg = wins.groupBy(*log, "window").agg(
        F.median(loss).alias("loss_median"), F.median(gradient).alias("gradient_median"), F.avg((F.col(gradient) > policy.gradient_clip).cast("double")).alias("clipped")
    )
    over = Window.partitionBy(*log).orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    out = agg.join(base, log).withColumn("best", F.min("loss_median").over(over))
    threshold = F.greatest(F.lit(1.5 * policy.gradient_clip), policy.gradient_ratio * F.col("baseline"))
    out = out.withColumn("unhealthy", (F.col("gradient_median") > threshold) & (F.col("clipped") >= policy.clipped_fraction) & (F.col("loss_median") > policy.loss_ratio * F.col("best")))
    return streaks(out, log, ["window"], "unhealthy", "bad_windows").withColumn("stop", F.col("bad_windows") >= policy.patience)


def resume_prefix(df: DataFrame, step: str, attempt: str, saved: Column) -> DataFrame:
    """Rows up to the saved step, the latest attempt of each step."""
    row = F.struct(*df.columns)
    return df.filter(F.col(step) <= saved).groupBy(F.col(step).alias("_s")).agg(F.max_by(row, attempt).alias("_row")).select("_row.*")


def step_buckets(df: DataFrame, step: str, value: str, size: int) -> DataFrame:
    """Least, mean and greatest value of each bucket of steps."""
    return df.groupBy(F.expr(f"{step} div {size}").alias("bucket")).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))


def rate(df: DataFrame, log: list[str], order: list[str], clock: Column, step: str, n: int) -> DataFrame:
    """Steps per second over the last n samples; null where no time has passed."""
    w = Window.partitionBy(*log).orderBy(*order).rowsBetween(1 - n, 0)
    out = df.withColumn("_t", clock)
    return out.withColumn("rate", F.try_divide((F.col(step) - F.first(step).over(w)).cast("double"), F.col("_t") - F.first("_t").over(w))).drop("_t")
