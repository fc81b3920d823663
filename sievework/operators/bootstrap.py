"""Cluster bootstrap confidence intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_bootstrap(df: DataFrame, group: str, cluster: str, value: str, *, resamples: int = 1000, seed: int = 0, levels=(0.025, 0.975)) -> DataFrame:
    """Mean of cluster means with a percentile interval over resampled clusters.

    Rows are reduced to one mean per cluster first. Resample b draws its i-th
    cluster at ``hash(seed, group, b, i) mod n``, so results do not depend on
    the cluster of machines. Nulls take no part; for D13 the value is a paired
    difference.
    """
    means = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("group"), F.col(cluster).alias("cluster")).agg(F.avg(value).alias("mean"))
    w = Window.partitionBy("group").orderBy("cluster")
    ranked = means.select("group", "mean", (F.row_number().over(w) - 1).alias("i"))
    sizes = ranked.groupBy("group").agg(F.count("*").alias("n"), F.avg("mean").alias("estimate"))
    draws = sizes.select("group", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).select("group", "n", "b", F.explode(F.expr("sequence(0, cast(n as int) - 1)")).alias("k"))
    spot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "group", "b", "k")), 1, 12), 16, 10).cast("long") % F.col("n")
    resampled = draws.withColumn("i", spot).join(ranked, ["group", "i"]).groupBy("group", "b").agg(F.avg("mean").alias("m"))
    bounds = resampled.groupBy("group").agg(F.percentile("m", F.lit(levels[0])).alias("low"), F.percentile("m", F.lit(levels[1])).alias("high"))
    return sizes.join(bounds, "group").select("group", "n", "estimate", "low", "high")
