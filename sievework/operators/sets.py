"""Set operations and unions (group G, P13)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_counts(left: DataFrame, right: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """For each key pair, how many distinct values both tables hold; one row per key."""
    a = left.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("v")) for k in keys])).alias("x")).select("x.*").distinct()
    b = right.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(r).cast("string").alias("v")) for k, r in keys.items()])).alias("x")).select("x.*").distinct()
    both = a.join(b, ["kind", "v"], "left_semi").groupBy("kind").agg(F.count("*").alias("n"))
    kinds = left.sparkSession.createDataFrame([(k,) for k in keys], "kind string")
    return kinds.join(both, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("shared"))


def numbered(df: DataFrame, within: str, order: str, name: str = "place", buckets: int | None = None) -> DataFrame:
    """The place of each row inside ``within`` by a numeric order, from 0, without a task that sees a whole ``within``.

    Approximate quantiles of the order cut it into buckets; a row's place is
    the number of rows in the buckets before plus its place in its own bucket.
    The counts are one row for each value of ``within`` and bucket.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    out = df.withColumn("_bucket", F.size(F.filter(edges, lambda c: c <= F.col(order))))
    counts = out.groupBy(F.col(within).alias("_w"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_w").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_w", "_b", before.alias("_before"))
    joined = out.join(offsets, F.col(within).eqNullSafe(F.col("_w")) & (F.col("_bucket") == F.col("_b")))
    own = F.row_number().over(Window.partitionBy(within, "_bucket").orderBy(order)) - 1
    return joined.withColumn(name, own + F.col("_before")).drop("_w", "_b", "_bucket", "_before")


def reindexed_union(tables: Mapping[str, DataFrame], order: str, name: str = "source_set") -> DataFrame:
    """G1: tables under one another, missing columns null, each row with its place in its own table."""
    out = None
    for t, df in tables.items():
        part = df.withColumn(name, F.lit(t))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return numbered(out, name, order)


def priority_keys(first: DataFrame, then: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``first``, then those only ``then`` has; ``part`` and ``key`` give the order."""
    a = first.select(F.col(key).alias("key")).distinct().withColumn("part", F.lit(0))
    b = then.select(F.col(key).alias("key")).distinct().join(a, "key", "left_anti").withColumn("part", F.lit(1))
    return a.unionByName(b)


def named_subsets(df: DataFrame, predicates: Mapping[str, F.Column]) -> DataFrame:
    """``(subset, row)`` memberships of all subsets from one scan; write with ``partitionBy('subset')``."""
    names = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]), lambda x: x.isNotNull())
    return df.withColumn("subset", F.explode(names))
