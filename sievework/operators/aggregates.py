"""Aggregations and reports (group D)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def funnel(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """B2: rows that survive each predicate after those before it; one scan, one row."""
    counts, so_far = [F.count("*").alias("rows")], F.lit(True)
    for name, p in predicates.items():
        so_far = so_far & F.coalesce(p, F.lit(False))
        counts.append(F.count_if(so_far).alias(name))
    return df.agg(*counts)


def group_share(df: DataFrame, project: str, content: str, ks: Sequence[int]) -> DataFrame:
    """The share of distinct contents that the k largest projects cover, a row for each k."""
    sizes = df.groupBy(project).agg(F.count_distinct(content).alias("_n"))
    w = Window.orderBy(F.desc("_n"), project)  # one row per project
    top = sizes.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(ks)).select(F.col(project).alias("_p"), "_r")
    total = df.agg(F.count_distinct(content).alias("_all"))
    # the best rank of each content, so that one pass serves all k
    best = df.join(F.broadcast(top), F.col(project) == F.col("_p")).groupBy(content).agg(F.min("_r").alias("_r"))
    covered = best.agg(*[F.count_if(F.col("_r") <= k).alias(f"_{k}") for k in ks]).join(total)
    return covered.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"_{k}") / F.col("_all")).alias("share")) for k in ks])).alias("x")).select("x.*")


def flag_counts(df: DataFrame, decision: str, flags: str) -> DataFrame:
    """Rows per decision and reason; a row counts for each of its reasons."""
    return df.select(decision, F.explode(flags).alias("reason")).groupBy(decision, "reason").agg(F.count("*").alias("n"))


def vocabulary_coverage(df: DataFrame, key: str, tokens: str, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per vocabulary its size, the words found and the rows hit."""
    words = [(name, w) for name, ws in vocabulary.items() for w in ws]
    v = df.sparkSession.createDataFrame(words, "vocabulary string, word string")
    hits = df.select(F.col(key).alias("_k"), F.explode(F.array_distinct(tokens)).alias("word")).join(F.broadcast(v), "word")
    found = hits.groupBy("vocabulary").agg(F.count_distinct("word").alias("covered"), F.count_distinct("_k").alias("rows"))
    sizes = v.groupBy("vocabulary").agg(F.count_distinct("word").alias("words"))
    return sizes.join(found, "vocabulary", "left").na.fill(0, ["covered", "rows"])


def top_values(df: DataFrame, dimensions: Sequence[str], n: int) -> DataFrame:
    """The n most frequent values of each dimension, ties by value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x")).select("x.*")
    counted = long.filter("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def two_level_mean(df: DataFrame, groups: Sequence[str], cluster: str, value: str) -> DataFrame:
    """The mean over rows and the mean of cluster means; nulls take no part."""
    inner = df.filter(F.col(value).isNotNull()).groupBy(*groups, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return inner.groupBy(*groups).agg(
        (F.sum("_s") / F.sum("_n")).alias("sample_mean"), F.avg(F.col("_s") / F.col("_n")).alias("cluster_mean"), F.sum("_n").alias("n"), F.count("*").alias("clusters")
    )


def marginal_means(df: DataFrame, dimensions: Sequence[str], value: str) -> DataFrame:
    """The overall mean and each dimension's, in one pass by grouping sets."""
    sets = [[], *[[F.col(d)] for d in dimensions]]
    out = df.groupingSets(sets, *dimensions).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions])
    name, level = F.lit("all"), F.lit(None).cast("string")
    for d in dimensions:
        name = F.when(F.col(f"_g_{d}") == 0, d).otherwise(name)
        level = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(level)
    return out.select(name.alias("dimension"), level.alias("level"), "mean", "n")


def review_counts(df: DataFrame, group: str, state: str, states: Sequence[str]) -> DataFrame:
    """A column for each state, zero where none."""
    return df.groupBy(group).pivot(state, list(states)).agg(F.count(F.lit(1))).na.fill(0)


def review_summary(df: DataFrame, group: str, rating: str, usable: str) -> DataFrame:
    """Rated rows, mean rating, usable share, and pending rows, which take no part in the means."""
    return df.groupBy(group).agg(
        F.count(rating).alias("n"), F.avg(rating).alias("mean"), F.avg(F.when(F.col(rating).isNotNull(), F.col(usable).cast("double"))).alias("usable_share"), F.count_if(F.col(rating).isNull()).alias("pending")
    )


def exposure(n_targets: Column, draws: Column, share: Column, batch: Column) -> tuple[Column, Column]:
    """Draws per target, and the steps that give each target as many draws."""
    return draws * share / n_targets, F.ceil(n_targets * draws / batch)


def guarded_ratio(hits: Column, of: Column) -> Column:
    """Zero where there is nothing to divide by."""
    return F.coalesce(F.try_divide(hits, of), F.lit(0.0))
