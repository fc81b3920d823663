"""Joins of the curation workload (group C, P1, P8, P12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import last_wins


def override_join(base: DataFrame, over: DataFrame, key: str, value: str, order: str, fallback: Column | str, out: str) -> DataFrame:
    """The last override of each key, else the fallback; ``hit`` tells which."""
    fallback = F.col(fallback) if isinstance(fallback, str) else fallback
    picked = last_wins(over.select(key, F.col(value).alias("_value"), F.col(order).alias("_order")), [key], ["_order"]).select(F.col(key).alias("_key"), "_value")
    joined = base.join(picked, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({"hit": F.col("_key").isNotNull(), out: F.coalesce("_value", fallback)}).drop("_key", "_value")


def two_key_lookup(left: DataFrame, right: DataFrame, keys: tuple[str, str], right_keys: tuple[str, str], value: str, out: str) -> DataFrame:
    """C4, C17: the value by the first key, else by the second; misses stay null."""
    a = right.select(F.col(right_keys[0]).alias("_a"), F.col(value).alias("_va"))
    b = right.select(F.col(right_keys[1]).alias("_b"), F.col(value).alias("_vb"))
    joined = left.join(a, F.col(keys[0]) == F.col("_a"), "left").join(b, F.col(keys[1]) == F.col("_b"), "left")
    return joined.withColumn(out, F.coalesce("_va", "_vb")).drop("_a", "_b", "_va", "_vb")


def pending(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records that are not done yet."""
    return records.join(done.select(key).distinct(), key, "left_anti")


def exclusion_reasons(df: DataFrame, checks: Sequence[tuple[str, Column | tuple[str, DataFrame]]], out: str = "reason") -> DataFrame:
    """The first check that applies names the reason, ``keep`` if none does.

    A check is a predicate, or a pair of a column and a one-column table of excluded keys.
    """
    reason, drop = None, []
    for i, (name, check) in enumerate(checks):
        if isinstance(check, tuple):
            column, keys = check
            mark = f"_x{i}"
            keys = keys.select(F.col(keys.columns[0]).alias(f"{mark}k")).distinct().withColumn(mark, F.lit(True))
            df = df.join(keys, F.col(column) == F.col(f"{mark}k"), "left")
            drop += [mark, f"{mark}k"]
            check = F.col(mark)
        check = F.coalesce(check, F.lit(False))
        reason = F.when(check, name) if reason is None else reason.when(check, name)
    return df.withColumn(out, (reason.otherwise("keep") if reason is not None else F.lit("keep"))).drop(*drop)


def collect_paths(index: DataFrame, keys: Sequence[str], path: str, out: str = "paths") -> DataFrame:
    """C11: all paths of a composite key, sorted."""
    return index.groupBy(*keys).agg(F.array_sort(F.collect_set(path)).alias(out))


def mismatch_counts(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows that differ per column, null-safe, and keys of one side only; one row."""
    a = left.select(F.col(key).alias("_ka"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = right.select(F.col(key).alias("_kb"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = a.join(b, F.col("_ka") == F.col("_kb"), "full_outer")
    matched = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    return both.agg(
        F.count_if(matched).alias("matched"),
        F.count_if(F.col("_kb").isNull()).alias("left_only"),
        F.count_if(F.col("_ka").isNull()).alias("right_only"),
        *[F.count_if(matched & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(f"differ_{c}") for c in columns],
    )


def paired_difference(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """After minus before on equal key sets; a key of one side only is an error when the rows are read."""
    b = before.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col(value).alias("_b"))
    a = after.select(*[F.col(k) for k in keys], F.col(value).alias("_a"))
    on = None
    for k in keys:
        on = (F.col(k) == F.col(f"_b_{k}")) if on is None else on & (F.col(k) == F.col(f"_b_{k}"))
    joined = a.join(b, on, "full_outer")
    odd = F.col(keys[0]).isNull() | F.col(f"_b_{keys[0]}").isNull()
    return joined.select(*keys, F.when(odd, F.raise_error(F.lit("arms hold different keys"))).otherwise(F.col("_a") - F.col("_b")).cast("double").alias("difference"))


def prefer_sources(tables: Mapping[str, DataFrame], key: str, name: str = "chosen_from") -> DataFrame:
    """One row per key from the first table that holds it; tables come in order of preference."""
    parts = [df.withColumns({name: F.lit(t), "_rank": F.lit(i)}) for i, (t, df) in enumerate(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    row = F.struct(*[c for c in out.columns if c != "_rank"])
    return out.groupBy(F.col(key).alias("_k")).agg(F.min_by(row, "_rank").alias("_row")).select("_row.*")
