"""Checks and unions around catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.keys import hash_fraction, seeded
from .select import round_robin


def import_manifest(manifest: DataFrame, required: Sequence[str], grid: str, height: str, width: str) -> tuple[DataFrame, DataFrame]:
    """``(records, violations)``: records get their grid's hash and alpha class; rows without a required value are refused."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    rows = manifest.withColumn("_missing", missing)
    good = rows.filter(F.size("_missing") == 0).drop("_missing")
    good = good.withColumns({"target_hash": pixels.grid_hash(grid, height, width), "alpha": pixels.alpha_class(grid)})
    return good, rows.filter(F.size("_missing") > 0).select(F.explode("_missing").alias("missing"), *manifest.columns)


def positional_join(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Tables aligned by an explicit index; a row of one side only is an error when it is read."""
    r = right.select(F.col(index).alias("_index"), *[c for c in right.columns if c != index])
    both = left.join(r, F.col(index) == F.col("_index"), "full_outer")
    odd = F.col(index).isNull() | F.col("_index").isNull()
    return both.withColumn(index, F.when(odd, F.raise_error(F.lit("tables are not aligned"))).otherwise(F.col(index))).drop("_index")


def weighted_take(df: DataFrame, key: str, weight: Column, seed: int) -> DataFrame:
    """each row stays with its weight as probability, by hash."""
    return df.filter(hash_fraction(seeded(seed, key)) < weight)


def chunks(df: DataFrame, partition: Sequence[str], order: str, size: int) -> DataFrame:
    """numbers chunks of ``size`` rows inside each partition."""
    part = ", ".join(partition)
    return df.withColumn("chunk", F.expr(f"(row_number() over (partition by {part} order by {order}) - 1) div {size}"))


def selection_violations(selection: DataFrame, rows: DataFrame, index: str, split: str, identity: str) -> DataFrame:
    """I16: ``(rule, n)``: repeated or unknown indices, identities that differ, test rows, and an empty train or val part."""
    s = selection.select(F.col(index).alias("_i"), F.col(identity).alias("_id"))
    j = s.join(rows.select(index, split, F.col(identity).alias("_known")), F.col("_i") == F.col(index), "left")
    n = j.agg(
        (F.count("*") - F.count_distinct("_i")).alias("repeated"),
        F.count_if(F.col(index).isNull()).alias("unknown"),
        F.count_if(F.col(index).isNotNull() & ~F.col("_id").eqNullSafe(F.col("_known"))).alias("identity"),
        F.count_if(F.col(split) == "test").alias("test_rows"),
        (F.count_if(F.col(split) == "train") == 0).cast("long").alias("no_train"),
        (F.count_if(F.col(split) == "val") == 0).cast("long").alias("no_val"),
    )
    rules = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in n.columns])
    return n.select(F.explode(rules).alias("x")).select("x.*").filter("n > 0")


def augmentation_collisions(df: DataFrame, split: str, variants: Column, exposed: DataFrame) -> DataFrame:
    """Hashes of transformed contents that reach two splits or an exposed set, with the reason."""
    e = exposed.select(F.col(exposed.columns[0]).alias("_e")).distinct()
    hashes = df.select(split, F.explode(variants).alias("hash")).groupBy("hash").agg(F.count_distinct(split).alias("_n"))
    j = hashes.join(e, F.col("hash") == F.col("_e"), "left")
    return j.filter((F.col("_n") > 1) | F.col("_e").isNotNull()).select("hash", F.when(F.col("_n") > 1, "crosses_splits").otherwise("exposed").alias("reason"))


def sha256_mod(text: Column, modulus: int) -> Column:
    """The SHA-256 of a text, read as a 256-bit number, modulo at most 2**15: twelve hex digits after another."""
    digest, rest = F.sha2(text, 256), F.lit(0).cast("long")
    for at in range(0, 64, 12):
        n = min(12, 64 - at)
        rest = (rest * (1 << 4 * n) + F.conv(F.substring(digest, at + 1, n), 16, 10).cast("long")) % modulus
    return rest


#: Fixed values of the hashed embedding: places of its projection, weights, scale.
PLACES, WEIGHTS, SCALE = 8 * 768, (1.0, 0.5), 0.1


def hashed_embedding(grams: Column, dimensions: int) -> Column:
    """Each token of a list adds to two of ``dimensions`` places that its SHA-256 chooses; over the root of the list's length, scaled.

    The first place is the hash's among ``PLACES``, the second seven times that
    plus the hash, both modulo ``dimensions``.
    """
    first = F.transform(grams, lambda g: sha256_mod(g, PLACES))
    places = F.transform(F.arrays_zip(first.alias("at"), F.transform(grams, lambda g: sha256_mod(g, dimensions)).alias("own")), lambda z: F.struct((z["at"] % dimensions).alias("one"), ((z["at"] * 7 + z["own"]) % dimensions).alias("two")))
    norm = SCALE / F.sqrt(F.greatest(F.size(grams), F.lit(1)) + F.lit(1e-6))
    count = lambda p, field, d: F.size(F.filter(p, lambda z: z[field] == d))
    return F.transform(F.array(places), lambda p: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: (WEIGHTS[0] * count(p, "one", d) + WEIGHTS[1] * count(p, "two", d)) * norm))[0]


def fresh_evaluation(df: DataFrame, split: str, content: str, monitored: DataFrame, category: str, order: str, n_val: int) -> DataFrame:
    """All test rows and a round-robin of val rows, one per content, none of them monitored."""
    seen = monitored.select(F.col(monitored.columns[0]).alias(content)).distinct()
    row = F.struct(*df.columns)
    once = df.groupBy(F.col(content).alias("_c"), F.col(split).alias("_s")).agg(F.min_by(row, order).alias("_row")).select("_row.*")
    fresh = once.join(seen, content, "left_anti")
    return fresh.filter(F.col(split) == "test").unionByName(round_robin(fresh.filter(F.col(split) == "val"), category, [order], n_val).select(*df.columns))


def first_of_each_and_products(df: DataFrame, category: str, order: str, extra: DataFrame) -> DataFrame:
    """The first row of each category, once for each row of a small table of settings."""
    w = Window.partitionBy(category).orderBy(order)
    first = df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    settings = extra.agg(F.collect_list(F.struct("*")).alias("_all"))  # a handful of settings
    return first.join(F.broadcast(settings)).withColumn("_s", F.explode("_all")).select(*df.columns, "_s.*")


def migrate(primary: DataFrame, legacy: DataFrame, key: str, text: str, fallback: Column, reject: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejected counts)``: legacy rows the primary lacks, text filled in, the first reason that applies rejects."""
    reason = None
    for name, check in reject:
        reason = F.when(check, name) if reason is None else reason.when(check, name)
    old = legacy.join(primary.select(key), key, "left_anti").withColumn(text, F.coalesce(text, fallback)).withColumn("_reason", reason if reason is not None else F.lit(None).cast("string"))
    counts = old.filter("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))
    return primary.unionByName(old.filter("_reason is null").drop("_reason"), allowMissingColumns=True), counts
