"""Mixing sources to target weights by Poisson replication.

A source of weight w should make up the share w of the mixture's characters.
Each of its documents is repeated ``rate`` times on average, where
``rate = total characters * w / characters of the source``. The number of
copies is a Poisson variable with that mean, found by inverting its
distribution function at a uniform number that the seed and the document's key
and text determine: the same on any cluster and in any order of rows. Copies
are then shuffled globally: dealt to partitions and sorted inside them by a
hash, so a copy's place is uniform over the whole result.

The distribution function is a short table for rates up to ``MOST_TABLED``.
Above that a document's number is found by a walk over the masses within twelve
standard deviations of the mean: nothing that is stored grows with the rate.

Where no weights are given, a source's weight is its characters to the power
``temperature`` over the sum of these.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import checkpointed

SEED = "mix-1"
TEMPERATURE = 0.5
#: Tables of sources up to this many rows, of 1.7 kB each at most, are broadcast; a larger one is joined by shuffling.
MOST_BROADCAST = 10_000
#: Rates up to this have their distribution function in a table of some 190 entries.
MOST_TABLED = 64
#: Rates up to this start their walk at zero, where the mass is exp(-rate); larger ones far below the mean.
FROM_ZERO = 700
SPREAD = 12
#: Copies are made in two steps, of this many at most in one.
BATCH = 1024


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, *, temperature: float = TEMPERATURE) -> DataFrame:
    """``(source_key, rate, steps)``: the mean number of copies and its distribution function, one row per source.

    With ``weights`` given, sources that they do not name get rate zero, and the
    weights of those present are scaled to sum to one. A source without any
    characters gets rate one: repeating it cannot change the mixture.
    """
    sizes = docs.groupBy(docs["source"].alias("source_key")).agg(F.sum(F.char_length(F.coalesce(docs["text"], F.lit("")))).cast("double").alias("chars"))
    if weights is None:
        power = F.sqrt("chars") if temperature == 0.5 else F.pow("chars", F.lit(float(temperature)))
        weight = F.when(F.col("chars") > 0, power).otherwise(0.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source_key") == F.lit(name), F.lit(float(w))).otherwise(weight)
    sizes = checkpointed(sizes.withColumn("weight", weight))
    sums = sizes.agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight"))).alias("weight")).first()
    chars, weight = float(sums.chars or 0), float(sums.weight or 0)
    rates = sizes.select(
        "source_key",
        F.when(F.col("chars") == 0, 1.0).otherwise(F.lit(chars) * F.col("weight") / (F.col("chars") * F.lit(weight)) if weight else F.lit(0.0)).alias("rate"),
    )
    # P(N <= k) for k = 0.. until the rest is below what the uniform number resolves
    tabled = F.col("rate") <= MOST_TABLED
    last = F.when(tabled, F.ceil(F.col("rate") + SPREAD * F.sqrt("rate") + 30).cast("int")).otherwise(1)
    start = F.struct((-F.col("rate")).alias("log"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("steps"))

    def add(a, k):
        log = a["log"] + F.ln("rate") - F.ln(k.cast("double"))
        total = a["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(a["steps"], F.array(total)).alias("steps"))

    steps = F.when(F.col("rate") <= 0, F.array(F.lit(1.0))).when(tabled, F.aggregate(F.sequence(F.lit(1), last), start, add, lambda a: a["steps"]))
    return rates.withColumn("steps", steps)


def copies_of(rate: Column, steps: Column, u: Column) -> Column:
    """How many values k have P(N <= k) <= u: the inverse of the distribution function."""
    low = F.when(rate <= FROM_ZERO, F.lit(0)).otherwise(F.floor(rate - SPREAD * F.sqrt(rate) - 30)).cast("long")
    high = F.ceil(rate + SPREAD * F.sqrt(rate) + 30).cast("long")
    k = low.cast("double")
    # the logarithm of k! by Stirling's series, exact to the last digit for k over 300
    factorial = k * F.ln(k) - k + 0.5 * F.ln(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * k * k * k)
    log = F.when(rate <= FROM_ZERO, -rate).otherwise(k * F.ln(rate) - rate - factorial)
    begin = F.struct(log.alias("log"), F.exp(log).alias("sum"), F.when(F.exp(log) <= u, low + 1).otherwise(F.lit(0).cast("long")).alias("n"))

    def walk(a, j):
        step = a["log"] + F.ln(rate) - F.ln(j.cast("double"))
        total = a["sum"] + F.exp(step)
        return F.struct(step.alias("log"), total.alias("sum"), F.when(total <= u, j + 1).otherwise(a["n"]).alias("n"))

    walked = F.aggregate(F.sequence(low + 1, high), begin, walk, lambda a: a["n"])
    return F.when(rate <= MOST_TABLED, F.size(F.filter(steps, lambda s: s <= u)).cast("long")).otherwise(walked)


def uniform(seed: str, *parts) -> F.Column:
    """A number in [0, 1) with 52 random bits, from an MD5 of the seed and the parts."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, *, temperature: float = TEMPERATURE, seed: str = SEED, shuffle: bool = True) -> DataFrame:
    """``rest`` (a struct of all columns of ``docs``, of whatever names), ``copy`` (from 1), ``copies``, ``rate``, ``shuffle_key``.

    Null sources form a source of their own; null texts count no characters. A
    document's copies follow from its doc_id and text, and their places from
    these and the number of the copy; so repeated rows have as many copies each,
    in the same places. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, weights, temperature=temperature)
    bounded = rates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    digest = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("rest"), docs["source"].alias("source"), docs["doc_id"].alias("doc_id"), digest.alias("digest"))
    joined = rows.join(F.broadcast(rates) if bounded else rates, F.col("source").eqNullSafe(F.col("source_key")))
    u = uniform(seed, F.col("doc_id"), F.col("digest"))
    counted = joined.withColumn("u", u).withColumn("copies", copies_of(F.col("rate"), F.col("steps"), F.col("u"))).filter("copies > 0")
    kept = ["rest", "doc_id", "digest", "copies", "rate"]
    batches = counted.select(*kept, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {BATCH}"))).alias("batch"))
    first = F.col("batch") * BATCH
    copies = batches.select(*kept, F.explode(F.sequence(first + 1, F.least(first + BATCH, F.col("copies")))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest"), F.col("copy").cast("string")))
    out = copies.select("rest", "copy", "copies", "rate", key.alias("shuffle_key"))
    if not shuffle:
        return out
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shuffle_key").sortWithinPartitions("shuffle_key")
