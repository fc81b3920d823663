"""Vectors and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import col


def mean_abs_difference(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def unit(v: Column | str, floor: float = 1e-12) -> Column:
    """The vector over its length, which counts as ``floor`` at least."""
    length = F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(F.array(F.greatest(length, F.lit(floor))), lambda n: F.transform(col(v), lambda x: x.cast("double") / n))[0]


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: A block of queries is broadcast; its size is this many vectors, whatever the table.
QUERY_BLOCK = 256


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of least mean absolute difference for each query, ties by key.

    A stated query set against all rows, in blocks of ``block`` queries at most:
    each block is held against every row of the table, and each task keeps its
    own k best of a query before anything is shuffled. Rows are read once for
    each block; the driver holds one block at a time.
    """
    import heapq

    import numpy as np
    import pyarrow as pa

    q = queries.select(F.col(key).cast("long").alias("query"), F.col(vector).alias("v"))
    n = max(1, -(-q.count() // block))
    dealt = q.withColumn("b", F.pmod(F.xxhash64("query"), F.lit(n))).groupBy("b").agg(F.collect_list(F.struct("query", "v")).alias("qs"))
    # about one block each; what is over is cut off into further ones
    blocks = dealt.select(F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"(size(qs) - 1) div {block}")), lambda i: F.slice("qs", i * block + 1, block))).alias("qs"))
    table = rows.select(F.col(key).cast("long").alias("row"), F.col(vector).alias("v"))
    out = None
    schema = "query long, row long, distance double"
    for b in blocks.toLocalIterator():  # one block at a time, none larger than its bound
        ids = np.array([x["query"] for x in b["qs"]])
        vs = np.array([x["v"] for x in b["qs"]], np.float64)

        def scan(batches, ids=ids, vs=vs):
            best = [[] for _ in ids]
            for batch in batches:
                keys = batch["row"].to_numpy()
                values = np.array(batch["v"].to_pylist(), np.float64)
                for at in range(0, len(keys), 512):
                    d = np.abs(values[at : at + 512, None, :] - vs[None]).mean(axis=2)
                    for j in range(len(ids)):
                        for i in np.argsort(d[:, j], kind="stable")[: k + 1]:
                            item = (-d[i, j], -int(keys[at + i]))
                            if len(best[j]) < k:
                                heapq.heappush(best[j], item)
                            elif item > best[j][0]:
                                heapq.heapreplace(best[j], item)
            got = [(int(q), -r, -d) for q, found in zip(ids, best, strict=True) for d, r in found]
            columns = list(zip(*got, strict=True)) if got else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query", "row", "distance"])

        part = table.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], schema)
    from .select import top_per_group

    return top_per_group(out, ["query"], ["distance", "row"], k)


def mean_pair_gap(df: DataFrame, groups: list[str], value: str, *, blocks: int = 256) -> DataFrame:
    """``groups, pairs, gap``: the mean difference over all pairs of rows of a group, without making any pair.

    In ascending order a value exceeds each of the ``n`` values before it, so it
    adds ``n * value - their sum``. Equal values are counted first; a group is
    cut into blocks by value, so that no task needs all of it; totals of blocks
    (``blocks`` rows a group at most) carry on from one to the next.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    span = counts.groupBy(*groups).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    place = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (blocks - 1))).otherwise(0)
    placed = counts.join(span, groups).withColumn("_block", place)
    # the group's low is taken off, which leaves the gaps and keeps the sums small
    placed = placed.select(*groups, "_block", "_c", (F.col("_v") - F.col("_low")).alias("_v"))
    earlier = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*groups, "_block").agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_v")).alias("_s"))
    before = sums.select(*groups, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s"))
    inside = Window.partitionBy(*groups, "_block").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("_n") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    s = F.col("_s") + F.coalesce(F.sum(F.col("_c") * F.col("_v")).over(inside), F.lit(0.0))
    added = placed.join(before, [*groups, "_block"]).select(*groups, "_c", (F.col("_c") * (F.col("_v") * n - s)).alias("_added"))
    out = added.groupBy(*groups).agg(F.sum("_c").alias("_all"), F.sum("_added").alias("_sum"))
    pairs = F.expr("_all * (_all - 1) div 2")
    return out.select(*groups, pairs.alias("pairs"), F.try_divide("_sum", pairs.cast("double")).alias("gap"))


def circular_mean(df: DataFrame, group: str, hue: str, weight: str) -> DataFrame:
    """Weighted mean direction in degrees and its concentration, 0 to 1."""
    sums = df.groupBy(group).agg(F.sum(F.col(weight) * F.cos(F.radians(hue))).alias("_x"), F.sum(F.col(weight) * F.sin(F.radians(hue))).alias("_y"), F.sum(weight).alias("_w"))
    return sums.select(group, F.pmod(F.degrees(F.atan2("_y", "_x")), F.lit(360.0)).alias("mean"), F.try_divide(F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")), F.col("_w")).alias("concentration"))


def circular_distance(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def histogram_cosine(a: DataFrame, b: DataFrame, bucket: str) -> DataFrame:
    """Cosine of two tables' bucket counts; one row."""
    x = a.groupBy(F.col(bucket).alias("k")).agg(F.count("*").cast("double").alias("x"))
    y = b.groupBy(F.col(bucket).alias("k2")).agg(F.count("*").cast("double").alias("y"))
    j = x.join(y, F.col("k").eqNullSafe(F.col("k2")), "full_outer").na.fill(0.0, ["x", "y"])
    return j.agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("cosine"))


def sign_hash(v: Column | str) -> Column:
    """A perceptual hash of up to 64 bits: which entries lie above the mean."""
    values = col(v)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)
    bits = F.transform(F.array(mean), lambda m: F.aggregate(F.slice(values, 1, 64), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x.cast("double") > m, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))))
    return bits[0]


def hamming(a: Column, b: Column) -> Column:
    """L16, I11."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_retrieval(queries: DataFrame, rows: DataFrame, key: str, code: str, block: int = QUERY_BLOCK) -> DataFrame:
    """``query, row, distance``: the row whose 64-bit hash differs in the fewest bits, ties by key.

    A stated query set against all rows, in blocks: rows are joined with blocks
    of ``block`` queries at most, and the least of each query is an aggregate, so
    tasks send one row for each query they have seen.
    """
    q = queries.select(F.col(key).cast("long").alias("query"), F.col(code).alias("_q"))
    n = max(1, -(-q.count() // block))
    dealt = q.groupBy(F.pmod(F.xxhash64("query"), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct("query", "_q")).alias("_qs"))
    blocks = dealt.select(F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"(size(_qs) - 1) div {block}")), lambda i: F.slice("_qs", i * block + 1, block))).alias("_qs"))
    out = None
    table = rows.select(F.col(key).cast("long").alias("row"), F.col(code).alias("_r"))
    for b in blocks.toLocalIterator():
        held = F.array(*[F.struct(F.lit(x["query"]).alias("query"), F.lit(x["_q"]).alias("_q")) for x in b["_qs"]])
        pairs = table.select("row", "_r", F.explode(held).alias("x")).select(F.col("x.query").alias("query"), F.struct(hamming(F.col("_r"), F.col("x._q")).alias("distance"), "row").alias("found"))
        best = pairs.groupBy("query").agg(F.min("found").alias("found")).select("query", "found.row", "found.distance")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return table.sparkSession.createDataFrame([], "query long, row long, distance int")
    return out
