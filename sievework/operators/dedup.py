"""Exact deduplication, representatives, compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by an explicit order; null keys are a key too.

    Written as an aggregate, so copies are dropped before the shuffle and a hot
    key is reduced where it lies.
    """
    return _pick(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by an explicit order."""
    return _pick(df, keys, order, F.max_by)


def _pick(df, keys, order, by):
    row = F.struct(*[F.col(c) for c in df.columns])
    picked = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(by(row, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def compact(df: DataFrame, content: str, order: str) -> tuple[DataFrame, DataFrame]:
    """``(payloads, rows)``: each distinct content once, under its first row's key, and rows pointing there."""
    payloads = df.groupBy(content).agg(F.min(order).alias("payload_id"), F.count("*").alias("uses"))
    return payloads, df.join(payloads.drop("uses"), content)


def conflicts(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that more than one owner claims."""
    return df.groupBy(key).agg(F.count_distinct(owner).alias("owners"), F.count("*").alias("n")).filter("owners > 1")


def greedy_near_duplicates(df: DataFrame, group: str, key: str, vector: str, threshold: float) -> DataFrame:
    """Within each group rows are visited by key and kept unless near a *kept* one.

    Near is a mean absolute difference up to ``threshold``. Candidate groups are
    the caller's (bands, components); a group is one task's memory.
    """
    import numpy as np
    import pandas as pd

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        kept, owner = [], []
        for k, v in zip(rows["key"], rows["vector"], strict=True):
            v = np.asarray(v, np.float64)
            near = next((o for o, u in kept if np.abs(u - v).mean() <= threshold), None)
            owner.append(k if near is None else near)
            if near is None:
                kept.append((k, v))
        return pd.DataFrame({"key": rows["key"], "kept_by": owner})

    rows = df.select(F.col(group).alias("g"), F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    return rows.groupBy("g").applyInPandas(lambda r: greedy(r), "key long, kept_by long")


def greedy_over_all(df: DataFrame, key: str, vector: str, threshold: float, hash_col: str | None = None, bits: int = 4, block: int = 256) -> DataFrame:
    """``(key, kept_by)``; rows are visited by key and kept unless near a *kept* row of the whole table.

    Two rows with a hash are near when at most ``bits`` of its bits differ, two
    rows without one (or all, where no hash column is named) by a mean absolute
    difference up to ``threshold``. Rounds take the first undecided rows, a
    block at most, decide them on the driver, and hold every undecided row
    against those kept, so no row is compared with a removed one and no group
    is gathered. The number of rounds grows with the number of kept rows.
    """
    import numpy as np
    import pyarrow as pa

    from .storage import checkpointed

    def near(v, h, vs, hs, hashed):
        d = np.array([np.abs(u - v).mean() for u in vs]) <= threshold if h is None and len(vs) else np.zeros(len(vs), bool)
        if h is None:
            return d & ~hashed
        return hashed & (np.bitwise_count(hs ^ np.int64(h).view(np.uint64)) <= bits)

    def packed(kept):
        vs = np.array([v for _, v, _ in kept], np.float64)
        hs = np.array([h or 0 for _, _, h in kept], np.int64).view(np.uint64)
        return vs, hs, np.array([h is not None for _, _, h in kept], bool)

    given = F.col(hash_col).cast("long") if hash_col else F.lit(None).cast("long")
    rest = checkpointed(df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), given.alias("hash")))
    out = None
    while True:
        kept = []
        for r in rest.orderBy("key", "hash", "vector").limit(block).collect():  # a block at most
            v = np.array(r["vector"], np.float64)
            if not kept or not near(v, r["hash"], *packed(kept)).any():
                kept.append((r["key"], v, r["hash"]))
        if not kept:
            return rest.select("key", F.col("key").alias("kept_by")) if out is None else out

        def scan(batches, ids=[k for k, _, _ in kept], held=packed(kept)):
            for part in batches:
                owner = []
                for v, h in zip(part["vector"].to_pylist(), part["hash"].to_pylist(), strict=True):
                    at = np.flatnonzero(near(np.array(v, np.float64), h, *held))
                    owner.append(ids[at[0]] if len(at) else None)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("key", "vector", "hash")), pa.array(owner, pa.int64())], names=["key", "vector", "hash", "kept_by"])

        told = checkpointed(rest.mapInArrow(scan, "key long, vector array<double>, hash long, kept_by long"))
        done = told.filter("kept_by is not null").select("key", "kept_by")
        out = done if out is None else out.unionByName(done)
        rest = told.filter("kept_by is null").drop("kept_by")


def greedy_by_hash(df: DataFrame, key: str, code: str, bits: int = 4) -> DataFrame:
    """I11 for rows that have a 64-bit hash: ``(key, kept_by)``; rows are visited by key and kept unless a kept row's hash differs in at most ``bits`` bits.

    Candidates are complete: a 64-bit hash is cut into ``bits + 2`` bands, and
    two that differ in ``bits`` bits agree in two bands at least. The order of
    visits is then resolved over the links: in each round every row with no
    undecided or kept row before it among its neighbours is kept, and later
    neighbours of kept rows go. Rows of one hash are one node, decided alike.
    """
    from itertools import combinations

    from .storage import checkpointed

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(code).cast("long").alias("code")).filter("key is not null and code is not null")
    nodes = checkpointed(rows.groupBy("code").agg(F.min("key").alias("key")))
    n = bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    band = [F.shiftrightunsigned(F.col("code"), a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    pairs = [F.struct(F.lit(k).alias("kind"), band[i].alias("one"), band[j].alias("two")) for k, (i, j) in enumerate(combinations(range(n), 2))]
    banded = nodes.select("code", "key", F.explode(F.array(*pairs)).alias("band")).select("code", "key", "band.*")
    a, b = banded.alias("a"), banded.alias("b")
    same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.one") == F.col("b.one")) & (F.col("a.two") == F.col("b.two"))
    near = a.join(b, same & (F.col("a.key") < F.col("b.key")) & (F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code"))) <= bits))
    links = checkpointed(near.select(F.col("a.key").alias("first"), F.col("b.key").alias("second")).distinct())
    left, open_links, kept = nodes.select("key"), links, None
    while True:
        waiting = open_links.select(F.col("second").alias("key")).distinct()
        fresh = checkpointed(left.join(waiting, "key", "left_anti"))
        kept = fresh if kept is None else kept.unionByName(fresh)
        gone = open_links.join(fresh.withColumnRenamed("key", "first"), "first", "left_semi").select(F.col("second").alias("key")).distinct()
        told = checkpointed(fresh.unionByName(gone))
        left = checkpointed(left.join(told, "key", "left_anti"))
        if left.isEmpty():
            break
        open_links = open_links.join(told.withColumnRenamed("key", "first"), "first", "left_anti").join(told.withColumnRenamed("key", "second"), "second", "left_anti")
        open_links = checkpointed(open_links.select("first", "second"))
    # a row that goes is told the first of the kept rows that are near
    by = links.join(kept.withColumnRenamed("key", "first"), "first").groupBy(F.col("second").alias("key")).agg(F.min("first").alias("kept_by"))
    by_code = nodes.join(by, "key", "left").select("code", F.coalesce("kept_by", "key").alias("kept_by"))
    return rows.join(by_code, "code").select("key", "kept_by")


def consecutive(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """E4, row form: rows whose value differs from the row before."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_n")
