"""Stratified selection and sampling (group F, E1-E3, E10, E14).

Random draws are replaced by a seeded hash order, so a selection is the same on
any cluster. Ranks inside strata are windows over the stratum; where only the
first rows of a stratum matter the filter on the rank lets Spark keep a running
top-k instead of the whole stratum (``WindowGroupLimit``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_fraction, seeded, seeded_order

Order = Sequence[Column | str]


def top_per_group(df: DataFrame, groups: Sequence[str], order: Order, n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def round_robin(df: DataFrame, stratum: str, order: Order, n: int, *, by_size: bool = True) -> DataFrame:
    """One row of each stratum in turn until n, larger strata first (or by name).

    No stratum can give more than n rows, so only those are ranked against each other.
    """
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_size"))
    ranked = top_ranked(df, [stratum], order, n)
    joined = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    turn = [F.col("_rank"), F.col("_size").desc(), F.col(stratum)] if by_size else [F.col("_rank"), F.col(stratum)]
    return joined.orderBy(*turn).limit(n).drop("_rank", "_s", "_size")


def top_ranked(df: DataFrame, groups: Sequence[str], order: Order, n: int, name: str = "_rank") -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def nested_round_robin(df: DataFrame, kind: str, subtype: str, text: str, key: str, n: int, seed: int) -> DataFrame:
    """kinds in turn; inside a kind its subtypes in turn; inside those distinct texts before repeats; all by seeded hash."""
    h = lambda c: seeded_order(seed, c)
    a = df.withColumn("_n1", F.row_number().over(Window.partitionBy(kind, subtype, text).orderBy(h(key))))
    a = a.withColumn("_n2", F.row_number().over(Window.partitionBy(kind, subtype).orderBy("_n1", h(text))))
    a = a.withColumn("_n3", F.row_number().over(Window.partitionBy(kind).orderBy("_n2", h(subtype))))
    return a.filter(F.col("_n3") <= n).orderBy("_n3", kind).limit(n).drop("_n1", "_n2", "_n3")


def capped_rounds(df: DataFrame, key: str, rounds: Sequence[tuple[Column, str, int]], order: Column, size: int, checkpoint=None) -> DataFrame:
    """rounds of (predicate, stratum, cap per value), each over rows not picked before; then a fill to ``size``.

    ``round`` tells which round picked a row; the fill is round 0.
    """
    checkpoint = checkpoint or (lambda x: x)
    picked, rest = None, df
    for i, (predicate, stratum, cap) in enumerate(rounds, 1):
        chosen = checkpoint(top_per_group(rest.filter(predicate & F.col(stratum).isNotNull()), [stratum], [order], cap).withColumn("round", F.lit(i)))
        picked = chosen if picked is None else picked.unionByName(chosen)
        rest = rest.join(chosen.select(key), key, "left_anti")
    if picked is None:
        picked = df.limit(0).withColumn("round", F.lit(0))
    ranked = picked.select("*", F.col("round").alias("_part")).unionByName(rest.withColumns({"round": F.lit(0), "_part": F.lit(len(rounds) + 1)}))
    return ranked.orderBy("_part", order).limit(size).drop("_part")


def proportional(df: DataFrame, stratum: str, order: Order, n: int) -> DataFrame:
    """floor shares of n; what is short goes to the largest strata first, as far as they have rows."""
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    shares = sizes.join(F.broadcast(total)).withColumn("_n", F.least(F.lit(n), F.col("_total"))).withColumn("_floor", F.expr("_n * _size div _total"))
    by_size = Window.orderBy(F.desc("_size"), "_s").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stratum
    shares = shares.withColumn("_short", F.col("_n") - F.sum("_floor").over(Window.partitionBy()))
    shares = shares.withColumn("_before", F.coalesce(F.sum(F.col("_size") - F.col("_floor")).over(by_size), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("_size") - F.col("_floor"), F.col("_short") - F.col("_before")))
    quota = shares.select("_s", (F.col("_floor") + extra).alias("_quota"))
    ranked = top_ranked(df, [stratum], order, n)
    return ranked.join(F.broadcast(quota), F.col(stratum).eqNullSafe(F.col("_s"))).filter("_rank <= _quota").drop("_s", "_quota", "_rank")


def by_quota(df: DataFrame, quotas: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """as many rows of each cell as the quota table says (``quota`` column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.join(quotas, list(keys)).withColumn("_r", F.row_number().over(w)).filter("_r <= quota").drop("_r", "quota")


def quota_shortfall(df: DataFrame, quotas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F13, fail-closed part: cells that hold fewer rows than their quota."""
    have = df.groupBy(*keys).agg(F.count("*").alias("have"))
    return quotas.join(have, list(keys), "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < quota")


def reservoir(df: DataFrame, pool: str, key: str, k: int, seed: int) -> DataFrame:
    """K rows of each pool, each subset as likely; by hash instead of in order of arrival."""
    return top_per_group(df, [pool], [seeded_order(seed, key), key], k)


def cyclic_successor(df: DataFrame, category: str, order: str, out: str = "successor") -> DataFrame:
    """The next key of a row's category, the first after the last."""
    w = Window.partitionBy(category).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.lead(order).over(w), F.first(order).over(whole)))


def mixture_draws(draws: DataFrame, draw: str, weights: dict[str, float], seed: int, out: str) -> DataFrame:
    """a name for each draw by weight, from a hash fraction against cumulative shares."""
    total, edge, choice = sum(weights.values()), 0.0, None
    u = hash_fraction(seeded(seed, draw))
    for name, w in weights.items():
        edge += w / total
        choice = F.when(u < edge, name) if choice is None else choice.when(u < edge, name)
    return draws.withColumn(out, choice.otherwise(list(weights)[-1]))


def two_stage_draws(draws: DataFrame, draw: str, members: DataFrame, group: str, member: str, seed: int) -> DataFrame:
    """each draw takes a group uniformly, then one of its members uniformly, so large groups weigh no more."""
    groups = members.groupBy(group).agg(F.count("*").alias("_m"))
    ranked = groups.withColumn("_g", F.row_number().over(Window.orderBy(group)) - 1)  # one row per group
    n = groups.agg(F.count("*").alias("_n"))
    spot = lambda tag: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:{tag}:"), F.col(draw).cast("string")), 256), 1, 12), 16, 10).cast("long")
    d = draws.join(F.broadcast(n)).withColumn("_g", spot("group") % F.col("_n")).drop("_n").join(ranked, "_g")
    d = d.withColumn("_i", spot("member") % F.col("_m"))
    inside = members.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(member)) - 1)
    return d.join(inside, [group, "_i"]).select(draw, group, member)


def task_views(df: DataFrame, views: Sequence[tuple[str, str, int]]) -> DataFrame:
    """one row for each (name, task, variant)."""
    rows = F.array(*[F.struct(F.lit(n).alias("view"), F.lit(t).alias("task"), F.lit(v).alias("variant")) for n, t, v in views])
    return df.withColumn("_v", F.explode(rows)).select(*df.columns, "_v.*")


def length_batches(df: DataFrame, length: Column | str, order: str, per_batch: int) -> DataFrame:
    """rows of like length (power-of-two buckets) in batches."""
    length = F.col(length) if isinstance(length, str) else length
    out = df.withColumn("bucket", F.ceil(F.log2(F.greatest(length, F.lit(1)))).cast("int"))
    return out.withColumn("batch", F.expr(f"(row_number() over (partition by bucket order by {order}) - 1) div {per_batch}"))


def capped_round_robin(df: DataFrame, stratum: str, project: str, key: str, n: int, cap: int, strata: Sequence[str]) -> DataFrame:
    """Strata in a fixed order take turns; a row counts only while its project is below its cap.

    What one stratum takes decides what the next may take, so the last step is
    sequential. It runs on a pool of ``2 * n`` rows a stratum at most: no
    project can give a stratum more than ``cap`` rows, and of a stratum's rows in
    order at most n are taken and at most n passed over, as at most ``n / cap``
    projects reach their cap.
    """
    import pandas as pd

    order = list(strata)
    pool = top_per_group(df.filter(F.col(stratum).isin(*order)).select(stratum, project, key), [stratum, project], [key], cap)
    pool = top_per_group(pool, [stratum], [key], 2 * n)

    def turns(rows: pd.DataFrame) -> pd.DataFrame:
        queues = {s: list(g.sort_values(key)[[project, key]].itertuples(index=False, name=None)) for s, g in rows.groupby(stratum)}
        at, used, out = dict.fromkeys(queues, 0), {}, []
        moved = True
        while moved and len(out) < n:
            moved = False
            for s in order:
                queue = queues.get(s, [])
                while at.get(s, 0) < len(queue) and len(out) < n:
                    p, k = queue[at[s]]
                    at[s] += 1
                    if used.get(p, 0) < cap:
                        used[p] = used.get(p, 0) + 1
                        out.append((s, p, k))
                        moved = True
                        break
        return pd.DataFrame(out, columns=[stratum, project, key])

    return pool.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(lambda r: turns(r), pool.schema)


def cap_after_union(picks: Sequence[DataFrame], key: str, project: str, cap: int, size: int, seed: int) -> DataFrame:
    """Rows that any round picked, each once; then at most ``cap`` of a project and ``size`` in all, by seeded hash."""
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    order = seeded_order(seed, key)
    return top_per_group(out.dropDuplicates([key]), [project], [order, F.col(key)], cap).orderBy(order, key).limit(size)
