"""Leakage-free splits, quarantine and audits (group I, G4-G7, P2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ROLES, group_key, hash_bucket, hash_fraction, role_by_thresholds, seeded
from .graph import connected_components
from .storage import checkpointed


def group_split(df: DataFrame, keys: Sequence[str], row_key: str, *, seed: int = 0, fractions=(0.9, 0.05, 0.05), fallback: Sequence[str] = ()) -> DataFrame:
    """A role for each group by its hash; rows without keys fall back, at last to themselves.

    Adds ``group``, ``split`` and ``by_row`` (no key at all). One projection, no shuffle.
    """
    total = sum(fractions)
    bounds = (10_000 * fractions[0] / total, 10_000 * (fractions[0] + fractions[1]) / total)
    own = group_key(*keys)
    later = group_key(*fallback) if fallback else F.lit(None).cast("string")
    group = F.coalesce(own, later, F.concat(F.lit("__row__"), F.col(row_key).cast("string")))
    out = df.withColumns({"group": group, "by_row": own.isNull() & later.isNull()})
    return out.withColumn("split", role_by_thresholds(hash_bucket(seeded(seed, "group"), 10_000), bounds))


def transitive_split(df: DataFrame, lineage: str, content: str, *, seed: int = 0, fractions=(0.9, 0.05, 0.05)) -> DataFrame:
    """Rows linked by lineage or content share a role, over any number of links.

    The component is named by its smallest node, so the order of rows has no say.
    """
    lin, con = F.concat(F.lit("p:"), F.col(lineage).cast("string")), F.concat(F.lit("c:"), F.col(content).cast("string"))
    edges = df.select(lin.alias("a"), con.alias("b")).distinct()
    parts = connected_components(edges, checkpointed).select(F.col("node").alias("_node"), F.col("component").alias("split_group"))
    out = df.withColumn("_lin", lin).join(parts, F.col("_lin") == F.col("_node")).drop("_lin", "_node")
    return out.withColumn("split", role_by_thresholds(hash_fraction(seeded(seed, "split_group")), (fractions[0], fractions[0] + fractions[1])))


def component_roles(df: DataFrame, row_key: str, keys: Sequence[str], role: str) -> DataFrame:
    """I4: rows linked by any key form a component, which takes its greatest role (train < val < test); ``moved`` marks rows it changes."""
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col(role))
    node = F.concat(F.lit("r:"), F.col(row_key).cast("string"))
    tagged = F.explode(F.array(*[F.concat(F.lit(f"{i}:"), F.col(k).cast("string")) for i, k in enumerate(keys)]))
    parts = connected_components(df.select(node.alias("a"), tagged.alias("b")), checkpointed)
    out = df.withColumn("_n", node).join(parts, F.col("_n") == F.col("node")).drop("_n", "node")
    best = out.groupBy("component").agg(F.max(rank).alias("_best")).withColumnRenamed("component", "_c")
    out = out.join(best, F.col("component") == F.col("_c")).drop("_c")
    merged = F.get(F.array(*map(F.lit, ROLES)), (F.col("_best") - 1).cast("int"))
    return out.withColumn("merged_role", merged).withColumn("moved", F.col("merged_role") != F.col(role)).drop("_best")


def project_holdout(df: DataFrame, lineage: str, content: str, *, seed: int = 0, fractions=(0.8, 0.1, 0.1), assignments: Mapping[str, str] | None = None) -> DataFrame:
    """Projects are held out by hash or assignment; content that reaches several roles is quarantined, all copies of it."""
    role = role_by_thresholds(hash_fraction(seeded(seed, lineage, "project:")), (fractions[0], fractions[0] + fractions[1]))
    for project, given in (assignments or {}).items():
        role = F.when(F.col(lineage) == project, F.lit(given)).otherwise(role)
    out = df.withColumn("split", role)
    roles = out.groupBy(F.col(content).alias("_content")).agg((F.min("split") != F.max("split")).alias("quarantined"))
    return out.join(roles, F.col(content) == F.col("_content")).drop("_content")


def unknown_assignments(df: DataFrame, lineage: str, assignments: Mapping[str, str]) -> DataFrame:
    """I3, fail-closed part: assigned projects that the table does not hold."""
    rows = df.sparkSession.createDataFrame([(k,) for k in assignments] or [("",)], "project string").filter("project <> ''")
    return rows.join(df.select(F.col(lineage).alias("project")), "project", "left_anti")


def catalog_violations(df: DataFrame, row_key: str, split: str, owners: Sequence[str], *, kinds: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """``(rule, key, n)`` of every broken rule: repeated ids, unknown roles or types, missing keys, keys in two splits."""
    key = F.col(row_key).cast("string")
    rules = [
        df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("rule"), "key", "n"),
        df.filter(~F.coalesce(F.col(split).isin(*ROLES), F.lit(False))).groupBy(F.col(split).alias("key")).agg(F.count("*").alias("n")).select(F.lit("invalid_split").alias("rule"), "key", "n"),
    ]
    if kinds:
        name, known = kinds
        bad = df.filter(~F.coalesce(F.col(name).isin(*known), F.lit(False)))
        rules.append(bad.groupBy(F.col(name).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(f"invalid_{name}").alias("rule"), "key", "n"))
    # one pass for all owner keys
    owned = df.select(split, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in owners])).alias("o")).select(split, "o.*")
    missing = F.col("key").isNull() | (F.col("key") == "")
    rules.append(owned.filter(missing).groupBy("kind").agg(F.count("*").alias("n")).select(F.concat(F.lit("missing_"), "kind").alias("rule"), F.lit(None).cast("string").alias("key"), "n"))
    leaks = owned.filter(~missing).groupBy("kind", "key").agg(F.count_distinct(split).alias("n")).filter("n > 1")
    rules.append(leaks.select(F.concat(F.lit("leak_"), "kind").alias("rule"), "key", "n"))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def fail_closed(violations: DataFrame) -> None:
    """Raises if there is any violation, naming a few."""
    few = violations.limit(5).collect()
    if few:
        raise ValueError("violations: " + "; ".join(map(str, few)))


def asymmetric_leaks(df: DataFrame, content: str, split: str, order: str, *, losing: str = "val") -> DataFrame:
    """The first row owns a content; where another split reuses it, only rows of ``losing`` are dropped."""
    owner = df.groupBy(F.col(content).alias("_content")).agg(F.min_by(split, order).alias("owner"), F.count_distinct(split).alias("_n"))
    return df.join(owner, F.col(content) == F.col("_content")).withColumn("dropped", (F.col("_n") > 1) & (F.col(split) == losing)).drop("_content", "_n")


def disjoint_pairs(df: DataFrame, name: str, key: str) -> DataFrame:
    """How many keys each two names share; pairs that share none are absent."""
    names = df.select(F.col(key).alias("k"), F.col(name).alias("n")).distinct().groupBy("k").agg(F.array_sort(F.collect_set("n")).alias("ns")).filter("size(ns) > 1")
    pairs = names.select(F.explode(F.expr("flatten(transform(ns, (x, i) -> transform(slice(ns, i + 2, size(ns)), y -> struct(x as name_a, y as name_b))))")).alias("p"))
    return pairs.groupBy("p.name_a", "p.name_b").agg(F.count("*").alias("shared"))


def exact_cover(df: DataFrame, index: str, n: Column) -> DataFrame:
    """One row of counts that are all zero if ``index`` holds 0..n-1 once each."""
    return df.agg(
        (F.count("*") - F.count_distinct(index)).alias("repeated"),
        F.count_if((F.col(index) < 0) | (F.col(index) >= n)).alias("outside"),
        (F.max(n) - F.count_distinct(F.when((F.col(index) >= 0) & (F.col(index) < n), F.col(index)))).alias("missing"),
    )


def role_priority(df: DataFrame, keys: Sequence[str], role: str) -> DataFrame:
    """C17: the greatest role a key ever had, one row per (kind, key)."""
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col(role)).cast("int")
    owned = df.select(rank.alias("rank"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys])).alias("o"))
    return owned.groupBy("o.kind", "o.key").agg(F.max("rank").alias("rank"))


def rank_in(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
