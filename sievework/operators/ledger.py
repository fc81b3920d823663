"""A review ledger as append-only events (K1-K6).

Events have a revision, a pair, the state, whether it is selected for training,
reason and note, and whether the event is an undo mark. The state of a pair is
its latest event that no later undo took back. One writer appends; it compares
the revision it has seen with the greatest stored one before it writes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("pending", "keep", "reject", "unsure")


#: Revisions are numbered in blocks of this many; sums run inside a block, and over one row per block.
BLOCK = 1 << 16


def live_events(events: DataFrame) -> DataFrame:
    """K3: events that count. An undo takes back the last event not yet taken back, like closing brackets.

    Height is events minus undos so far; an event is taken back by the first
    later undo that returns to the height below it: the next mark on its level.
    """
    per = events.groupBy("revision").agg(F.max("undo").alias("undo"))
    per = per.withColumns({"step": F.when(F.col("undo"), -1).otherwise(1), "block": F.expr(f"revision div {BLOCK}")})
    sums = per.groupBy("block").agg(F.sum("step").alias("rise"))
    below = sums.select("block", F.coalesce(F.sum("rise").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inside = Window.partitionBy("block").orderBy("revision").rowsBetween(Window.unboundedPreceding, 0)
    heights = per.join(below, "block").withColumn("height", F.col("below") + F.sum("step").over(inside))
    marked = heights.select("revision", "undo", "block", (F.col("height") + F.col("undo").cast("int")).alias("level"))
    on_level = Window.partitionBy("level", "block").orderBy("revision")
    later = Window.partitionBy("level").orderBy("block")
    next_block = marked.groupBy("level", "block").agg(F.min_by("undo", "revision").alias("first")).select("level", "block", F.lead("first").over(later).alias("next_block"))
    told = marked.withColumn("next", F.lead("undo").over(on_level)).join(next_block, ["level", "block"])
    live = told.filter(~F.col("undo") & ~F.coalesce("next", "next_block", F.lit(False))).select("revision")
    return events.filter(~F.col("undo")).join(live, "revision", "left_semi")


def current(events: DataFrame) -> DataFrame:
    """K4: the latest live event of each pair."""
    live = live_events(events)
    row = F.struct(*[c for c in live.columns if c != "undo"])
    return live.groupBy("pair_id").agg(F.max_by(row, "revision").alias("_row")).select("_row.*")


def violations(batch: DataFrame, pairs: DataFrame, state: DataFrame, seen: int | None = None) -> DataFrame:
    """K1, K2, K6: ``(rule, pair_id)``; a batch with any is refused as a whole."""
    b = batch.select("pair_id", F.col("state").alias("new_state"), F.col("selected").alias("new_selected"))
    j = b.join(pairs.select("pair_id", "split"), "pair_id", "left").join(state.select("pair_id", F.col("state").alias("old_state")), "pair_id", "left")
    effective = F.coalesce("new_state", "old_state", F.lit("pending"))
    rules = F.array_compact(
        F.array(
            F.when(F.col("split").isNull(), "unknown_pair"),
            F.when(~effective.isin(*STATES), "unknown_state"),
            F.when(F.col("new_selected") & (effective != "keep"), "selected_but_not_kept"),
            F.when(F.col("new_selected") & (F.col("split") != "train"), "selected_outside_train"),
        )
    )
    out = j.select(F.explode(rules).alias("rule"), "pair_id")
    if seen is not None:
        latest = state.agg(F.coalesce(F.max("revision"), F.lit(0)).alias("r")).filter(F.col("r") != seen)
        out = out.unionByName(latest.select(F.lit("stale_revision").alias("rule"), F.lit(None).cast(out.schema["pair_id"].dataType).alias("pair_id")))
    return out


def next_revision(events: DataFrame) -> Column:
    """K2: the revision after the greatest one, as a scalar subquery."""
    return events.agg(F.coalesce(F.max("revision"), F.lit(0)) + 1).scalar()


def next_events(batch: DataFrame, state: DataFrame, revision: int | Column) -> DataFrame:
    """K1: the events a valid batch appends; a state other than keep clears the selection, a new state clears the reason, no-ops go."""
    old = state.select("pair_id", F.col("state").alias("_s"), F.col("selected").alias("_t"), F.col("reason").alias("_r"), F.col("note").alias("_n"))
    j = batch.join(old, "pair_id", "left")
    before = F.coalesce("_s", F.lit("pending"))
    after = F.coalesce("state", before)
    selected = F.coalesce("selected", "_t", F.lit(False)) & (after == "keep")
    reason = F.coalesce("reason", F.when(after == before, F.coalesce("_r", F.lit(""))).otherwise(""))
    note = F.coalesce("note", "_n", F.lit(""))
    same = (after == before) & (selected == F.coalesce("_t", F.lit(False))) & (reason == F.coalesce("_r", F.lit(""))) & (note == F.coalesce("_n", F.lit("")))
    return j.filter(~same).select((revision if isinstance(revision, Column) else F.lit(revision)).cast("long").alias("revision"), "pair_id", after.alias("state"), selected.alias("selected"), reason.alias("reason"), note.alias("note"), F.lit(False).alias("undo"))


def summary(pairs: DataFrame, state: DataFrame, states: Sequence[str] = STATES) -> DataFrame:
    """K4: pairs per split and state; unseen ones are pending."""
    j = pairs.join(state.select("pair_id", "state"), "pair_id", "left").withColumn("state", F.coalesce("state", F.lit("pending")))
    return j.groupBy("split").pivot("state", list(states)).agg(F.count(F.lit(1))).na.fill(0)


def export(pairs: DataFrame, state: DataFrame, *, approved_only: bool = False) -> DataFrame:
    """K5: selected training pairs, and validation pairs that are not rejected (or only kept ones)."""
    j = pairs.join(state.select("pair_id", "state", "selected"), "pair_id", "left").withColumn("state", F.coalesce("state", F.lit("pending")))
    train = (F.col("split") == "train") & (F.col("state") == "keep") & F.coalesce("selected", F.lit(False))
    val = (F.col("split") == "val") & ((F.col("state") == "keep") if approved_only else (F.col("state") != "reject"))
    return j.filter(train | val).select(*pairs.columns)
