"""Which derived rows a read sees: generations, times, overlays, and what is still to be derived.

    extraction   ext_id, rev_id, window_hash, generation, created_at, discarded_at, is_check
    generation   key, kind, activated_at
    overlay      id, conv_id, kind, target, value, created_at, removed_at
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_at(created: Column, gone: Column, at: Column) -> Column:
    """Known at a time: made by then, and not yet discarded then."""
    return (created <= at) & (gone.isNull() | (gone > at))


def as_of_many(requests: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Each request (by, at) with the rows of its key that were known at its time; an equi join carries the range test."""
    hit = rows.join(requests, by)
    return hit.filter(known_at(F.col("created_at"), F.col("discarded_at"), F.col("at")))


def chosen_generation(live: DataFrame, active: str, by: list[str]) -> DataFrame:
    """Rows of the one generation that serves their unit: the active one, else the most recently activated.

    live: columns by, generation, activated_at, optionally is_check (rows that never decide).
    """
    check = F.coalesce(F.col("is_check"), F.lit(False)) if "is_check" in live.columns else F.lit(False)
    order = Window.partitionBy(*by).orderBy(check, F.desc(F.col("generation") == active), F.desc("activated_at"), "generation").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return live.withColumn("chosen", F.first("generation").over(order)).filter(F.col("generation") == F.col("chosen"))


def window_join(head: DataFrame, extractions: DataFrame) -> DataFrame:
    """Extractions whose window is the head's: the turn's own hash, or a check made under it."""
    keys = head.withColumn("window_hash", F.explode(F.array("turn_hash", F.concat(F.lit("reveal:"), "turn_hash"))))
    return keys.join(extractions, ["rev_id", "window_hash"]).withColumn("is_check", F.col("window_hash") != F.col("turn_hash"))


def still_serving(old: DataFrame, units: DataFrame, by: list[str]) -> DataFrame:
    """Units that an older row still serves."""
    return units.join(old, by, "left_semi")


def to_derive(eligible: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Eligible rows that nothing was derived from yet."""
    return eligible.join(done, by, "left_anti")


def latest_per(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_before(new: DataFrame, old: DataFrame, by: list[str], time: str = "created_at") -> DataFrame:
    """Each new row with the latest old row of its key strictly before it.

    Both sides go through one window in order of time, so a key's rows are never paired with each other.
    """
    held = [c for c in old.columns if c not in by]
    a = old.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*held).alias("_old"), F.lit(None).cast(new.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_new"))
    b = new.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_old"].dataType).alias("_old"), F.struct("*").alias("_new"))
    # At one time new rows come first, so that they do not see an old row of the same time.
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    rows = a.unionByName(b).withColumn("previous", F.last("_old", ignorenulls=True).over(w)).filter("_side = 0")
    return rows.select("_new.*", "previous")


def current_members(windows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries whose members are exactly their window's: equal arrays, by their hash."""
    key = lambda c: F.sha2(F.to_json(c), 256)
    a = windows.select("conv_id", key(F.col("members")).alias("k"), "window")
    b = summaries.withColumn("k", key(F.col("members")))
    return b.join(a, ["conv_id", "k"]).drop("k")


def contained_members(stories: DataFrame, scenes: DataFrame) -> DataFrame:
    """Stories all of whose members are current scenes."""
    have = scenes.groupBy("conv_id").agg(F.collect_set("scene_id").alias("have"))
    return stories.join(have, "conv_id").filter(F.size(F.array_except("members", "have")) == 0).drop("have")


def overlay_in_force(overlays: DataFrame, at: Column | None = None) -> DataFrame:
    if at is None:
        return overlays.filter("removed_at is null")
    return overlays.filter(known_at(F.col("created_at"), F.col("removed_at"), at))


def overlaid(rows: DataFrame, overlays: DataFrame, key: str) -> DataFrame:
    """rows under an owner's repairs: retracted ones gone, corrected ones with the owner's value, restored ones back.

    overlays: target (the row's key), kind in retract, correct, restore; the latest per target decides.
    """
    last = latest_per(overlays, ["target"], F.desc("created_at"), F.desc("id")).select(F.col("target").alias(key), F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    out = rows.join(last, key, "left").filter(~F.col("_kind").eqNullSafe("retract"))
    return out.withColumn("value", F.when(F.col("_kind") == "correct", F.col("_value")).otherwise(F.col("value"))).drop("_kind", "_value")


def active_generation(generations: DataFrame) -> DataFrame:
    return generations.groupBy("kind").agg(F.max_by("key", "activated_at").alias("key"))


def generation_key(kind: Column, model: Column, spec: Column) -> Column:
    """Identity of a derivation."""
    return F.substring(F.sha2(F.to_json(F.struct(kind.alias("kind"), model.alias("model"), spec.alias("spec"))), 256), 1, 16)


def change_class(old: Column, new: Column) -> Column:
    """How a specification (model, version, fields array) differs from the one before it."""
    return (
        F.when(old.isNull(), "new").when(old.eqNullSafe(new), "same")
        .when(old["model"] != new["model"], "model")
        .when((F.size(F.array_except(old["fields"], new["fields"])) == 0) & (F.size(F.array_except(new["fields"], old["fields"])) > 0), "adds")
        .otherwise("version"))


def prunable(rows: DataFrame, active: str, busy: DataFrame) -> DataFrame:
    """Rows of other projections where the active one has the same source and nothing is queued for it."""
    have = rows.filter(F.col("projection") == active).select("rev_id").distinct()
    return rows.filter(F.col("projection") != active).join(have, "rev_id", "left_semi").join(busy, "rev_id", "left_anti")


def discarded(extractions: DataFrame, which: DataFrame, by: list[str], at: Column) -> DataFrame:
    """extractions with the given ones marked as discarded at a time; one that is already keeps its own."""
    mark = which.select(*by).distinct().withColumn("_hit", F.lit(True))
    return extractions.join(mark, by, "left").withColumn("discarded_at", F.when(F.col("_hit") & F.col("discarded_at").isNull(), at).otherwise(F.col("discarded_at"))).drop("_hit")


def job_order(jobs: DataFrame, now: Column, lease_minutes: int = 10, attempts: int = 5) -> DataFrame:
    """Jobs in the order in which workers claim them: queued ones and those whose lease ran out, by priority, then age."""
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("claimed_at") < now - F.make_interval(mins=F.lit(lease_minutes))))
    ready = jobs.filter(free & (F.col("attempts") < attempts) & (F.coalesce(F.col("not_before"), now) <= now))
    # Within a chat the first job goes first; across chats workers run side by side.
    return ready.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("priority", "created_at", "job_id")))


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(600), 15 * F.pow(F.lit(2), attempts)).cast("int")


def unserved(jobs: DataFrame, handlers: list[str]) -> DataFrame:
    """Queued jobs of kinds that no worker handles."""
    return jobs.filter((F.col("status") == "queued") & ~F.col("kind").isin(handlers)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
