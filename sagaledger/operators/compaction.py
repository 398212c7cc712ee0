"""Observations of whole manifests kept as differences from a base, with a new base where too much has changed.

In a chat's order, an observation whose rows differ from the latest base in more than RATIO of them becomes the next base; all
others are kept as their length and the changed rows.  A base depends on the base before it only, so bases are found in
rounds: each round looks at what follows the bases found last, for all chats at once, and no chat is one task.  To rebuild an
observation its base alone is read.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import held
from .ledger import positional_diff

#: Share of changed rows above which an observation is kept whole.
RATIO = 0.25
#: Rounds after which what has been found is stored as one table, so that no plan grows with the rounds.
UNIONS = 16


def is_checkpoint(base: Column, now: Column) -> Column:
    return F.size(positional_diff(base, now)) > RATIO * F.greatest(F.lit(1), F.size(now))


def bases(observations: DataFrame) -> DataFrame:
    """(conv_id, obs_id) of the observations that are kept whole.  observations: conv_id, obs_id (in order), entries (array)."""
    return _bases(held(observations.select("conv_id", "obs_id", "entries"))).select("conv_id", F.col("_b").alias("obs_id"))


def _first(rows: DataFrame) -> DataFrame:
    """(conv_id, _b, _e): number and entries of each chat's first observation."""
    return held(rows.groupBy("conv_id").agg(F.min("obs_id").alias("_b"), F.min_by("entries", "obs_id").alias("_e")))


def _bases(rows: DataFrame) -> DataFrame:
    """(conv_id, _b, _e): the observations that are kept whole, with their entries.

    Arrays are larger than the planner takes them for, so what holds them is never sent to the driver: joins are by sorting.
    """
    last = out = _first(rows)
    for n in count(1):
        behind = rows.join(last.hint("merge"), "conv_id").filter(F.col("obs_id") > F.col("_b"))
        last = _first(behind.filter(is_checkpoint(F.col("_e"), F.col("entries"))))
        if last.isEmpty():
            return out
        out = out.unionByName(last)
        if n % UNIONS == 0:
            out = held(out)


def compacted(observations: DataFrame) -> DataFrame:
    """(conv_id, obs_id, base_id, length, changed, entries): entries and no base for what is kept whole, else changed, the
    (at, value) of rows that differ from those of base_id."""
    rows = held(observations.select("conv_id", "obs_id", "entries"))
    whole = _bases(rows)
    marked = rows.join(whole.select("conv_id", F.col("_b").alias("obs_id"), F.lit(True).alias("_whole")).hint("merge"), ["conv_id", "obs_id"], "left")
    upto = Window.partitionBy("conv_id").orderBy("obs_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_base", F.last(F.when(F.col("_whole"), F.col("obs_id")), ignorenulls=True).over(upto))
    rows = marked.join(whole.withColumnRenamed("_b", "_base").hint("merge"), ["conv_id", "_base"])
    kept = F.coalesce("_whole", F.lit(False))
    return rows.select("conv_id", "obs_id", F.when(~kept, F.col("_base")).alias("base_id"), F.size("entries").alias("length"), F.when(~kept, positional_diff(F.col("_e"), F.col("entries"))).alias("changed"), F.when(kept, F.col("entries")).alias("entries"))


def patched(base: Column, changed: Column, length: Column) -> Column:
    """The rows of a base with the changed ones put in, cut to a length: the stretches between changes are taken as they are."""
    first = F.coalesce(F.get(changed, F.lit(0))["at"], length)
    until = lambda k: F.coalesce(F.get(changed, k + 1)["at"], length)
    parts = F.transform(changed, lambda d, k: F.concat(F.array(d["value"]), F.slice(base, d["at"] + 2, F.greatest(until(k) - d["at"] - 1, F.lit(0)))))
    return F.concat(F.slice(base, F.lit(1), first), F.flatten(parts))


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, obs_id, entries) of what compacted() made."""
    whole = rows.filter("base_id IS NULL").select("conv_id", F.col("obs_id").alias("base_id"), F.col("entries").alias("_e"))
    back = rows.filter("base_id IS NOT NULL").drop("entries").join(whole.hint("merge"), ["conv_id", "base_id"])
    return rows.filter("base_id IS NULL").select("conv_id", "obs_id", "entries").unionByName(back.select("conv_id", "obs_id", patched(F.col("_e"), F.col("changed"), F.col("length")).alias("entries")))
