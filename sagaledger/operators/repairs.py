"""An owner's repairs merged into the story's statements, and what locks hold off.

Two ordered streams meet: the story's statements, in the order of their positions, and the owner's repairs, in the order they
were made.  A repair names its statement by what it says at a turn, so repairs and statements that say the same meet by their
rank among each other: the first repair that takes a statement away takes the first of them, the next one the next.  A
correction from a later turn takes nothing away; it adds a version at the end of that turn.  After the merge everything is
windows over (position, owner's last, order made).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fact_norm
from .folds import MULTI, is_symmetric, version_key

#: What a repair must share with a statement: the turn, and what it says.
_SAYS = ["conv_id", "_turn", "_subject", "_predicate", "_object", "_value"]

#: Columns of a merged row, beside those that say what it states.
STATED = ["subject", "subject_type", "predicate", "object", "object_type", "value", "polarity"]


def _says(rows: DataFrame) -> DataFrame:
    low = lambda c: F.coalesce(fact_norm(F.col(c)), F.lit(""))
    return rows.withColumns({"_turn": F.coalesce("turn", F.lit(-2)), "_subject": low("subject"), "_predicate": F.col("predicate"), "_object": low("object"), "_value": low("value")})


def repaired(statements: DataFrame, repairs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, applied): the statements under retractions, corrections and restores, and what each repair applied to.

    statements: conv_id, id, position, turn and STATED (turn -1: the setting).  repairs: conv_id, repair_id (a positive number),
    seq (the order made), kind (fact_retract, fact_correct, fact_restore), turn and STATED as the repair found or restores them,
    new_value, from_turn, turn_hash.  turns: conv_id, turn, position (its last), turn_hash.

    rows: conv_id, id (the negative repair_id of an owner's version), position, turn, STATED, owner, repair_id.  A correction at
    the statement's own turn, or of a predicate that holds many values, stands where the statement stood; from a later turn it
    stands at the end of it.  A restore applies to a statement that says the same at that turn again, and adds one otherwise if
    the turn still reads as it did.  applied: conv_id, repair_id, id, or null where a repair applied to nothing.
    """
    kind = F.col("kind")
    at = F.coalesce("from_turn", "turn")
    inplace = (kind == "fact_correct") & ((at == F.col("turn")) | F.col("predicate").isin(*MULTI))
    made = _says(repairs).withColumn("_takes", (kind == "fact_retract") | inplace)
    asked = made.filter(kind.isin("fact_retract", "fact_correct"))
    before = Window.partitionBy(*_SAYS).orderBy("seq", "repair_id").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("_n", 1 + F.coalesce(F.sum(F.col("_takes").cast("int")).over(before), F.lit(0)))
    rows = _says(statements).withColumn("_n", F.row_number().over(Window.partitionBy(*_SAYS).orderBy("position", "id")))
    met = asked.select(*_SAYS, "_n", "repair_id", "seq", "kind", "_takes", "new_value", at.alias("_at")).join(rows, [*_SAYS, "_n"])

    taken = met.filter("_takes").select("conv_id", "id")
    kept = rows.join(taken, ["conv_id", "id"], "left_anti")
    none = F.lit(None).cast("bigint")
    shape = lambda df, ident, owner, repair, seq: df.select("conv_id", ident.cast("bigint").alias("id"), "position", "turn", *STATED, F.lit(owner).alias("owner"), repair.cast("bigint").alias("repair_id"), seq.cast("bigint").alias("seq"))
    story = shape(kept, F.col("id"), False, none, F.lit(0))

    corrected = met.filter(F.col("kind") == "fact_correct").withColumn("value", F.coalesce("new_value", "value"))
    here = shape(corrected.filter("_takes"), -F.col("repair_id"), True, F.col("repair_id"), F.col("seq"))
    ends = turns.select("conv_id", F.col("turn").alias("_t"), F.lit(0).alias("_side"), F.col("position").alias("_end"), none.alias("repair_id"))
    later = corrected.filter("NOT _takes")
    # The end of the latest turn up to the one that the correction holds from.
    asof = Window.partitionBy("conv_id").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = ends.unionByName(later.select("conv_id", F.col("_at").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("int").alias("_end"), F.col("repair_id").cast("bigint").alias("repair_id")))
    found = found.withColumn("_end", F.last("_end", ignorenulls=True).over(asof)).filter("_side = 1").select("conv_id", "repair_id", "_end")
    later = later.join(found, ["conv_id", "repair_id"]).withColumn("position", F.coalesce("_end", "position")).withColumn("turn", F.col("_at"))
    behind = shape(later, -F.col("repair_id"), True, F.col("repair_id"), F.col("seq"))

    back = made.filter(kind == "fact_restore")
    alive = back.join(turns.select("conv_id", "turn", "turn_hash", F.col("position").alias("_end")), ["conv_id", "turn", "turn_hash"])
    same = rows.groupBy(*_SAYS).agg(F.min_by("id", F.struct("position", "id")).cast("bigint").alias("_again"))
    alive = alive.join(same, _SAYS, "left").withColumn("position", F.col("_end"))
    again = alive.filter("_again IS NOT NULL").select("conv_id", "repair_id", F.col("_again").alias("id"))
    new = alive.filter("_again IS NULL")
    restored = shape(new, -F.col("repair_id"), True, F.col("repair_id"), F.col("seq"))

    out = story.unionByName(here).unionByName(behind).unionByName(restored)
    hit = met.select("conv_id", "repair_id", F.col("id").cast("bigint").alias("id")).unionByName(again).unionByName(new.select("conv_id", "repair_id", (-F.col("repair_id")).cast("bigint").alias("id")))
    return out, repairs.select("conv_id", "repair_id").join(hit, ["conv_id", "repair_id"], "left")


def locked(rows: DataFrame, locks: DataFrame) -> DataFrame:
    """rows of repaired() with lock_id, the owner's lock on them.

    locks: conv_id, lock_id, seq, target_repair (an owner's version), or turn -1 and STATED (a statement of the setting).  Of
    several locks on a row the first counts.
    """
    first = lambda df, by: df.groupBy(*by).agg(F.min_by("lock_id", F.struct("seq", "lock_id")).alias("lock_id"))
    own = first(locks.filter("target_repair IS NOT NULL").select("conv_id", (-F.col("target_repair")).cast("bigint").alias("id"), "lock_id", "seq"), ["conv_id", "id"])
    canon = _says(rows.filter("turn = -1 AND NOT owner")).withColumn("_n", F.row_number().over(Window.partitionBy(*_SAYS).orderBy("position", "id")))
    said = canon.filter("_n = 1").select(*_SAYS, "id").join(_says(locks.filter("target_repair IS NULL")).select(*_SAYS, "lock_id", "seq"), _SAYS)
    return rows.join(own.unionByName(first(said, ["conv_id", "id"])), ["conv_id", "id"], "left")


def held_off(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, off) of rows of locked(): what the version fold reads, and (conv_id, key, lock_id, id) of each statement that a lock
    holds off.

    A statement after a locked one that would replace or end it is held off, against the latest such lock; one that says the
    same as that lock is in neither.  A tie between two is changed by a statement in the same direction, or by one that holds
    both ways.
    """
    low = lambda c: F.coalesce(fact_norm(F.col(c)), F.lit(""))
    rows = rows.withColumn("key", version_key(rows)).withColumn("_both", F.coalesce((F.col("predicate") == "relationship") & is_symmetric(F.col("value")), F.lit(False)))
    order = ["position", F.col("owner").cast("int"), "seq", "id"]
    said = F.struct("predicate", F.coalesce("polarity", F.lit("positive")).alias("polarity"), low("value").alias("value"), low("subject").alias("s"), low("object").alias("o"), "_both", "lock_id")
    place = F.row_number().over(Window.partitionBy("conv_id", "key").orderBy(*order))
    rows = rows.withColumns({"_said": said, "_at": place})
    mark = lambda test: F.last(F.when(F.col("lock_id").isNotNull() & test, F.struct("_at", "_said")), ignorenulls=True)
    by = Window.partitionBy("conv_id", "key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    way = Window.partitionBy("conv_id", "key", low("subject")).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    yes = F.lit(True)
    tie = F.col("predicate") == "relationship"
    rows = rows.withColumns({"_any": mark(yes).over(by), "_way": mark(yes).over(way), "_sym": mark(F.col("_both")).over(by)})
    # The latest of the locks that the statement would change; nulls are least.
    latest = F.when(~tie | F.col("_both"), F.col("_any")).otherwise(F.greatest("_way", "_sym"))
    rows = rows.withColumn("_against", F.when(F.col("lock_id").isNull(), latest))
    a, b = F.col("_said"), F.col("_against._said")
    ends = (a["s"] == b["s"]) & (a["o"] == b["o"]) | (F.col("_both") & (a["s"] == b["o"]) & (a["o"] == b["s"]))
    same = (a["predicate"] == b["predicate"]) & (a["polarity"] == b["polarity"]) & (a["value"] == b["value"]) & ends
    # The fold orders by position and id, so positions become places in the merged order.
    kept = rows.filter("_against IS NULL").drop("_said", "_at", "_any", "_way", "_sym", "_against", "_both", "key")
    kept = kept.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    off = rows.filter(F.col("_against").isNotNull() & ~same).select("conv_id", "key", F.col("_against._said.lock_id").alias("lock_id"), "id")
    return kept, off


def exclusions(repairs: DataFrame, names: DataFrame) -> DataFrame:
    """(conv_id, entity, scope, repair_id): who the owner left out.  names: conv_id, name, entity.

    Of two on one entity one of scope memory wins, else the first.
    """
    asked = repairs.filter("kind = 'entity_exclude'").select("conv_id", fact_norm(F.col("name")).alias("_n"), F.coalesce("scope", F.lit("cast")).alias("scope"), "repair_id", "seq")
    known = names.select("conv_id", fact_norm(F.col("name")).alias("_n"), "entity").distinct()
    met = asked.join(known, ["conv_id", "_n"])
    best = F.min_by(F.struct("scope", "repair_id"), F.struct((F.col("scope") != "memory").cast("int"), F.col("seq"), F.col("repair_id")))
    return met.groupBy("conv_id", "entity").agg(best.alias("b")).select("conv_id", "entity", "b.scope", "b.repair_id")


def thread_states(openings: DataFrame, closings: DataFrame, events: DataFrame) -> DataFrame:
    """(conv_id, thread_id, turn, status, by_owner) after every change of a thread, and whether the change is its last.

    openings: conv_id, thread_id, turn; closings, by the story: conv_id, thread_id, turn, outcome; events, by the owner: the same
    with seq and kind (thread_close, thread_reopen).  At a turn the story comes first.  What would close a closed thread or
    reopen an open one changes nothing.
    """
    part = lambda df, status, side, seq: df.select("conv_id", "thread_id", "turn", status.alias("status"), F.lit(side).alias("_side"), seq.cast("bigint").alias("_seq"))
    owner = F.when(F.col("kind") == "thread_close", F.coalesce("outcome", F.lit("done"))).otherwise("open")
    rows = part(openings, F.lit("open"), 0, F.lit(0)).unionByName(part(closings, F.coalesce("outcome", F.lit("done")), 1, F.lit(0))).unionByName(part(events, owner, 2, F.col("seq")))
    w = Window.partitionBy("conv_id", "thread_id").orderBy("turn", "_side", "_seq", "status")
    is_open = F.col("status") == "open"
    rows = rows.withColumn("_was", F.lag(is_open).over(w)).filter(F.col("_was").isNull() | (F.col("_was") != is_open))
    return rows.select("conv_id", "thread_id", "turn", "status", (F.col("_side") == 2).alias("by_owner"), F.lead("status").over(w).isNull().alias("last"))
