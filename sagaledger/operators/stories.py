"""Scenes over windows of turns and stories over scenes: two levels, each in force only while its members are.

A scene summarises a window and names it by a hash of the window's versions in order.  A story is made of scenes.  An edit
changes the hash of one window, so it takes one scene and the stories made of it out of force, and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def members_key(members: Column) -> Column:
    return F.substring(F.sha2(F.array_join(members, "\n"), 256), 1, 32)


def current_scenes(windows: DataFrame, scenes: DataFrame, generation: str | None = None) -> DataFrame:
    """(conv_id, window, scene_id): the newest scene of each due window as it reads now.

    windows: conv_id, window, members.  scenes: conv_id, key (members_key of the window that it summarised), scene_id,
    generation, created_at, activated_at.  The given generation's scene is preferred; the most recently activated one's serves
    where it has none.
    """
    now = windows.select("conv_id", "window", members_key(F.col("members")).alias("key"))
    best = [F.desc(F.col("generation").eqNullSafe(F.lit(generation))), F.desc("activated_at"), F.desc("created_at"), F.desc("scene_id")]
    rows = now.join(scenes, ["conv_id", "key"]).withColumn("_n", F.row_number().over(Window.partitionBy("conv_id", "window").orderBy(*best)))
    return rows.filter("_n = 1").select("conv_id", "window", "scene_id")


def current_story(stories: DataFrame, current: DataFrame, generation: str | None = None) -> DataFrame:
    """(conv_id, story_id, scenes): the story in force.  stories: conv_id, story_id, members (of scene_id), generation,
    created_at, activated_at.

    A story serves while all its scenes are current.  Of each generation the newest counts; of those the one made of the most
    scenes, then the given generation's, then the most recently activated one's.  Scenes meet stories by their ids, so a
    chat's stories are never held against each other.
    """
    each = stories.filter(F.size("members") > 0).select("conv_id", "story_id", F.explode("members").alias("scene_id"))
    whole = each.join(current.select("conv_id", "scene_id", F.lit(1).alias("_here")), ["conv_id", "scene_id"], "left").groupBy("conv_id", "story_id").agg(F.count(F.lit(1)).alias("scenes"), F.count("_here").alias("_have")).filter("scenes = _have")
    rows = stories.join(whole.select("conv_id", "story_id", "scenes"), ["conv_id", "story_id"])
    newest = Window.partitionBy("conv_id", "generation").orderBy(F.desc("created_at"), F.desc("story_id"))
    rows = rows.withColumn("_g", F.row_number().over(newest)).filter("_g = 1")
    best = Window.partitionBy("conv_id").orderBy(F.desc("scenes"), F.desc(F.col("generation").eqNullSafe(F.lit(generation))), F.desc("activated_at"), F.desc("story_id"))
    return rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("conv_id", "story_id", F.col("scenes").cast("bigint").alias("scenes"))


def schedule(windows: DataFrame, current: DataFrame, story: DataFrame) -> DataFrame:
    """(conv_id, kind, window): what is to be written: due windows without a scene, and a story (window null) where every due
    window has its scene and the story in force does not hold them all."""
    due = windows.select("conv_id", "window").join(current.select("conv_id", "window", "scene_id"), ["conv_id", "window"], "left")
    lacking = due.filter("scene_id IS NULL").select("conv_id", F.lit("scene").alias("kind"), "window")
    done = due.groupBy("conv_id").agg(F.count(F.lit(1)).alias("due"), F.count("scene_id").alias("have")).filter("due = have")
    behind = done.join(story, "conv_id", "left").filter(F.coalesce("scenes", F.lit(0)) < F.col("have"))
    return lacking.unionByName(behind.select("conv_id", F.lit("story").alias("kind"), F.lit(None).cast(dict(windows.dtypes)["window"]).alias("window")))
