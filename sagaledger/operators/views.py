"""Views over folded memory: timelines, the map of ties, pairs, dashboards, hints for the next extraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spans(history: DataFrame, by: list[str], value: str = "value", turn: str = "turn") -> DataFrame:
    """(by, value, start, end): stretches of turns in which a value held; equal neighbours are one, the last is open."""
    w = Window.partitionBy(*by).orderBy(turn)
    opens = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    rows = history.withColumn("_i", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = rows.groupBy(*by, "_i").agg(F.first(value).alias(value), F.min(turn).alias("start"))
    return each.withColumn("end", F.lead("start").over(Window.partitionBy(*by).orderBy("_i")) - 1).drop("_i")


def recent(spans_: DataFrame, last: DataFrame, by: list[str], turns: int = 25) -> DataFrame:
    """Spans that reach into the last turns."""
    now = last.select(*by, F.col("turn").alias("_now"))
    return spans_.join(now, by).filter(F.coalesce("end", "_now") > F.col("_now") - turns).drop("_now")


def capped(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def edges(ties: DataFrame) -> DataFrame:
    """(conv_id, a, b, n, mark): ties of unordered pairs; mark says whether setting, story or both speak of them."""
    pair = ties.select("conv_id", F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), "turn", "value")
    mark = F.when(F.bool_and(F.col("turn") < 0), "setting").when(F.bool_or(F.col("turn") < 0), "changed").otherwise("story")
    return pair.filter("a <> b").groupBy("conv_id", "a", "b").agg(F.count(F.lit(1)).alias("n"), mark.alias("mark"))


def nodes(found: DataFrame, most: int = 40) -> DataFrame:
    """(conv_id, node, degree): the best connected nodes of each conversation."""
    ends = found.select("conv_id", F.col("a").alias("node"), "n").unionByName(found.select("conv_id", F.col("b").alias("node"), "n"))
    degree = ends.groupBy("conv_id", "node").agg(F.count(F.lit(1)).alias("degree"), F.sum("n").alias("ties"))
    return capped(degree, ["conv_id"], [F.desc("degree"), F.desc("ties"), F.col("node")], most)


def neighbours(found: DataFrame, focus: Column) -> DataFrame:
    """Edges at a node, and those among its neighbours."""
    at = found.filter((F.col("a") == focus) | (F.col("b") == focus))
    near = at.select("conv_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    return found.join(near.withColumnRenamed("node", "a"), ["conv_id", "a"], "left_semi").join(near.withColumnRenamed("node", "b"), ["conv_id", "b"], "left_semi")


def pairs(facts: DataFrame) -> DataFrame:
    """One row per unordered pair: relationships, roles, feelings and forms of address, by direction."""
    rows = facts.filter(F.col("predicate").isin("relationship", "role_toward", "feels_toward", "addresses"))
    line = F.struct("predicate", "subject", "object", "value")
    return rows.groupBy("conv_id", F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.array_sort(F.collect_list(line)).alias("lines"))


def suspects(names: DataFrame) -> DataFrame:
    """(conv_id, short, long): names that another name of their conversation begins with."""
    parts = names.select("conv_id", "name", F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: F.length(w) >= 2))).alias("part"))
    short = names.select("conv_id", F.col("name").alias("short"), F.lower("name").alias("part"))
    return parts.join(short, ["conv_id", "part"]).filter(F.lower("name") != F.col("part")).select("conv_id", "short", F.col("name").alias("long")).distinct()


def events_list(assertions: DataFrame) -> DataFrame:
    return assertions.filter("predicate = 'event' and turn >= 0").select("conv_id", "turn", "position", "id", "subject", "value", "participants", "salience", "because", "outcome").orderBy("conv_id", "position", "id")


def replaced_settings(history: DataFrame) -> DataFrame:
    """Setting values that the story has changed, one per key, with how it stands now."""
    w = Window.partitionBy("conv_id", "key").orderBy("position")
    rows = history.withColumn("was", F.first("value").over(w)).withColumn("_first", F.first("turn").over(w))
    last = rows.groupBy("conv_id", "key").agg(F.max_by("value", "position").alias("now"), F.max_by("turn", "position").alias("turn"), F.first("was").alias("was"), F.first("_first").alias("_first"))
    return last.filter((F.col("_first") < 0) & (F.col("turn") >= 0) & (F.col("now") != F.col("was"))).drop("_first")


def divergence_candidates(entries: DataFrame, named: DataFrame, chars: int = 6000) -> DataFrame:
    """Lore entries by how many entities of the recent story they touch, then how often, how lately, then by key; as many as
    fit into a budget of characters.  entries: conv_id, key, names, text; named: conv_id, name, n, last_turn."""
    touch = entries.select("conv_id", "key", "text", F.explode("names").alias("name")).join(named, ["conv_id", "name"])
    score = touch.groupBy("conv_id", "key", "text").agg(F.count_distinct("name").alias("entities"), F.sum("n").alias("times"), F.max("last_turn").alias("last_turn"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("entities"), F.desc("times"), F.desc("last_turn"), "key").rowsBetween(Window.unboundedPreceding, 0)
    return score.withColumn("chars", F.sum(F.length("text")).over(w)).filter(F.col("chars") <= chars).drop("text")


def entity_hints(mentions: DataFrame, before: int, most: int = 40) -> DataFrame:
    """(conv_id, name, last): entities mentioned before a turn, the most recent first."""
    rows = mentions.filter((F.col("turn") < before) & ~F.coalesce("persona", F.lit(False))).groupBy("conv_id", "name").agg(F.max("position").alias("last"))
    return capped(rows, ["conv_id"], [F.desc("last"), F.col("name")], most)


def open_item_hints(items: DataFrame, prompt: DataFrame, most: int = 8) -> DataFrame:
    """Open items (conv_id, id, kind, turn, names) whose people a prompt (conv_id, text) names, newest first per kind."""
    rows = items.join(prompt, "conv_id").filter(F.exists("names", lambda n: (F.length(n) >= 2) & F.contains(F.lower("text"), F.lower(n))))
    return capped(rows.drop("text"), ["conv_id", "kind"], [F.desc("turn"), F.desc("id")], most)


def name_pairs(names: DataFrame, prompt: DataFrame, most: int = 8) -> DataFrame:
    """(conv_id, long, short): full names with a part of theirs that the turn writes."""
    parts = names.select("conv_id", F.col("name").alias("long"), F.explode(F.filter(F.split("name", r"\s+"), lambda w: F.length(w) >= 2)).alias("short")).filter("long <> short")
    rows = parts.join(prompt, "conv_id").filter(F.regexp_like(F.lower("text"), F.concat(F.lit(r"(?<!\w)"), F.lower("short"), F.lit(r"(?!\w)")))).drop("text").distinct()
    return capped(rows, ["conv_id"], [F.col("long"), F.col("short")], most)


def context_window(head: DataFrame, targets: DataFrame, k: int = 1) -> DataFrame:
    """Messages of a target turn and the k turns before it; none if the head no longer shows the target."""
    at = targets.select("conv_id", F.col("turn").alias("_t"))
    return head.join(at, "conv_id").filter(F.col("turn").between(F.col("_t") - k, F.col("_t"))).withColumnRenamed("_t", "target_turn")


def quote_speakers(listed: DataFrame, answers: DataFrame) -> DataFrame:
    """Listed lines (conv_id, turn, ordinal, quote) with the speaker that an answer (conv_id, turn, names map) gives."""
    named = answers.select("conv_id", "turn", F.explode(F.map_entries("names")).alias("e")).select("conv_id", "turn", F.col("e.key").alias("ordinal"), F.col("e.value").alias("speaker"))
    return listed.join(named, ["conv_id", "turn", "ordinal"], "left")


def mentioned(name: Column, text: Column) -> Column:
    """Whether a text has a name as a word: Hangul must begin one, Latin must be one, other scripts may stand anywhere."""
    n, t = F.lower(name), F.lower(text)
    quoted = F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))
    hangul = F.regexp_like(t, F.concat(F.lit(r"(?<![\x{AC00}-\x{D7A3}])"), quoted))
    latin = F.regexp_like(t, F.concat(F.lit(r"(?<![\p{IsLatin}\p{N}])"), quoted, F.lit(r"(?![\p{IsLatin}\p{N}])")))
    return F.when(name.rlike(r"^[\x{AC00}-\x{D7A3}]"), hangul).when(name.rlike(r"^[\p{IsLatin}]"), latin).otherwise(F.contains(t, n))


def quoted_in(quote: Column, shown: Column, least: float = 0.7, chars: int = 12) -> Column:
    """Whether evidence stands in what was shown: by trigrams, each piece of a quote with an ellipsis; short ones as they are."""
    from ..functions.text import containment, grams

    pieces = F.filter(F.transform(F.split(quote, r"\.{3}|…"), lambda x: F.trim(x)), lambda p: p != "")
    one = lambda p: F.when(F.length(p) >= chars, containment(grams(p), grams(shown)) >= least).otherwise(F.contains(F.lower(shown), F.lower(p)))
    return (F.size(pieces) > 0) & F.forall(pieces, one)


def unconditional(text: str, evidence: str) -> bool:
    """Whether a text says something outside its conditional blocks at least as often as only inside them."""
    depth, outside, inside, at = 0, [], [], 0
    import re

    for m in [*re.finditer(r"\{\{#(?:if|when)[^{}]*\}\}|\{\{/(?:if|when)\}\}", text), None]:
        part = text[at : m.start() if m else len(text)]
        (inside if depth else outside).append(part)
        if m:
            depth = max(0, depth + (1 if m[0].startswith("{{#") else -1))
            at = m.end()
    count = lambda parts: sum(p.count(evidence) for p in parts)
    return bool(evidence) and count(outside) > 0 and count(outside) >= count(inside)


@F.pandas_udf(T.BooleanType())
def shown_unconditionally(text: pd.Series, evidence: pd.Series) -> pd.Series:
    return pd.Series([unconditional(t or "", e or "") for t, e in zip(text, evidence)])


def person(facts: DataFrame, threads: DataFrame, who: Column) -> dict[str, DataFrame]:
    """One person's state: facts about them and threads of theirs."""
    mine = lambda c: F.lower(c) == F.lower(who)
    return {"facts": facts.filter(mine(F.col("subject")) | mine(F.col("object"))), "threads": threads.filter(mine(F.col("by")) | mine(F.col("to")))}


def hub(people: DataFrame, threads: DataFrame, stale: DataFrame, changed: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per conversation: counts of people, open and stale threads, changed settings, and extraction coverage."""
    n = lambda df, name: df.groupBy("conv_id").agg(F.count(F.lit(1)).alias(name))
    out = coverage.select("conv_id", F.col("compiled").alias("done"), F.col("eligible").alias("due"))
    for rows, name in ((people, "people"), (threads.filter("status = 'open'"), "open"), (stale, "stale"), (changed, "changed")):
        out = out.join(n(rows, name), "conv_id", "left")
    return out.na.fill(0)


def held_keys(texts: DataFrame, prompts: DataFrame, share: float = 0.5, long: int = 20) -> DataFrame:
    """(conv_id, key): setting texts that a prompt holds wholly, or by enough of their long lines."""
    rows = texts.join(prompts, "conv_id")
    lines = F.filter(F.split("text", "\n"), lambda l: F.length(l) >= long)
    held = F.size(F.filter(lines, lambda l: F.contains(F.col("prompt"), l)))
    return rows.filter(F.contains("prompt", "text") | ((F.size(lines) > 0) & (held >= share * F.size(lines)))).select("conv_id", "key").distinct()


def query_texts(messages: DataFrame) -> DataFrame:
    """(conv_id, query, reply): the latest user message, and the reply before it."""
    last = messages.filter("role = 'user'").groupBy("conv_id").agg(F.max("position").alias("_p"))
    rows = messages.join(last, "conv_id").filter(F.col("position") <= F.col("_p"))
    return rows.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("position"))).alias("query"),
                                       F.max_by(F.when(F.col("role") != "user", F.col("text")), F.when(F.col("role") != "user", F.col("position"))).alias("reply"))


def injected(prompt: Column, packet: Column) -> Column:
    """A prompt (array<struct<role, text>>) with a packet before its last run of user messages."""
    n = F.size(prompt)
    back = F.reverse(prompt)
    run = F.aggregate(back, F.struct(F.lit(0).alias("k"), F.lit(True).alias("go")), lambda s, m: F.struct((s["k"] + F.when(s["go"] & (m["role"] == "user"), 1).otherwise(0)).alias("k"), (s["go"] & (m["role"] == "user")).alias("go")))["k"]
    return F.concat(F.slice(prompt, F.lit(1), n - run), F.array(F.struct(F.lit("system").alias("role"), packet.alias("text"))), F.slice(prompt, n - run + 1, run))
