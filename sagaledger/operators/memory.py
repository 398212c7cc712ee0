"""Compositions: the memory view, replay of recorded requests, cleaning of extracted rows, and what is due for another pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import containment, fact_norm, grams, overlap
from . import entities, folds, packing, serving

# What the fields of an assertion may say; anything else is as good as unsaid.
POLARITY = ("positive", "negative")
MODALITY = ("actual", "hypothetical", "dreamed", "unknown")
SOURCE = ("narration", "character_claim")
KNOWLEDGE = ("public", "limited", "unknown")
OUTCOMES = ("achieved", "failed", "abandoned", "answered", "averted", "repaid")
SALIENCE = ("major", "minor")


def cleaned_fields(rows: DataFrame) -> DataFrame:
    """Extracted rows with their marks in order.

    Unknown words become the default; a claim without a speaker is narration; a name cannot both know a thing and be kept
    from it; a limited statement that nobody is kept from and nobody knows is of unknown reach; an outcome stays only with
    the predicate that ends something.
    """
    word = lambda c: F.lower(F.trim(F.col(c)))
    one_of = lambda c, allowed, default: F.when(word(c).isin(*allowed), word(c)).otherwise(F.lit(default))
    names = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.trim(x)), lambda n: n != ""))
    out = rows.withColumn("polarity", one_of("polarity", POLARITY, "positive")).withColumn("modality", one_of("modality", MODALITY, "actual"))
    speaker = F.nullif(F.trim("asserted_by"), F.lit(""))
    claim = (word("source") == "character_claim") & speaker.isNotNull()
    out = out.withColumn("source", F.when(claim, "character_claim").otherwise("narration")).withColumn("asserted_by", F.when(claim, speaker))
    out = out.withColumn("known_by", names("known_by")).withColumn("hidden_from", F.array_except(names("hidden_from"), names("known_by")))
    scope = one_of("knowledge", KNOWLEDGE, "public")
    empty = (F.size("known_by") == 0) & (F.size("hidden_from") == 0)
    out = out.withColumn("knowledge", F.when((scope == "limited") & empty, "unknown").otherwise(scope))
    out = out.withColumn("outcome", F.when((F.col("predicate") == "resolved") & word("outcome").isin(*OUTCOMES), word("outcome")))
    return out.withColumn("salience", F.when((F.col("predicate") == "event") & word("salience").isin(*SALIENCE), word("salience")))


def memory_view(assertions: DataFrame, owner_links: DataFrame, repairs: DataFrame | None = None, upto: int | None = None, at: Column | None = None) -> dict[str, DataFrame]:
    """Facts, claims, entities, threads and secrets of every conversation, as of a position and a time.

    The order is part of the meaning: repairs first, then entities, then secrets, then threads, then versions; versions and
    claims are folded over names that the entities gave.
    """
    rows = assertions if upto is None else assertions.filter(F.col("position") <= upto)
    if at is not None:
        rows = rows.filter(serving.known_at(F.col("created_at"), F.col("discarded_at"), at))
    if repairs is not None:
        live = serving.overlay_in_force(repairs, at)
        rows = serving.overlaid(rows, live, "id")
    found = entities.resolve(rows, owner_links)
    # Names and versions grow with the chats, so they are joined by sorting and never sent to the driver.
    known = found.filter("entity_id is not null").select("conv_id", F.col("type").alias("_t"), fact_norm(F.col("name")).alias("_n"), "entity_name")
    known = known.groupBy("conv_id", "_t", "_n").agg(F.min("entity_name").alias("entity_name"))
    for side in ("subject", "object"):
        kind = F.coalesce(F.col(f"{side}_type"), F.lit("character"))
        named = rows.withColumn("_t", kind).withColumn("_n", fact_norm(F.col(side))).join(known.hint("merge"), ["conv_id", "_t", "_n"], "left")
        rows = named.withColumn(side, F.when(F.col(side).isNotNull(), F.coalesce("entity_name", side))).drop("_t", "_n", "entity_name")
    folded = folds.versions(rows)
    facts = rows.join(folded.select("conv_id", "id", "key", F.col("outcome").alias("standing"), "closed_turn", "disputed").hint("merge"), ["conv_id", "id"])
    return {
        "facts": facts.filter("standing = 'current'"), "history": facts, "claims": folds.claims(rows), "entities": found,
        "ambiguous": found.filter("ambiguous"), "secrets": folds.secrets_open(rows), "threads": folds.threads(rows),
        "conflicts": facts.filter("disputed"), "items": facts.filter(F.startswith("key", F.lit('{"col1":"whereabouts"')) & (F.col("standing") == "current")),
    }


def restated(old: DataFrame, new: DataFrame, least: float = 0.6) -> DataFrame:
    """Facts of a discarded extraction that the new one of the same turn does not restate.

    A fact is restated by an equal version key, or by a statement of the same subject and predicate whose text is close.
    Candidates share conversation, turn, subject and predicate, so no fact meets those of other turns.
    """
    a, b = old.withColumn("_key", folds.version_key(old)), new.withColumn("_key", folds.version_key(new))
    left = a.join(b.select("conv_id", "turn", "_key"), ["conv_id", "turn", "_key"], "left_anti").drop("_key")
    by = ["conv_id", "turn", "_s", "predicate"]
    pair = left.withColumn("_s", fact_norm(F.col("subject"))).join(new.select("conv_id", "turn", fact_norm(F.col("subject")).alias("_s"), "predicate", F.col("value").alias("_v")), by)
    near = pair.filter(overlap(grams(F.col("value")), grams(F.col("_v"))) >= least).select("conv_id", "id").distinct()
    return left.join(near, ["conv_id", "id"], "left_anti")


def accepted_endings(answers: DataFrame, listed: DataFrame, turns: DataFrame, least: float = 0.7) -> DataFrame:
    """Answered endings (conv_id, turn, item, evidence) that name a listed item (conv_id, turn, item, party) and whose
    evidence stands in the turn (conv_id, turn, text) and names a party; each with accepted, or why it is held."""
    from .views import mentioned, quoted_in

    rows = answers.join(listed, ["conv_id", "turn", "item"], "left").join(turns, ["conv_id", "turn"], "left")
    shown = F.coalesce(quoted_in(F.col("evidence"), F.col("text"), least), F.lit(False))
    named = F.coalesce(mentioned(F.col("party"), F.col("evidence")), F.lit(False))
    why = F.when(F.col("party").isNull(), "not listed").when(~shown, "no evidence").when(~named, "party not named").otherwise("accepted")
    return rows.select("conv_id", "turn", "item", why.alias("why"))


def unchecked_reveals(turns: DataFrame, secrets: DataFrame, checks: DataFrame) -> DataFrame:
    """(conv_id, turn): turns behind a secret's turn whose check is missing or older than the secret's statement.

    turns: conv_id, turn, extracted_at; secrets: conv_id, turn, created_at; checks: conv_id, turn, created_at.
    """
    # Of the secrets before a turn only the newest statement matters, which a running maximum has.
    made = secrets.select("conv_id", "turn", F.lit(0).alias("_side"), F.col("created_at").alias("_made"), F.lit(None).cast("timestamp").alias("extracted_at"))
    each = turns.select("conv_id", "turn", F.lit(-1).alias("_side"), F.lit(None).cast("timestamp").alias("_made"), "extracted_at")
    w = Window.partitionBy("conv_id").orderBy("turn", "_side").rowsBetween(Window.unboundedPreceding, -1)
    rows = made.unionByName(each).withColumn("_newest", F.max("_made").over(w)).filter("_side = -1 and _newest is not null")
    last = checks.groupBy("conv_id", "turn").agg(F.max("created_at").alias("_checked"))
    done = F.greatest(F.coalesce("_checked", "extracted_at"), F.col("extracted_at"))
    return rows.join(last, ["conv_id", "turn"], "left").filter(done.isNull() | (done < F.col("_newest"))).select("conv_id", "turn")


def canon_in_force(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """Setting texts (conv_id, key, kind, hash) to be read: card fields always, lore only if some prompt has held it."""
    return entries.filter("kind = 'card'").unionByName(entries.filter("kind <> 'card'").join(seen.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi"))


def stale_summaries(summaries: DataFrame, secrets: DataFrame) -> DataFrame:
    """Summaries (conv_id, window, last_turn, created_at) that were written before a secret of their turns was known."""
    rows = summaries.join(secrets.select("conv_id", F.col("turn").alias("_turn"), F.col("created_at").alias("_made")), "conv_id")
    hit = rows.filter((F.col("_turn") <= F.col("last_turn")) & (F.col("_made") > F.col("created_at")))
    return hit.select("conv_id", "window").distinct()


def chronicle(scenes: DataFrame, secrets: DataFrame, chars: int = 4000, least: float = 0.7) -> DataFrame:
    """(conv_id, ref, text): the newest scenes that fit into a budget of characters, without those that repeat a secret."""
    clean = scenes.join(packing.leaks(scenes, secrets, least).select("conv_id", "ref"), ["conv_id", "ref"], "left_anti")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "ref").rowsBetween(Window.unboundedPreceding, 0)
    return clean.withColumn("_sum", F.sum(F.length("text")).over(w)).filter(F.col("_sum") <= chars).drop("_sum")


def role_endings(history: DataFrame, last: DataFrame, within: int = 25) -> DataFrame:
    """Roles that the story ended of late: (conv_id, key, value, turn), for the owner to look at."""
    now = last.select("conv_id", F.col("turn").alias("_now"))
    return history.filter("predicate = 'role_toward' and standing = 'ended'").join(now, "conv_id").filter(F.col("closed_turn") > F.col("_now") - within).select("conv_id", "key", "value", F.col("closed_turn").alias("turn"))


def work_counters(facts: DataFrame, summaries: DataFrame, jobs: DataFrame) -> DataFrame:
    """(what, n): rows made, and summary jobs by state."""
    made = facts.agg(F.count(F.lit(1)).alias("n")).select(F.lit("facts").alias("what"), "n").unionByName(summaries.agg(F.count(F.lit(1)).alias("n")).select(F.lit("summaries").alias("what"), "n"))
    states = jobs.filter("kind = 'summary'").groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("summary jobs "), "status").alias("what"), "n")
    return made.unionByName(states)


def replay(lines: DataFrame, recorded: DataFrame, policy: str | None = None) -> DataFrame:
    """(request_id, reproduced, changed): recorded ledgers (request_id, n, placed, why) against packing the same lines again,
    under the recorded policy or another."""
    again = packing.pack(lines, policy or packing.DEFAULT_POLICY).select("request_id", "n", F.struct("placed", "why").alias("_now"))
    met = recorded.select("request_id", "n", F.struct("placed", "why").alias("_then")).join(again, ["request_id", "n"], "full")
    same = F.col("_now").eqNullSafe(F.col("_then"))
    return met.groupBy("request_id").agg(F.bool_and(same).alias("reproduced"), F.count_if(~same).alias("changed"))


def summary_gate(summaries: DataFrame, secrets: DataFrame, absent: DataFrame, strict: float = 0.3, plain: float = 0.7) -> DataFrame:
    """summaries (conv_id, ref, text) that may be shown: none that repeats a secret, with a lower bar while someone who must
    not know it (conv_id, name against the secret's name) is in the scene."""
    met = summaries.join(secrets.select("conv_id", "name", "secret"), "conv_id").join(absent.select("conv_id", "name").distinct().withColumn("_here", F.lit(True)), ["conv_id", "name"], "left")
    bar = F.when(F.col("_here"), strict).otherwise(plain)
    held = met.filter(containment(grams(F.col("secret")), grams(F.col("text"))) >= bar).select("conv_id", "ref").distinct()
    return summaries.join(held, ["conv_id", "ref"], "left_anti")
