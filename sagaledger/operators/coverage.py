"""Aggregations: what is derived, what it cost, what was offered and used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 100.0).otherwise(F.round(100.0 * part / whole, 1))


def extraction_coverage(units: DataFrame) -> DataFrame:
    """Per conversation, from units (conv_id, compiled, job, historical, truncated): how far extraction has come."""
    agg = units.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count_if("compiled").alias("compiled"),
        F.count_if(~F.col("compiled") & F.col("job").isin("queued", "running")).alias("pending"),
        F.count_if(~F.col("compiled") & (F.col("job") == "failed")).alias("failed"),
        F.count_if(~F.col("compiled") & F.col("historical")).alias("historical_only"),
        F.count_if("truncated").alias("target_truncated"),
        F.count_if(~F.col("compiled") & F.col("job").isNull()).alias("not_queued"))
    return agg.withColumn("percent", percent(F.col("compiled"), F.col("eligible"))).withColumn("complete", F.col("compiled") == F.col("eligible"))


def embedding_coverage(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per conversation: sources (conv_id, rev_id, clean_chars) against chunks (rev_id, text_end): embedded, partial."""
    ends = chunks.groupBy("rev_id").agg(F.max("text_end").alias("upto"))
    rows = sources.join(ends, "rev_id", "left")
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("upto").isNotNull()).alias("embedded"),
        F.count_if(F.col("upto") < F.col("clean_chars")).alias("partial"))


def usage_totals(rows: DataFrame, by: str = "generation") -> DataFrame:
    """Calls and tokens per generation and over all (null): sums, and how many rows reported each."""
    tokens = ("input", "output", "cached", "reasoning")
    sums = [F.sum(t).alias(t) for t in tokens] + [F.count(t).alias(f"{t}_reported") for t in tokens]
    return rows.rollup(by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(*tokens).isNull()).alias("not_recorded"), F.sum("calls").alias("calls"), *sums)


def source_counts(facts: DataFrame, sources: list[str]) -> DataFrame:
    """Facts of each predicate by where they come from, with their total."""
    out = facts.groupBy("predicate").pivot("source", sources).count().na.fill(0, sources)
    return out.withColumn("total", sum((F.col(s) for s in sources), F.lit(0)))


def event_depth(events: DataFrame) -> DataFrame:
    """Per generation and over all: events with participants, a cause, an outcome, and their weight."""
    return events.rollup("generation").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.size("participants") > 0).alias("with_participants"),
        F.count_if(F.col("because").isNotNull()).alias("with_because"), F.count_if(F.col("outcome").isNotNull()).alias("with_outcome"),
        F.count_if(F.col("salience") == "major").alias("major"), F.count_if(F.col("salience") == "minor").alias("minor"),
        F.count_if(F.col("salience").isNull()).alias("none"))


def repeat_share(requests: DataFrame) -> DataFrame:
    """Per conversation: the mean share of a request's lines that the request before it had placed too.

    requests: conv_id, n (its number), lines array<string>.
    """
    before = F.lag("lines").over(Window.partitionBy("conv_id").orderBy("n"))
    rows = requests.withColumn("_before", before).filter(F.col("_before").isNotNull() & (F.size("lines") > 0))
    share = F.size(F.array_intersect("lines", "_before")) / F.size(F.array_distinct("lines"))
    return rows.groupBy("conv_id").agg(F.avg(share).alias("repeat_share"), F.count(F.lit(1)).alias("pairs"))


def tired_lines(offers: DataFrame, n: int = 3) -> DataFrame:
    """(conv_id, line): lines placed in each of the last n requests of their conversation and never echoed in a reply.

    offers: conv_id, request (a number), line, placed, echoed.
    """
    last = F.max("request").over(Window.partitionBy("conv_id"))
    recent = offers.withColumn("_last", last).filter((F.col("request") > F.col("_last") - n) & F.col("placed"))
    return recent.groupBy("conv_id", "line").agg(F.count_distinct("request").alias("k"), F.bool_or("echoed").alias("e")).filter((F.col("k") == n) & ~F.col("e")).select("conv_id", "line")


def policy_compare(lines: DataFrame) -> DataFrame:
    """Per policy: packets, tokens placed, lines placed by kind, excerpts offered and placed."""
    placed = F.col("placed")
    return lines.groupBy("policy").agg(
        F.count_distinct("trace_id").alias("packets"), F.sum(F.when(placed, F.col("tok")).otherwise(0)).alias("tokens"),
        F.count_if(placed & (F.col("kind") == "fact")).alias("facts"), F.count_if(placed & (F.col("kind") == "thread")).alias("threads"),
        F.count_if(F.col("kind") == "excerpt").alias("excerpt_offered"), F.count_if(placed & (F.col("kind") == "excerpt")).alias("excerpt_placed"))


def mode_summary(cases: DataFrame) -> DataFrame:
    """Per mode of an evaluation: gold reached, stale cases, irrelevant packets, mean tokens."""
    return cases.groupBy("mode").agg(
        F.count_if("gold_reached").alias("gold"), F.count(F.lit(1)).alias("cases"), F.count_if("stale").alias("stale"),
        F.count_if("irrelevant").alias("irrelevant"), F.avg("tokens").alias("mean_tokens"))


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def canon_coverage(wanted: DataFrame, read: DataFrame, queued: DataFrame) -> DataFrame:
    """Per conversation: setting texts wanted, read, queued, and characters not read yet."""
    rows = wanted.join(read.select("hash").distinct().withColumn("_r", F.lit(True)), "hash", "left").join(queued.select("hash").distinct().withColumn("_q", F.lit(True)), "hash", "left")
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("_r").isNotNull()).alias("read"), F.count_if(F.col("_q").isNotNull()).alias("queued"),
        F.sum(F.when(F.col("_r").isNull(), F.col("chars")).otherwise(0)).alias("unread_chars"))


def turn_uses(traces: DataFrame) -> DataFrame:
    """(conv_id, ref, offered, placed): how often each source was offered and placed; traces have lines array<struct>."""
    lines = traces.select("conv_id", F.explode("lines").alias("l"))
    return lines.groupBy("conv_id", F.col("l.ref").alias("ref")).agg(F.count(F.lit(1)).alias("offered"), F.count_if("l.placed").alias("placed"))
