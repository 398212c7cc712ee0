"""Continuous forms: manifests into a ledger, acceptance as messages come, windowed counts of timed events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ledger


#: Folders that a ledger is dealt into by conversation.  Fixed when a ledger is begun, for its rows lie where it put them.
BUCKETS = 256


def _bucket() -> Column:
    return F.pmod(F.xxhash64("conv_id"), F.lit(BUCKETS)).cast("int")


def ledger_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the manifest rows of a batch which the ledger does not have.

    The ledger's rows are immutable and carry their hash, so a batch that is run again adds nothing.  The ledger lies in
    buckets of conversations, and of it a batch reads only the buckets that it touches: BUCKETS numbers at most come to the
    driver to say which.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = ledger.manifest_rows(ledger.newest_manifest(ledger.idempotent(batch))).withColumn("bucket", _bucket())
        touched = [r.bucket for r in batch.select(_bucket().alias("bucket")).distinct().collect()]
        try:
            known = batch.sparkSession.read.parquet(path).filter(F.col("bucket").isin(touched)).select("bucket", "conv_id", "object_id", "rev_hash")
            rows = rows.join(known, ["bucket", "conv_id", "object_id", "rev_hash"], "left_anti")
        except Exception as error:  # the first batch has no ledger yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        rows.withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy("bucket").parquet(path)

    return write


def ingest(manifests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return manifests.writeStream.foreachBatch(ledger_sink(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ACCEPTED = "conv_id string, position int, accepted string"


def _accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emit every message when it is certain: a user's at once, a reply when a user message follows it."""
    waiting = list(state.get[0]) if state.exists else []
    out: list[tuple] = []
    for row in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.position):
        if row.role == "user":
            out += [(key[0], p, "accepted") for p in waiting if p < row.position] + [(key[0], row.position, "accepted")]
            waiting = [p for p in waiting if p > row.position]
        else:
            waiting.append(row.position)
    state.update((waiting,))
    yield pd.DataFrame(out, columns=["conv_id", "position", "accepted"])


def acceptance(messages: DataFrame) -> DataFrame:
    """A stream of accepted messages from a stream of messages (conv_id string, position int, role)."""
    return messages.groupBy("conv_id").applyInPandasWithState(_accept, ACCEPTED, "waiting array<int>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events per type and tumbling window of event time; a window closes when the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time with a zone
    return timed.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def newly_eligible(before: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """What a batch has made eligible: the difference of two states of the head."""
    return now.join(before, by, "left_anti")
