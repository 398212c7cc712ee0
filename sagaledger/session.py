"""A Spark session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: If true, which is Spark's default, a union of rows that are dealt by the same key counts as dealt by it, and no shuffle comes
#: between it and what needs a key's rows together.  Adaptive execution then merges small partitions of each side on its own, so a
#: key's rows are no longer in one task and every window, group and fold over such a union is wrong.
WHOLE_UNIONS = "spark.sql.unionOutputPartitioning"


def session(name: str = "sagaledger", master: str | None = None, **conf: str) -> SparkSession:
    """UTC timestamps, adaptive execution with skew joins, Arrow transfer; other settings as given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        WHOLE_UNIONS: "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def dealt_again(spark: SparkSession) -> SparkSession:
    """The session, in which the rows of a union are dealt again before their keys are put together."""
    spark.conf.set(WHOLE_UNIONS, "false")
    return spark


def held(rows: DataFrame) -> DataFrame:
    """The rows computed once, checkpointed in the folder that driver and executors share: what spark.checkpoint.dir names, or
    the context's checkpoint folder.  A local session without either gets a folder below its warehouse."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return rows.checkpoint()
