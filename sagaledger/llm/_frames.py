"""Small helpers around DataFrames: the columns an operator reads, shared files, joins with groups, folds, bounded samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names, or the checkpoint folder of the context.

    On one machine any folder is shared, so a local session without a setting gets one below its warehouse; on a cluster
    there is no folder to guess, and the setting's absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    made = sc._jsc.sc().getCheckpointDir()
    if not named:
        if made.isDefined():
            return made.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not made.isDefined():
        sc.setCheckpointDir(named)
    return named


#: Rows in a batch that goes to Python and back.
BATCH_ROWS = 1000


def in_batches(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches set to BATCH_ROWS rows where they are larger.

    The setting counts rows and knows nothing of their size; whole texts by 10,000 rows are tens of megabytes at a time in each
    of several buffers, on both sides of the pipe.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(docs.sparkSession.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        docs.sparkSession.conf.set(name, str(BATCH_ROWS))
    return docs


#: Paths of stored tables that have not been discarded.
_standing: set[str] = set()


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """The rows written to the shared folder and read back, which cuts the lineage.

    A reader of the result never runs what made it again, and a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _standing.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # type: ignore[attr-defined]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    _standing.discard(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(df: DataFrame) -> None:
    """Delete the files of stored(), once nothing reads them."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete every stored table that still stands.  Results that read them are gone then, so write those first."""
    for path in sorted(_standing):
        _delete(spark, path)


#: A key is hot if it has more than one in HOT of all rows and more than HOT_ROWS; there are fewer hot keys than HOT.
HOT, HOT_ROWS = 10_000, 1_000


def joined_by_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined with groups, which has one row for each key; its column named size says how many of the rows have that key.

    The groups of hot keys are fewer than HOT, so they are broadcast and their rows stay where they are.  All others meet in a
    shuffle, in which no key has more than one in HOT of the rows, or HOT_ROWS.  groups is read several times and should be
    stored.
    """
    seen = groups.agg(F.sum(size).alias("n"), F.max(size).alias("most")).first()
    bar = max((seen["n"] or 0) / HOT, HOT_ROWS)
    if (seen["most"] or 0) <= bar:
        return rows.join(groups, keys)
    hot = F.broadcast(groups.filter(F.col(size) > bar))
    few = rows.join(hot.select(*keys), keys, "left_anti").join(groups.filter(F.col(size) <= bar), keys)
    return rows.join(hot, keys).unionByName(few)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null where the id is null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


#: Bytes of text that a sample holds of each class at most, and a text in it.
SAMPLE_BYTES, SAMPLE_TEXT_BYTES = 32 << 20, 2 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, allowed: Column, per_class: int) -> DataFrame:
    """(doc_id, text, target) of at most per_class training rows of each class, chosen by a hash of the id.

    allowed says, in terms of doc_id, which rows may be learned from.  The chosen ids number 2 * per_class at most, so the
    join broadcasts them; the texts come from one filtered scan.  Null ids, null targets and other targets are left out, and
    so are texts of more than SAMPLE_TEXT_BYTES and what goes beyond SAMPLE_BYTES of a class, so that a sample fits the driver.
    """
    rows = labels.select(labels["doc_id"].alias("doc_id"), labels[target].cast("int").alias("target"))
    rows = rows.filter(allowed & F.col("doc_id").isNotNull() & F.col("target").isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.max("target").alias("target"))
    picked = [rows.filter(F.col("target") == y).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    got = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "target")
    size = F.octet_length("text")
    upto = Window.partitionBy("target").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    got = got.filter(size <= SAMPLE_TEXT_BYTES).withColumn("_bytes", F.sum(size).over(upto))
    return got.filter(F.col("_bytes") <= SAMPLE_BYTES).drop("_bytes")


def unused_name(df: DataFrame, name: str) -> str:
    """A column name like the given one that df does not have, whatever case Spark compares names in."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
