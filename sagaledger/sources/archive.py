"""A portable archive of tables: JSON lines in a total order, a manifest with counts and checksums, and its check; and a store
whose tables an archive replaces all at once.

Spark writes and reads all files, so an archive can lie in any store that Spark reaches.  A table is cut into files by ranges of
its key.  Each file has its SHA-256, and the table that of its files' hashes in order, so two swapped rows are noticed as well
as two swapped files, and a file that differs can be named.  What comes to the driver is one hash a file.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that must not stand in an archive as keys of settings (fixed values).
CREDENTIALS = ("api_key", "apikey", "authorization", "password", "access_token")
#: Lines of a file at most, so that one file's bytes fit a task.
FILE_LINES = 500_000


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of the files of a written table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def _digest(files: DataFrame) -> str:
    """The hash of the files' hashes, in the order of their names, which is the order of the table's key."""
    names = F.array_sort(F.collect_list(F.struct("file", "sha256")))
    return files.agg(F.sha2(F.array_join(F.transform(names, lambda f: F.concat_ws(":", F.regexp_extract(f["file"], r"part-(\d+)", 1), f["sha256"])), "\n"), 256)).first()[0]


def write_archive(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]]) -> dict:
    """Write every table as lines of JSON, sorted by its key, and a manifest; refuses rows that carry credentials."""
    manifest = {"version": 2, "tables": {}}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        lines = df.sort(*keys[name]).select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
        bad = lines.filter(F.arrays_overlap(F.json_object_keys("value"), F.array(*map(F.lit, CREDENTIALS)))).limit(1).count()
        if bad:
            raise ValueError(f"{name} has credentials in it")
        lines.write.mode("errorifexists").option("maxRecordsPerFile", FILE_LINES).text(f"{path}/{name}")
        files = file_hashes(spark, f"{path}/{name}")
        files.select(F.to_json(F.struct("file", "sha256")).alias("value")).coalesce(1).write.mode("errorifexists").text(f"{path}/_hashes/{name}")
        manifest["tables"][name] = {"rows": spark.read.text(f"{path}/{name}").count(), "checksum": _digest(files), "schema": df.schema.json()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return manifest


def differing(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, told, found): files of a table that are not what was written, that are gone, or that came."""
    told = spark.read.schema("file string, sha256 string").json(f"{path}/_hashes/{name}").withColumnRenamed("sha256", "told")
    return told.join(file_hashes(spark, f"{path}/{name}").withColumnRenamed("sha256", "found"), "file", "full").filter(~F.col("told").eqNullSafe(F.col("found")))


def read_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an archive whose files are as the manifest says; ValueError otherwise."""
    from pyspark.sql.types import StructType

    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    out = {}
    for name, told in manifest["tables"].items():
        if _digest(file_hashes(spark, f"{path}/{name}")) != told["checksum"] or spark.read.text(f"{path}/{name}").count() != told["rows"]:
            raise ValueError(f"{name} differs from the manifest")
        out[name] = spark.read.schema(StructType.fromJson(json.loads(told["schema"]))).json(f"{path}/{name}")
    return out


def dangling(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]]) -> DataFrame:
    """(child, column, rows): references (child, column, parent, key) that the archive does not hold itself."""
    out = None
    for child, column, parent, key in references:
        lost = tables[child].filter(F.col(column).isNotNull()).join(tables[parent].select(F.col(key).alias(column)).distinct(), column, "left_anti")
        part = lost.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(child).alias("child"), F.lit(column).alias("column"), "rows")
        out = part if out is None else out.unionByName(part)
    return out.filter("rows > 0")


def restored(current: dict[str, DataFrame], archive: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """current with every conversation that the archive has replaced by the archive's."""
    ids = archive["conversation"].select("conv_id").distinct()
    return {name: df.join(ids, "conv_id", "left_anti").unionByName(archive[name].select(*df.columns)) for name, df in current.items()}


# ---------------------------------------------------------------- a store of generations

#: Generations of a store that stay.
KEPT = 2


def _generations(spark: SparkSession, target: str) -> list[int]:
    """The generations of a store that were finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v-*/finished/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getParent().getName()[2:]) for f in found)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stored_tables(spark: SparkSession, target: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a store's newest finished generation."""
    newest = _generations(spark, target)[-1]
    return {name: spark.read.parquet(f"{target}/v-{newest:08d}/{name}") for name in names}


def swap_in(spark: SparkSession, target: str, tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]]) -> int:
    """Put tables in a store's place, all at once or not at all; the number of the new generation.

    They are written beside what is there, read back and checked: as many rows as were given, and no reference that leads
    nowhere.  Only then a mark says that the generation is finished, which is what readers look for; a run that is lost before
    leaves what was there.  Generations before the last KEPT go.
    """
    done = _generations(spark, target)
    number = (done[-1] if done else 0) + 1
    place = f"{target}/v-{number:08d}"
    _delete(spark, place)  # what a lost run may have left
    try:
        for name, df in tables.items():
            df.write.parquet(f"{place}/{name}")
        back = {name: spark.read.parquet(f"{place}/{name}") for name in tables}
        for name, df in tables.items():
            if back[name].count() != df.count():
                raise ValueError(f"{name} was not written whole")
        lost = dangling(back, references).collect() if references else []
        if lost:
            raise ValueError("; ".join(f"{r.rows} rows of {r.child} have a {r.column} that is nowhere" for r in lost))
    except Exception:
        _delete(spark, place)
        raise
    spark.createDataFrame([(number,)], "generation int").coalesce(1).write.json(f"{place}/finished")
    for old in done[: max(0, len(done) + 1 - KEPT)]:
        _delete(spark, f"{target}/v-{old:08d}")
    return number
