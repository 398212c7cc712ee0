import json

import pytest
from pyspark.sql import functions as F

from sagaledger.operators import ledger
from sagaledger.sources import archive, tables
from sagaledger.streaming import ingest


def test_archive_round_trip_and_tampering(spark, tmp_path):
    made = {"conversation": spark.createDataFrame([("c", "x"), ("d", "y")], "conv_id string, label string"), "message": spark.createDataFrame([("c", 1, "hi\nthere"), ("e", 2, "lost")], "conv_id string, n int, text string")}
    path = str(tmp_path / "a")
    archive.write_archive(made, path, {"conversation": ["conv_id"], "message": ["conv_id", "n"]})
    back = archive.read_archive(spark, path)
    assert {k: sorted(map(tuple, v.collect())) for k, v in back.items()} == {k: sorted(map(tuple, v.collect())) for k, v in made.items()}
    assert [(r.child, r.rows) for r in archive.dangling(back, [("message", "conv_id", "conversation", "conv_id")]).collect()] == [("message", 1)]
    with pytest.raises(ValueError):
        archive.write_archive({"t": spark.createDataFrame([("k",)], "password string")}, str(tmp_path / "b"), {"t": ["password"]})
    spark.createDataFrame([("{}",)], "value string").write.mode("append").text(f"{path}/message")
    with pytest.raises(ValueError):
        archive.read_archive(spark, path)


def manifest(conv, key, at, entries):
    return json.dumps({"conv_id": conv, "observed_at": at, "idempotency_key": key, "entries": [{"object_id": o, "rev_hash": h} for o, h in entries]})


def test_streamed_ledger_equals_batch_and_replays_add_nothing(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "ledger")
    source.mkdir()
    (source / "1.json").write_text("\n".join([manifest("c", "k1", "2024-01-01T00:00:00", [("a", "1"), ("b", "2")]), manifest("c", "k1", "2024-01-01T00:00:00", [("a", "1"), ("b", "2")])]))
    stream = lambda: spark.readStream.schema(tables.MANIFEST).json(str(source))
    ingest.ingest(stream(), out, str(tmp_path / "cp")).awaitTermination(60)
    (source / "2.json").write_text(manifest("c", "k2", "2024-01-02T00:00:00", [("a", "1"), ("b", "3"), ("d", "4")]))
    ingest.ingest(stream(), out, str(tmp_path / "cp")).awaitTermination(60)
    rows = {(r.object_id, r.rev_hash) for r in spark.read.parquet(out).collect()}
    assert rows == {("a", "1"), ("b", "2"), ("b", "3"), ("d", "4")} and spark.read.parquet(out).count() == 4
    ingest.ledger_sink(out)(tables.manifests(spark, str(source)), 9)
    assert spark.read.parquet(out).count() == 4


def test_streamed_acceptance_equals_batch(spark, tmp_path):
    rows = [("c", i, "user" if i in (1, 4) else "char") for i in range(6)] + [("d", 0, "char"), ("d", 1, "user")]
    src = tmp_path / "m"
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "conv_id string, position int, role string").coalesce(1).write.parquet(str(src / f"b{k}"))
    stream = spark.readStream.schema("conv_id string, position int, role string").option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = ingest.acceptance(stream).writeStream.format("memory").queryName("accepted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(r.conv_id, r.position) for r in spark.table("accepted").collect()}
    members = spark.createDataFrame([(*r, None, False) for r in rows], "conv_id string, position int, role string, disabled string, is_comment boolean")
    want = {(r.conv_id, r.position) for r in ledger.with_lifecycle(members).filter("accepted = 'accepted'").collect()}
    assert got == want


def test_windowed_counts_close_with_the_watermark(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = ingest.windowed_counts(stream, "1 day").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(r.start, r.event_type): r.n for r in spark.table("windows").collect()}
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"), "event_type").count().collect()
    assert got == {(r["start"], r.event_type): r["count"] for r in want}


def test_swapped_rows_and_swapped_files_are_noticed(spark, tmp_path, monkeypatch):
    import glob
    import os

    monkeypatch.setattr(archive, "FILE_LINES", 60)
    rows = spark.range(200).selectExpr("id", "concat('row ', id) AS text").repartition(4)
    for change in ("rows", "files", "none"):
        path = str(tmp_path / change)
        archive.write_archive({"t": rows}, path, {"t": ["id"]})
        parts = sorted(f for f in glob.glob(f"{path}/t/part-*") if os.path.getsize(f))
        for crc in glob.glob(f"{path}/t/.*.crc"):
            os.remove(crc)
        if change == "rows":
            lines = open(parts[0]).read().splitlines()
            lines[1], lines[2] = lines[2], lines[1]
            open(parts[0], "w").write("\n".join(lines) + "\n")
        if change == "files":
            os.rename(parts[0], path + "/x")
            os.rename(parts[-1], parts[0])
            os.rename(path + "/x", parts[-1])
        if change == "none":
            assert archive.read_archive(spark, path)["t"].count() == 200 and archive.differing(spark, path, "t").count() == 0
            continue
        with pytest.raises(ValueError, match="differs"):
            archive.read_archive(spark, path)
        assert {r.file for r in archive.differing(spark, path, "t").collect()} == {os.path.basename(f) for f in ([parts[0]] if change == "rows" else [parts[0], parts[-1]])}


def test_a_store_is_swapped_whole_or_not_at_all(spark, tmp_path):
    target, refs = str(tmp_path / "store"), [("message", "conv_id", "conversation", "conv_id")]
    make = lambda n, orphans=0: {"conversation": spark.range(n).selectExpr("id AS conv_id"), "message": spark.range(n + orphans).selectExpr("id AS conv_id", "id * 2 AS n")}
    assert archive.swap_in(spark, target, make(3), refs) == 1
    with pytest.raises(ValueError, match="2 rows of message"):
        archive.swap_in(spark, target, make(5, 2), refs)
    assert archive.stored_tables(spark, target, ["message"])["message"].count() == 3
    assert [archive.swap_in(spark, target, make(n), refs) for n in (4, 5)] == [2, 3]
    assert archive.stored_tables(spark, target, ["message"])["message"].count() == 5
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["v-00000002", "v-00000003"]
