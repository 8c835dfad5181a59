"""Readers and writers over real files."""

from contrapair.sources import readers, writers
from contrapair.streaming import activity, resumable


def test_discovery_reads_names_only(spark, tmp_path):
    for n in ("cam_M1_0_0012.jpg", "cam_M1_1_0003.jpg", "notes.txt"):
        (tmp_path / n).write_bytes(b"x")
    df = readers.discover_files(spark, str(tmp_path), [("camera", r"cam_(\d|M\d+)_(\d)_(\d+)\.jpg$")])
    assert sorted((r["instance"], r["model"], r["shot"]) for r in df.collect()) == [("M1", "0", 12), ("M1", "1", 3)]
    assert "content" not in df.columns


def test_device_codes_stay_text(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("tag,gen_idx,K,rho\na,1,1101,0.5\na,2,0042,NaN\n")
    rows = readers.read_measurements(spark, str(p)).orderBy("gen_idx").collect()
    assert [r["K"] for r in rows] == ["1101", "0042"]
    assert readers.read_measurements(spark, str(tmp_path / "absent.csv")) is None


def test_logs_and_documents(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.log").write_text("[01:02:03] t 200/16000 loss 0.25\nhello\n")
    assert [(r["job"], r["step"], r["total"], r["loss"]) for r in readers.read_log(spark, str(tmp_path / "log")).collect()] == [("t", 200, 16000, 0.25)]
    df = spark.createDataFrame([("x", 1.5)], "name string, v double")
    writers.write_documents(df, str(tmp_path / "out"))
    assert readers.read_documents(spark, str(tmp_path / "out"), "name string, v double").first()["v"] == 1.5


def test_replayed_batch_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("t", 1, 0.5), ("t", 1, 0.5), ("t", 2, 0.1)], "tag string, gen_idx bigint, rho double")
    sink = resumable.append_new(str(tmp_path / "table"), ["tag", "gen_idx"], "tag")
    sink(df, 0)
    sink(df, 0)
    sink(spark.createDataFrame([("u", 1, 0.7), ("t", 2, 0.9)], df.schema), 1)
    got = sorted((r["tag"], r["gen_idx"], r["rho"]) for r in spark.read.parquet(str(tmp_path / "table")).collect())
    assert got == [("t", 1, 0.5), ("t", 2, 0.1), ("u", 1, 0.7)]


def test_closed_sessions_are_appended(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("j", "2024-01-01 00:00:00"), ("j", "2024-01-01 00:05:00"), ("j", "2024-01-01 02:00:00"), ("k", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "job string, t string").selectExpr("job", "cast(t as timestamp) ts").coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema("job string, ts timestamp").parquet(str(src))
    out = activity.activity_sessions(s, "job", "ts", "600 seconds", "1 hour")
    activity.start_activity(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r["job"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("j", 1), ("j", 2)]
