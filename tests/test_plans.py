"""The medallion plan, the read queries and the streams, end to end."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lineage
from tidemark.operators import sketches
from tidemark.plans import medallion, serving
from tidemark.sources import feeds
from tidemark.sources.tables import flows, indicators
from tidemark.streaming import replay, windows

SF = "/root/testdata/sf0.001"


def test_medallion_and_api(spark, tmp_path):
    root = str(tmp_path)
    logs = flows(spark, SF)
    assert serving.Api(spark, root).attacks() is None
    medallion.run(spark, logs, indicators(spark, SF), root)
    api = serving.Api(spark, root)
    n = logs.count()
    assert sum(r["count"] for r in api.attacks().collect()) == n == api.summary().first().total_flow_logs and len(api.summary().columns) == 20
    assert api.ports().count() and api.geo().count() and api.clusters(10).count() == 10 and api.stream().count() == 12
    assert api.check_ip(" 10.0.0.0 ").first().listed and not api.check_ip("9.9.9.9").first().listed
    assert feeds.read_parquet(spark, f"{root}/silver/logs", ["Label"]).columns == ["Label"]
    assert api.attacks() is api.attacks() and api.attacks().storageLevel.useMemory
    api.refresh()
    assert sorted(medallion.gold_tables(logs.drop("is_attack"))) == ["attacks_by_type", "hourly_attacks"]
    assert len(medallion.gold_tables(logs)) == 5 and not medallion.gold_tables(logs.select("row_id"))
    sizes = medallion.formats(logs.select("Label", "Flow_Duration", "Src_IP"), f"{root}/formats")
    assert sizes["csv"]["bytes"] > sizes["parquet"]["bytes"] > 0


def test_indicator_filter(spark):
    listed = indicators(spark, SF)
    f = serving.IndicatorFilter(listed)
    for r in listed.filter("ioc_type IN ('ip', 'ip:port')").collect():
        assert f.maybe(f" {r.ip_address} ")
    assert sum(f.maybe(f"clean{i}") for i in range(2000)) < 60 and f.memory_bytes == -(-f.bits // 8)


def test_readers(spark, tmp_path):
    path = str(tmp_path / "feed.csv")
    with open(path, "w") as f:
        f.write('# a comment\n"x","1.2.3.4","fam"\nlonely\n\n"y","5.6.7.8"\n')
    assert [tuple(r) for r in feeds.read_feed(spark, path).collect()] == [("1.2.3.4", "fam"), ("5.6.7.8", "unknown")]
    doc = str(tmp_path / "d.json")
    with open(doc, "w") as f:
        json.dump({"a": 1, "b": [1, 2]}, f, indent=1)
    assert feeds.read_json(spark, doc).first().a == 1
    csv = str(tmp_path / "csv")
    feeds.write_csv(spark.range(3).select(F.col("id").alias("row_id"), *(F.lit(None).cast(x.dataType).alias(x.name) for x in feeds.FLOW_SCHEMA[1:])), csv)
    assert feeds.read_flows_csv(spark, csv, ["row_id"]).count() == 3 and feeds.read_flows_csv(spark, csv).schema == feeds.FLOW_SCHEMA


def test_replay_keeps_sketches(spark, tmp_path):
    logs = flows(spark, SF).select("row_id", "Src_IP", "is_attack", F.lit(1).alias("k"))
    src = str(tmp_path / "src")
    feeds.replay_files(logs, src, 4, "row_id")
    w, depth = sketches.cms_size(0.01, 0.1)
    live = replay.LiveSketches(str(tmp_path / "live"), "Src_IP", w, depth, 2000, 4, 50)
    stream = replay.replay(spark, src, logs.schema)
    assert stream.isStreaming and "stream_timestamp" in stream.columns
    live.start(stream.drop("stream_timestamp"), str(tmp_path / "cp")).awaitTermination(120)
    last = max(int(x) for x in os.listdir(tmp_path / "live" / "cms"))
    assert sorted(map(tuple, spark.read.parquet(live.path("cms", last)).collect())) == sorted(map(tuple, sketches.cms_build(logs, "Src_IP", w, depth).collect()))
    assert sorted(map(tuple, spark.read.parquet(live.path("fm", last)).collect())) == sorted(map(tuple, sketches.fm_registers(logs, "Src_IP").collect()))
    assert spark.read.parquet(live.path("bloom", last)).count() == sketches.bloom_build(logs, "Src_IP", 2000, 4).count()
    assert spark.read.parquet(live.path("reservoir", last)).count() == 50


def test_stateful_window(spark, tmp_path):
    logs = flows(spark, SF).select("row_id", "is_attack", F.lit("all").alias("k"))
    src = str(tmp_path / "src")
    logs.coalesce(1).write.json(src)
    stream = spark.readStream.schema(logs.schema).json(src)
    out = replay.dgim_stream(stream, "k", "row_id", "is_attack", 200)
    q = out.writeStream.format("memory").queryName("dgim_out").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("dgim_out").orderBy(F.desc("time")).first()
    exact = sum(r.is_attack for r in logs.orderBy(F.desc("row_id")).limit(200).collect())
    assert got.time == logs.count() and abs(got.estimate - exact) <= 0.5 * exact


def test_windows_of_a_stream(spark, tmp_path):
    logs = flows(spark, SF).select(F.col("ts").cast("timestamp").alias("ts"), "Label", "Packet_Length_Mean", "is_attack")
    src = str(tmp_path / "src")
    logs.coalesce(2).write.parquet(src)
    stream = spark.readStream.schema(logs.schema).parquet(src).withWatermark("ts", "10 minutes")
    q = windows.tumbling(stream, "ts", "1 hour", "Label", "Packet_Length_Mean").writeStream.format("memory").queryName("tumbling_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = windows.tumbling(logs, "ts", "1 hour", "Label", "Packet_Length_Mean")
    assert sorted(map(str, spark.table("tumbling_out").collect())) == sorted(map(str, batch.collect()))
    out = str(tmp_path / "json")
    replay.to_json(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.json(out).count() == logs.count()


def test_feed_falls_back(spark):
    other = spark.createDataFrame([("1.2.3.4", "made")], "ip string, family string")
    assert feeds.fetch_feed(spark, "http://127.0.0.1:9/none.csv", 0.2, other) is other


def test_replay_of_some_events(spark, tmp_path):
    logs = flows(spark, SF).select("row_id", "Label")
    feeds.replay_files(logs, str(tmp_path / "src"), 3, "row_id", max_events=40)
    q = replay.to_json(replay.replay(spark, str(tmp_path / "src"), logs.schema), str(tmp_path / "out"), str(tmp_path / "cp"), every="1 second")
    for _ in range(60):
        q.processAllAvailable()
        if os.path.isdir(tmp_path / "out") and spark.read.schema(logs.schema).json(str(tmp_path / "out")).count() == 40:
            break
    q.stop()
    assert spark.read.schema(logs.schema).json(str(tmp_path / "out")).distinct().count() == 40


def test_late_events_are_dropped(spark, tmp_path):
    schema, src = "ts timestamp, k string", tmp_path / "src"
    src.mkdir()
    for i, rows in enumerate([["2024-01-01 10:00:00", "2024-01-01 10:05:00"], ["2024-01-01 14:00:00"], ["2024-01-01 14:00:30"], ["2024-01-01 10:06:00", "2024-01-01 14:01:00"], ["2024-01-01 18:00:00"]]):
        (src / f"{i}.json").write_text("".join(json.dumps({"ts": t, "k": "a"}) + "\n" for t in rows))
        os.utime(src / f"{i}.json", (1000 + i, 1000 + i))
    stream = windows.on_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), "ts", "30 minutes")
    out = stream.groupBy(F.window("ts", "1 hour"), "k").count()
    q = out.writeStream.format("memory").queryName("late_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.window.start.hour, r["count"]) for r in spark.table("late_out").collect()) == [(10, 2), (14, 3)]


def test_streams_are_joined(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for folder, rows in ((a, [("x", "2024-01-01 10:00:00", 1), ("y", "2024-01-01 10:00:00", 2)]), (b, [("x", "2024-01-01 10:04:00", 10), ("x", "2024-01-01 10:20:00", 11), ("x", "2024-01-01 09:59:00", 12), ("y", "2024-01-01 10:05:00", 13)])):
        folder.mkdir()
        (folder / "0.json").write_text("".join(json.dumps({"k": k, ("ts" if folder == a else "seen"): t, ("n" if folder == a else "m"): n}) + "\n" for k, t, n in rows))
    left = windows.on_time(spark.readStream.schema("k string, ts timestamp, n int").json(str(a)), "ts", "1 hour")
    right = windows.on_time(spark.readStream.schema("k string, seen timestamp, m int").json(str(b)), "seen", "1 hour")
    q = windows.joined(left, right, "k", "ts", "seen", "5 minutes").writeStream.format("memory").queryName("joined_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.n, r.m) for r in spark.table("joined_out").collect()) == [(1, 10), (2, 13)]


def test_settled_tables_need_a_shared_folder_and_go(spark, tmp_path, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session())
    monkeypatch.setattr(lineage, "shared_dir", lambda s: str(tmp_path / "own"))
    assert lineage.settle(spark.range(3), "three").count() == 3 and lineage.cleared(spark) and not lineage.cleared(spark)
