from __future__ import annotations

import json

from pyspark.sql import functions as F

from matchlake.sources import logs
from matchlake.streaming import sessions


def put(root, name, value):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(value if isinstance(value, bytes) else (value if isinstance(value, str) else json.dumps(value)).encode())


def test_logs(spark, tmp_path):
    put(tmp_path, "a/status.json", {"fps": 30.0, "rallies": [{"rally_index": 0, "start_frame": 1, "end_frame": 9}, {"rally_index": 1, "start_frame": 20, "end_frame": 30}]})
    put(tmp_path, "b/status.json", {"fps": 25.0, "rallies": []})
    assert [(r["job_id"], r["position"], r["end_frame"]) for r in logs.rallies(spark, f"{tmp_path}/*/status.json").orderBy("position").collect()] == [("a", 0, 9), ("a", 1, 30)]
    assert logs.rallies(spark, f"{tmp_path}/*/none.json").count() == 0
    put(tmp_path, "a/raw.json", [{"frame_idx": 1}])
    put(tmp_path, "a/grouped.json", [{"frame_idx": 2}, {"frame_idx": 3}])
    put(tmp_path, "b/raw.json", [{"frame_idx": 4}])
    got = logs.actions(spark, f"{tmp_path}/*/grouped.json", f"{tmp_path}/*/raw.json")
    assert sorted((r["job_id"], r["frame_idx"]) for r in got.collect()) == [("a", 2), ("a", 3), ("b", 4)]
    put(tmp_path, "a/positions.json", [{"frame_idx": 1, "players": [{"stable_id": 7, "court": [1.0, 2.0], "court_ground": []}, {"stable_id": 8}]}])
    assert sorted((r["stable_id"], r["ground"]) for r in logs.positions(spark, f"{tmp_path}/*/positions.json").collect()) == [(7, [1.0, 2.0]), (8, None)]
    put(tmp_path, "a/names.json", {"7": " Ann ", "8": "  "})
    assert [tuple(r) for r in logs.names(spark, f"{tmp_path}/*/names.json").collect()] == [("a", 7, "Ann")]
    put(tmp_path, "a/ignored.json", [3, 3, 5])
    assert sorted(r["stable_id"] for r in logs.ignored(spark, f"{tmp_path}/*/ignored.json").collect()) == [3, 5]
    put(tmp_path, "a/job.json", {"id": "a", "status": "complete"})
    put(tmp_path, "b/job.json", {"id": "b", "status": "processing"})
    put(tmp_path, "c/job.json", "{broken")
    assert sorted((r["id"], r["status"], r["error"]) for r in logs.jobs(spark, f"{tmp_path}/*/job.json").collect()) == [("a", "complete", None), ("b", "error", "interrupted")]


def test_text_and_xml(spark, tmp_path):
    put(tmp_path, "v/ann.txt", '3 1 2 3 4 17 0 0 1 "big spike"\n1 2 3\n')
    (row,) = logs.annotations(spark, f"{tmp_path}/v/ann.txt").collect()
    assert (row["track_id"], row["box"], row["frame_id"], row["generated"], row["label"]) == (3, [1, 2, 3, 4], 17, True, "big spike")
    put(tmp_path, "l/x.txt", "2 0.1 0.2 0.3 0.4\n5 0 0 1 1\n2 0.5\n")
    assert [(r["class"], r["values"]) for r in logs.boxes(spark, f"{tmp_path}/l/*.txt", {2: 0}).collect()] == [(0, [0.1, 0.2, 0.3, 0.4])]
    put(tmp_path, "t.xml", '<annotations><image id="1"><tag label="Play"/><tag label="x"/></image><image id="2"/><image id="3"><tag label="odd"/></image></annotations>')
    assert sorted(tuple(r) for r in logs.image_tags(spark, f"{tmp_path}/t.xml", {"Play": "play"}).collect()) == [(1, "play", True), (3, "odd", False)]


def test_video_dates(spark, tmp_path):
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    put(tmp_path, "m/a.mp4", box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", b"\0\0\0\0" + (86_400).to_bytes(4, "big") + b"\0" * 12)))
    put(tmp_path, "m/b.mp4", b"nothing")
    got = {r["path"].rsplit("/", 1)[1]: str(r["created"]) for r in logs.video_dates(spark, f"{tmp_path}/m/*.mp4").collect()}
    assert got == {"a.mp4": "1904-01-02 00:00:00", "b.mp4": "None"}


def test_defaults_and_truth(spark):
    df = spark.createDataFrame([({"a": None},), (None,)], "s map<string,string>")
    assert [r[0] for r in df.select(logs.with_defaults(F.col("s"), {"a": "1", "b": "2"})).collect()] == [{"b": "2", "a": None}, {"a": "1", "b": "2"}]
    rows = spark.createDataFrame([(1, True, 10.0, 20.0, 4.0, 2.0), (3, False, 1.0, 1.0, 1.0, 1.0)], "frame long, enabled boolean, x double, y double, width double, height double")
    assert [tuple(r) for r in logs.ground_truth(rows, 3).orderBy("frame").collect()] == [(1, True, 12.0, 21.0), (2, False, None, None), (3, False, None, None)]


def test_stale_views(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, signature long")
    built = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "job_id string, signature long")
    assert sorted(r[0] for r in logs.stale(now, built).collect()) == ["b", "c"]


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select((F.col("user_id") % 5).alias("game"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    e.write.parquet(f"{tmp_path}/in")
    end = spark.createDataFrame([(99, "2100-01-01")], "game long, t string").select("game", F.col("t").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("event_id"))
    end.write.mode("append").parquet(f"{tmp_path}/late")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = sessions.rally_windows(stream, ["game"], "ts").writeStream.format("memory").queryName("rallies_seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    whole = sessions.rally_windows(e, ["game"], "ts")
    seen, want = {tuple(r) for r in spark.table("rallies_seen").collect()}, {tuple(r) for r in whole.collect()}
    assert seen <= want and len(seen) > 0.8 * len(want)
    w = e.select("game", F.col("event_id").alias("n"), F.when(F.col("event_id") % 3 == 0, "A").otherwise("B").alias("winner"))
    w.write.parquet(f"{tmp_path}/w")
    q = sessions.momentum(spark.readStream.schema(w.schema).parquet(f"{tmp_path}/w"), "game", "n", "winner", "A", "B").writeStream.format("memory").queryName("momentum_seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination()
    from matchlake.operators import ordered

    want = ordered.running_differential(w, ["game"], ["n"], F.col("winner") == "A", F.col("winner") == "B").select("game", "n", "momentum")
    assert sorted(tuple(r) for r in spark.table("momentum_seen").collect()) == sorted(tuple(r) for r in want.collect())


def test_logs_of_other_jobs_stay(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "job_id string, x long")
    logs.write_log(rows(("a", 1), ("b", 2)), f"{tmp_path}/log")
    logs.write_log(rows(("b", 3)), f"{tmp_path}/log")
    assert sorted((r["job_id"], r["x"]) for r in spark.read.json(f"{tmp_path}/log").collect()) == [("a", 1), ("b", 3)]


def test_refresh_builds_what_changed(spark, tmp_path):
    asked = []

    def build(jobs):
        asked.append(sorted(r[0] for r in jobs.select("job_id").collect()))
        return jobs.select("job_id", (F.col("signature") * 10).alias("v"))

    now = lambda *r: spark.createDataFrame(list(r), "job_id string, signature long")
    run = lambda *r: sorted((x["job_id"], x["v"]) for x in logs.refresh(now(*r), f"{tmp_path}/view", f"{tmp_path}/built", build).collect())
    assert run(("1", 5), ("b", 6)) == [("1", 50), ("b", 60)]
    assert run(("1", 5), ("b", 7), ("c", 8)) == [("1", 50), ("b", 70), ("c", 80)]
    assert run(("1", 5), ("c", 8)) == [("1", 50), ("c", 80)]
    assert run(("1", 5), ("c", 8)) == [("1", 50), ("c", 80)]
    assert asked == [["1", "b"], ["b", "c"]]


def test_heights_and_galleries(spark, tmp_path):
    put(tmp_path, "a/ball.json", [{"frame_idx": 1, "height_m": 2.5}, {"frame_idx": 2}, {"frame_idx": 3, "height_m": None}])
    assert [tuple(r) for r in logs.heights(spark, f"{tmp_path}/*/ball.json").collect()] == [("a", 1, 2.5)]
    df = spark.createDataFrame([("7", 1, [1.0, 2.0]), ("7", 1, [3.0, 4.0]), ("7", 2, [1.0, 1.0]), ("7", 3, [1.0, 1.0]), ("7", 3, None)], "job_id string, track long, vector array<float>")
    logs.write_galleries(df, f"{tmp_path}/g")
    assert sorted((r["job_id"], r["track"], r["vector"]) for r in logs.galleries(spark, f"{tmp_path}/g").collect()) == [("7", 1, [1.0, 2.0]), ("7", 1, [3.0, 4.0])]


def test_emptied_jobs_leave_views_and_galleries(spark, tmp_path):
    now = lambda *r: spark.createDataFrame(list(r), "job_id string, signature long")
    rows = {1: [("a", 1), ("a", 2)], 2: [], 3: [("b", 7)]}

    def build(jobs):
        made = [r for x in jobs.collect() for r in rows[x["signature"]]]
        return spark.createDataFrame(made, "job_id string, v long")

    run = lambda *r: sorted(tuple(x) for x in logs.refresh(now(*r), f"{tmp_path}/view", f"{tmp_path}/built", build).collect())
    assert run() == []
    assert run(("a", 1)) == [("a", 1), ("a", 2)]
    assert run(("a", 2), ("b", 3)) == [("b", 7)]
    assert run(("b", 3)) == [("b", 7)]
    assert run() == []
    gallery = lambda *r: spark.createDataFrame(list(r), "job_id string, track long, vector array<float>")
    logs.write_galleries(gallery(("a", 1, [1.0]), ("a", 1, [2.0]), ("b", 5, [1.0]), ("b", 5, [3.0])), f"{tmp_path}/g")
    logs.write_galleries(gallery(("a", 1, [1.0])), f"{tmp_path}/g")
    assert sorted((r["job_id"], r["vector"]) for r in logs.galleries(spark, f"{tmp_path}/g").collect()) == [("b", [1.0]), ("b", [3.0])]


def test_a_failed_build_changes_nothing(spark, tmp_path):
    from matchlake.sources import versions

    rows = lambda *r: spark.createDataFrame(list(r), "job_id string, v long")
    jobs = lambda *r: spark.createDataFrame(list(r), "job_id string, signature long")
    at = (f"{tmp_path}/rows", f"{tmp_path}/manifests")
    versions.publish(rows(("a", 1), ("b", 2)), jobs(("a", 1), ("b", 1)), *at)
    rows(("a", 9)).write.parquet(f"{at[0]}/version=2")  # a build that ended before its manifest
    (tmp_path / "manifests" / "2").mkdir()  # or within it
    read = lambda: sorted(tuple(r) for r in versions.current(spark, *at).select("job_id", "v").collect())
    assert read() == [("a", 1), ("b", 2)]
    versions.publish(rows(("a", 3)), jobs(("a", 2), ("c", 1)), *at)
    assert read() == [("a", 3), ("b", 2)]
    versions.clear(spark, *at)
    assert read() == [("a", 3), ("b", 2)] and sorted(p.name for p in (tmp_path / "rows").iterdir()) == ["version=1", "version=3"]
    assert {(r["job_id"], r["version"]) for r in versions.manifest(spark, at[1]).collect()} == {("a", 3), ("b", 1), ("c", None)}


def test_dates_of_huge_movies(spark, tmp_path):
    """A file of over 3 GB, its movie header behind the pictures, is read in some hundred bytes."""
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    from matchlake.sources import movies

    size = 3 << 30
    with (tmp_path / "long.mp4").open("wb") as f:
        f.write(box(b"ftyp", b"isom") + (1).to_bytes(4, "big") + b"mdat" + (size).to_bytes(8, "big"))
        f.seek(12 + size)
        f.write(box(b"moov", box(b"udta", b"\0" * 64) + box(b"mvhd", b"\1\0\0\0" + (2 * 86_400).to_bytes(8, "big") + b"\0" * 12)))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "cut.mov").write_bytes(box(b"moov", b"")[:6])
    (tmp_path / "zero.mp4").write_bytes(box(b"moov", box(b"mvhd", b"\0" * 24)))
    movies.register(spark)
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], str(r["created"]), r["bytes_read"]) for r in spark.read.format("movie_headers").load(f"{tmp_path}/*.mp4").collect()}
    assert got.keys() == {"long.mp4", "zero.mp4"} and got["zero.mp4"][1] == "None"
    assert got["long.mp4"][0] > size and got["long.mp4"][1] == "1904-01-03 00:00:00" and got["long.mp4"][2] < 1000
    assert [str(r["created"]) for r in logs.video_dates(spark, f"{tmp_path}/*/*.mov").collect()] == ["None"]
    assert logs.video_dates(spark, str(tmp_path)).count() == 3
    assert logs.video_dates(spark, f"file://{tmp_path}/none/*.mp4").count() == 0
