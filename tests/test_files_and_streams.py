import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from photoflow import scratch
from photoflow.functions import documents, names
from photoflow.sources import sidecars
from photoflow.streaming import streams


def test_files(spark, tmp_path):
    (tmp_path / "a" / "venv").mkdir(parents=True)
    for p in ("x.JPG", "a/y.png", "a/venv/z.jpg", "n.txt"):
        (tmp_path / p).write_bytes(b"123")
    found = [r.path.rsplit("/", 1)[1] for r in sidecars.image_catalog(spark, str(tmp_path)).collect()]
    assert sorted(found) == ["x.JPG", "y.png"]
    face = {"success": True, "faces": [{"face_id": 4, "confidence": 0.5, "encoding": [1, 2]}, {"confidence": 0.1}]}
    (tmp_path / "p.json").write_text(json.dumps({"sidecar_info": {"operation_type": "yolov8"}, "face_detection": {"insight": face}, "yolov8": {"success": False}}))
    (tmp_path / "q.json").write_text('{"broken": ')
    docs = sidecars.read_sidecars(spark, str(tmp_path))
    assert sorted(r.valid for r in docs.collect()) == [False, True]
    ops = sidecars.explode_operations(docs)
    assert {(r.op, r.backend, r.success) for r in ops.collect()} == {("face_detection", "insight", True), ("yolov8", None, False)}
    faces = sidecars.explode_faces(ops, max_faces=5, image_col="path").collect()
    assert len(faces) == 1 and faces[0].face_key.endswith(":4") and faces[0].encoding == [1.0, 2.0]
    assert sidecars.explode_objects(ops, "path").count() == 0
    assert sidecars.migrate_sidecars(docs, str(tmp_path / "out"), dry_run=True).count() == 2
    assert not (tmp_path / "out").exists()
    assert sidecars.migrate_sidecars(docs, str(tmp_path / "out")).count() == 2
    kinds = docs.select(documents.operation_type(F.col("doc"), F.col("path")).alias("k"), documents.tool_name(F.col("doc")).alias("t")).collect()
    assert {r.k for r in kinds} == {"yolov8", "unknown"}


def test_names(spark):
    want = {"20250920_143022.jpg": "2025-09-20 14:30:22", "20250920_143022_001.jpg": "2025-09-20 14:30:22.001", "IMG_20250920_143022.jpg": "2025-09-20 14:30:22", "20250920_080527.960.jpg": "2025-09-20 08:05:27", "holiday.jpg": None, "2025_12.jpg": None, "20251399_143022.jpg": None}
    df = spark.createDataFrame([(k,) for k in want], "n string")
    got = {r.n: r.t for r in df.select("n", names.photo_ts(F.col("n")).cast("string").alias("t")).collect()}
    assert got == want


def test_ingest_is_incremental(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(2):
        (src / f"{k}.json").write_text(json.dumps({"yolov8": {"success": True, "n": k}}))
        streams.ingest_sidecars(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert streams.ingested(spark, str(tmp_path / "out")).count() == 2
    streams.ingest_sidecars(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert streams.ingested(spark, str(tmp_path / "out")).count() == 2


def followed(spark, df, path, parts, watermark) -> dict:
    """Tracks of df's rows that come in the given parts, a batch each, and then a row that closes all frames."""
    from datetime import timedelta

    end = df.agg(F.max("ts")).first()[0] + timedelta(days=30)
    closing = spark.createDataFrame([("end", end, None, None, None, None)], df.schema)
    for part in [*(df.where(p) for p in parts), closing]:
        part.coalesce(1).write.mode("append").parquet(f"{path}/balls")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/balls")
    seen = []
    with streams.rocksdb_state(spark):
        streams.run_available(streams.track_stream(stream, watermark=watermark), f"{path}/cp", lambda b, _: seen.extend(b.collect()))
    assert len(seen) == len({r.ball_id for r in seen})
    return {r.ball_id: (r.prev_id, r.dx, r.dy, r.tracked_type) for r in seen}


def test_tracks_are_the_same_whatever_the_batches(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from photoflow.operators import joins

    rng, base = random.Random(3), datetime(2025, 9, 20)
    rows = [(rng.choice("ab"), base + timedelta(seconds=rng.randrange(12)), k, rng.uniform(0, 120), rng.uniform(0, 120), rng.choice(["unknown", "unknown", "soccer", "tennis"])) for k in range(80)]
    df = spark.createDataFrame(rows, "source string, ts timestamp, ball_id long, cx double, cy double, ball_type string")
    motion = joins.track_nearest(df)
    want = {r.ball_id: (r.prev_id, r.dx, r.dy, r.tracked_type) for r in joins.inherit_types(motion).collect()}
    assert followed(spark, df, tmp_path / "whole", ["true"], "1 minute") == want
    assert followed(spark, df, tmp_path / "cut", ["ball_id % 3 = 2", "ball_id % 3 = 0", "ball_id % 3 = 1"], "1 minute") == want
    in_time = [f"ts < '{base + timedelta(seconds=5)}'", f"ts >= '{base + timedelta(seconds=5)}'"]
    assert followed(spark, df, tmp_path / "in-time", in_time, "0 seconds") == want


def test_late_balls_are_dropped(spark, tmp_path):
    from datetime import datetime, timedelta

    base = datetime(2025, 9, 20)
    at = lambda s: base + timedelta(seconds=s)
    rows = [("a", at(0), 1, 0.0, 0.0, "soccer"), ("a", at(50), 2, 10.0, 0.0, "unknown"), ("a", at(60), 3, 30.0, 0.0, "unknown"), ("a", at(55), 4, 15.0, 0.0, "tennis"), ("a", at(1), 5, 1.0, 0.0, "tennis"), ("a", at(56), 6, None, 0.0, "tennis")]
    df = spark.createDataFrame(rows, "source string, ts timestamp, ball_id long, cx double, cy double, ball_type string")
    got = followed(spark, df, tmp_path, ["ball_id <= 2", "ball_id = 3", "ball_id >= 4"], "8 seconds")
    assert got.keys() == {1, 2, 3, 4, 6}  # of two that come out of order, the one within the watermark is kept
    assert got[2] == (1, 10.0, 0.0, "soccer") and got[4] == (2, 5.0, 0.0, "soccer")
    assert got[6][0] is None and got[3][0] is None  # a ball without a place is near nothing


def test_balls_of_a_source_wait_in_many_partitions(spark, tmp_path):
    """Balls of one source are no single group; ids that come again in each frame are other balls, and a run goes on where one stopped."""
    from datetime import datetime, timedelta

    base, schema = datetime(2025, 9, 20), "source string, ts timestamp, ball_id long, cx double, cy double, ball_type string"
    at = lambda f: base + timedelta(minutes=f)
    known = {(0, 1): "soccer", (0, 3): "soccer", (2, 2): "tennis", (2, 3): "tennis"}
    rows = [("a", at(f), i, 100.0 * i + f, 0.0, known.get((f, i), "unknown")) for f in range(4) for i in range(10)]
    kinds = {1: "soccer", 3: "soccer"}
    want = [(f, i, i if f else None, 1.0 if f else None, kinds.get(i, "tennis" if i == 2 and f >= 2 else "unknown")) for f in range(4) for i in range(10)]
    seen = []

    def run(part) -> list:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/balls")
        tracks = streams.track_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/balls"), watermark="70 seconds")
        with streams.rocksdb_state(spark):
            streams.run_available(tracks, f"{tmp_path}/cp", lambda b, _: seen.extend(b.collect()))
        return sorted(((r.ts - base).seconds // 60, r.ball_id, r.prev_id, r.dx, r.tracked_type) for r in seen)

    assert run(rows[:30]) == want[:10]
    waiting = spark.read.format("statestore").load(f"{tmp_path}/cp").select("partition_id").collect()
    assert len(waiting) == 20 and len({r.partition_id for r in waiting}) > 1
    assert run([*rows[30:], ("end", at(60), None, None, None, None)]) == want


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(applicationId="app-none", master="spark://host:7077")
    unset = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(unset)


def test_links_are_listed_and_counted(spark, tmp_path):
    from photoflow.operators import stats

    for folder in ("a/b/c", "a/.git", "d"):
        (tmp_path / folder).mkdir(parents=True)
    for name in ("a/1.jpg", "a/b/2.PNG", "a/b/c/3.jpg", "d/4.jpg", "a/.git/5.jpg", "a/notes.txt"):
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "d/to1.jpg").symlink_to(tmp_path / "a/1.jpg")
    (tmp_path / "d/gone.jpg").symlink_to(tmp_path / "nowhere.jpg")
    (tmp_path / "a/b/up.jpg").symlink_to(tmp_path)  # a folder: not followed
    files = sidecars.list_files(spark, f"file://{tmp_path}")
    got = {r.path.removeprefix(f"{tmp_path}/"): r for r in files.collect()}
    assert set(got) == {"a/1.jpg", "a/b/2.PNG", "a/b/c/3.jpg", "d/4.jpg", "d/to1.jpg", "d/gone.jpg"}
    assert got["d/to1.jpg"].target == str(tmp_path / "a/1.jpg") and got["d/to1.jpg"].length == 5 and not got["d/to1.jpg"].broken
    assert got["d/gone.jpg"].broken and got["d/gone.jpg"].length is None and not got["a/1.jpg"].is_link
    assert tuple(stats.link_counts(files).first()) == (6, 2, 1)
    ops = spark.createDataFrame([(op, f"{tmp_path}/{p}") for op, p in (("face", "a/1.jpg"), ("face", "d/to1.jpg"), ("face", "d/to1.jpg"), ("ball", "d/gone.jpg"), ("ball", "lost.jpg"))], "op string, path string")
    assert {tuple(r) for r in stats.operation_links(ops, files).collect()} == {("face", 2, 1, 0), ("ball", 2, 1, 1)}
    assert sidecars.list_files(spark, str(tmp_path), None).count() == 7
    with pytest.raises(ValueError, match="mounted"):
        sidecars.list_files(spark, "s3://bucket/x")


def test_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """No list of files is made on the driver: Spark's readers, which make one, are not asked for documents or images."""
    from pyspark.sql.readwriter import DataFrameReader
    from pyspark.sql.streaming.readwriter import DataStreamReader

    (tmp_path / "in/a b%20/venv").mkdir(parents=True)
    for k, place in enumerate(("in/0.json", "in/a b%20/1.json", "in/.2.json", "in/3.JSON")):
        (tmp_path / place).write_text(json.dumps({"yolov8": {"success": True, "n": k}}))
    for place in ("in/a b%20/4.Png", "in/a b%20/venv/5.png", "in/_6.png"):
        (tmp_path / place).write_bytes(b"12")
    formats = []
    for reader in (DataFrameReader, DataStreamReader):
        monkeypatch.setattr(reader, "text", lambda *a, **k: formats.append("text"))
        monkeypatch.setattr(reader, "format", lambda self, source, f=reader.format: (formats.append(source), f(self, source))[1])
    assert {r.path.removeprefix(f"file://{tmp_path}/in/") for r in sidecars.read_sidecars(spark, f"{tmp_path}/in").collect()} == {"0.json", "a b%20/1.json"}
    assert [(r.path, r.length) for r in sidecars.image_catalog(spark, f"{tmp_path}/in").collect()] == [(f"file:{tmp_path}/in/a b%20/4.Png", 2)]
    assert sidecars.image_catalog(spark, f"{tmp_path}/in", recursive=False).count() == 0
    for _ in range(2):
        streams.ingest_sidecars(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    assert streams.ingested(spark, f"{tmp_path}/out").count() == 2
    assert not {"text", "binaryFile"} & set(formats)
