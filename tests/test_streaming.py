"""Running aggregates over files that arrive in a folder."""

from pyspark.sql import functions as F

from pointloom.sources.tables import event_points
from pointloom.streaming import running


def test_streamed_bounds_equal_batch(spark, sf_dir, tmp_path):
    points = event_points(spark, sf_dir).orderBy("GpsTime")
    points.repartitionByRange(4, "GpsTime").write.parquet(str(tmp_path / "in"))
    stream = running.arriving_points(spark, str(tmp_path / "in"), points.schema, 1)
    q = running.running_bounds(stream, "1 day", lateness="40 days").writeStream.outputMode("complete").format("memory").queryName("bounds_now").start()
    q.processAllAvailable()
    q.stop()
    order = lambda d: [tuple(r) for r in d.orderBy("start").collect()]
    assert order(spark.table("bounds_now")) == order(running.running_bounds(points, "1 day"))


def test_cells_and_sessions(spark, sf_dir):
    points = event_points(spark, sf_dir)
    assert running.running_voxel_counts(points, (0.0, 0.0, 0.0), 50.0).agg(F.sum("n_points")).first()[0] == points.count()
    assert running.sessions(points, "Classification", "1 hour").agg(F.sum("n_points")).first()[0] == points.count()


def test_late_points_are_dropped(spark, tmp_path):
    """What arrives after the watermark has passed its window changes nothing; what is late within the lateness counts."""
    from pointloom.functions.schema import PointSchema
    from pointloom.operators.frame import in_memory

    schema = PointSchema.of("Position3D", "GpsTime")
    day = 86_400.0
    arrivals = [[(1.0, 0.0), (2.0, 1.0)], [(3.0, 5 * day)], [(9.0, 10.0), (4.0, 4.5 * day)], [(5.0, 9 * day)], [(6.0, 20 * day)]]
    (tmp_path / "in").mkdir()
    stream = running.arriving_points(spark, str(tmp_path / "in"), schema.struct_type(), 1)
    q = running.running_bounds(stream, "1 day", lateness="2 days").writeStream.outputMode("append").format("memory").queryName("late_bounds").start()
    for points in arrivals:
        in_memory(spark, schema, [((x, 0.0, 0.0), t) for x, t in points]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = {r["start"].day: (r["n_points"], r["max_x"]) for r in spark.table("late_bounds").collect()}
    assert got[1] == (2, 2.0) and got[5] == (1, 4.0) and got[6] == (1, 3.0)


def test_point_files_as_stream_and_sink(spark, sf_dir, tmp_path):
    """Files that arrive while the query is down are read once; a batch that is committed again replaces its files."""
    from pointloom.functions.schema import POINT_IDX
    from pointloom.sources import las

    points = event_points(spark, sf_dir)
    n = points.count()
    where = [str(tmp_path / d) for d in ("in", "log", "out", "state")]
    some = lambda low, high: points.where((F.col(POINT_IDX) >= low) & (F.col(POINT_IDX) < high)).coalesce(1)

    def arrive(name, part, compressed):
        las.write_las(part, str(tmp_path / name), scale=(0.25,) * 3, compressed=compressed, chunk_size=100)
        (tmp_path / "in").mkdir(exist_ok=True)
        for i, f in enumerate(sorted((tmp_path / name).glob("part-*"))):
            f.rename(tmp_path / "in" / f"{name}-{i}{f.suffix}")

    def run():
        stream = las.stream_las(spark, where[0], where[1], pointsPerPartition=150)
        q = las.write_las_stream(stream, where[2], where[3], scale=(0.25,) * 3, compressed=True, chunk_size=64).trigger(availableNow=True).start()
        q.awaitTermination()
        out = las.read_las(spark, where[2]).collect()
        return sorted((r["GpsTime"], r["Position3D"]["x"], r["Classification"]) for r in out)

    whole = {k: sorted((r["GpsTime"], int(r["Position3D"]["x"] / 0.25) * 0.25, r["Classification"]) for r in some(0, k).collect()) for k in (400, 700, n)}
    arrive("b", some(0, 400), False)
    assert run() == whole[400]
    arrive("a", some(400, 700), True)  # before the others by name: the log keeps the order
    arrive("c", some(700, n), False)
    assert run() == whole[n] == run()
    assert not list((tmp_path / "out" / "_arriving").iterdir())
    # The last batch again: its first attempt's files go.
    name = sorted(p.name for p in (tmp_path / "out").glob("batch-*"))[-1]
    writer = las.LasStreamWriter({"path": where[2], "pointFormat": "1", "compressed": "true"}, None, False)
    staged = tmp_path / "out" / "_arriving" / "x.laz"
    staged.write_bytes((tmp_path / "out" / name).read_bytes())
    batch = int(name.split("-")[1])
    writer.commit([las.Part(str(staged), 1), None], batch)
    assert [p.name for p in (tmp_path / "out").glob(f"batch-{batch:010d}-*")] == [f"batch-{batch:010d}-00000.laz"]
    writer.abort([las.Part(str(tmp_path / "out" / "_arriving" / "gone.laz"), 1)], batch)
    reader = las.LasStream({"path": where[0], "log": where[1]})
    assert reader.latestOffset() == {"files": len(list((tmp_path / "in").iterdir()))} and reader.entries()[0][0].rsplit("/", 1)[-1].startswith("b-")


def test_reports_as_keyed_state(spark, tmp_path):
    """Reports that grow over batches and a restart, close by a later point or by the watermark, and meet late points."""
    from pointloom.functions.schema import PointSchema
    from pointloom.operators.frame import in_memory

    schema = PointSchema.of("Position3D", "GpsTime", "Classification")
    (tmp_path / "in").mkdir()

    def run(rows):
        if rows:
            in_memory(spark, schema, [((x, float("nan"), 1.0), t, c) for c, t, x in rows]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = running.arriving_points(spark, str(tmp_path / "in"), schema.struct_type(), 1)
        q = running.running_reports(stream, "Classification", 10.0, "100 seconds").writeStream.format("parquet").outputMode("append")
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        log = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("Classification", "change", "start", "last", "n_points", "min_x", "max_x", "min_y").collect()]
        net = {}
        for c, change, start, last, n, low, high, none in log:
            assert none is None or none != none
            if change:
                net[c, start, last, n, low, high] = net.get((c, start, last, n, low, high), 0) + change
        assert set(net.values()) <= {0, 1}
        return sorted(k for k, v in net.items() if v), sorted((c, start, n) for c, change, start, _, n, *_ in log if change == 0)

    assert run([(1, 1000.0, 5.0), (1, 1008.0, 7.0), (2, 1000.0, 1.0)]) == ([(1, 1000.0, 1008.0, 2, 5.0, 7.0), (2, 1000.0, 1000.0, 1, 1.0, 1.0)], [])
    # One grows, one begins another session twice, one reaches into the gap before.
    holds, closed = run([(1, 1015.0, 2.0), (2, 1020.0, 3.0), (2, 1040.0, 4.0), (2, 1045.0, 9.0), (3, 1050.0, 1.0)])
    assert holds == [(1, 1000.0, 1015.0, 3, 2.0, 7.0), (2, 1000.0, 1000.0, 1, 1.0, 1.0), (2, 1020.0, 1020.0, 1, 3.0, 3.0), (2, 1040.0, 1045.0, 2, 4.0, 9.0), (3, 1050.0, 1050.0, 1, 1.0, 1.0)]
    assert closed == [(2, 1000.0, 1), (2, 1020.0, 1)]
    holds, closed = run([(3, 1042.0, 8.0), (2, 1001.0, 99.0)])  # the second is more than a gap before the open session
    assert (3, 1042.0, 1050.0, 2, 1.0, 8.0) in holds and (2, 1000.0, 1000.0, 1, 1.0, 1.0) in holds and len(holds) == 5
    run([(4, 5000.0, 1.0)])  # the watermark passes the ends of all others
    holds, closed = run([(4, 5001.0, 2.0), (1, 1016.0, 50.0)])
    assert closed == [(1, 1000.0, 3), (2, 1000.0, 1), (2, 1020.0, 1), (2, 1040.0, 2), (3, 1042.0, 2)]
    assert (4, 5000.0, 5001.0, 2, 1.0, 2.0) in holds and not any(k[0] == 1 and k[3] == 4 for k in holds)
