from datetime import datetime

from shelfmark.sources.sinks import Throttle
from shelfmark.streaming import ratings


def test_counters_and_limited_appends(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("1,u1,a,5\n2,u1,b,3\n")
    (folder / "b.csv").write_text("3,u2,a,1\n")
    stream = ratings.rating_stream(spark, str(folder), 1)
    q = ratings.user_counters(stream).writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counters").collect()} == {("u1", 2, 8.0), ("u2", 1, 1.0)}
    waits = []
    throttle = Throttle(2.0, 100, lambda: 0.0, waits.append)
    for _ in range(2):  # a second run has nothing new to append
        ratings.append_limited(ratings.rating_stream(spark, str(folder), 1), str(tmp_path / "out"), str(tmp_path / "state"), throttle).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 3 and rows.select("batch").distinct().count() == 2 and waits == [2.0]


def test_windows_of_events(spark):
    rows = [(datetime(2024, 1, 1, 10, 5), "a"), (datetime(2024, 1, 1, 10, 55), "a"), (datetime(2024, 1, 1, 11, 0), "b")]
    got = ratings.event_counts(spark.createDataFrame(rows, "ts timestamp, event_type string")).collect()
    assert {(r.start.hour, r.event_type, r.n) for r in got} == {(10, "a", 2), (11, "b", 1)}
