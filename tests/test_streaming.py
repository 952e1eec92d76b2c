from __future__ import annotations

import datetime as dt

from riskloom.streaming.events import popularity, session_counts, window_counts

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
ROWS = [(u, START + dt.timedelta(seconds=s)) for u, s in ((1, 0), (1, 100), (1, 5000), (2, 50), (9, 40_000))]


def run(spark, tmp_path, build, name):
    spark.createDataFrame(ROWS, "u long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / name))
    stream = spark.readStream.schema("u long, ts timestamp").parquet(str(tmp_path / name))
    q = build(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_sessions(spark, tmp_path):
    rows = run(spark, tmp_path, lambda s: session_counts(s, "u", "ts"), "sessions_out")
    assert sorted((r["u"], r["rows"]) for r in rows.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_windows_and_popularity(spark, tmp_path):
    rows = run(spark, tmp_path, lambda s: window_counts(s, "u", "ts", "1 hour"), "windows_out")
    assert sorted((r["u"], r["rows"]) for r in rows.collect()) == [(1, 1), (1, 2), (2, 1)]
    shared = run(spark, tmp_path, lambda s: popularity(s.selectExpr("'a' as a", "u", "ts"), "a", "u", "ts", "1 hour"), "popular_out")
    assert sorted(r["users"] for r in shared.collect()) == [1, 2]
