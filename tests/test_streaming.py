"""The stream's state is what a batch gives."""

import datetime as dt

from tidegauge.streaming import arrivals

SCHEMA = "series_id string, observation_date date, publication_date date, value double"


def test_latest_by_series(spark, tmp_path):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(f"s{i % 3}", day(i), None if i % 5 == 0 else day(i + 2 - i % 4), float(i)) for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = arrivals.latest_by_series(arrivals.arrivals(spark, str(tmp_path / "in"), SCHEMA), ["series_id"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("latest").collect()))
    want = sorted(map(tuple, arrivals.latest_by_series(spark.createDataFrame(rows, SCHEMA), ["series_id"]).collect()))
    assert got == want and len(got) == 3
