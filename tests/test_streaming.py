"""Streaming file source and gap sessions."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ampertrace.streaming.ingest import RAW_SCHEMA, append_processed, gap_sessions


def test_new_raw_files_are_appended_once(spark, tmp_path):
    raw, out, state = (str(tmp_path / n) for n in ("raw", "out", "state"))
    row = lambda i: (i, "d", "f.csv", i, f"2024-01-0{i} 10:00:00", "2024-01-09 00:00:00", "c", "p", "P1", "x", "1", '{"rx":"5,5","hmi_status":3}')
    for i in (1, 2):
        spark.createDataFrame([row(i)], RAW_SCHEMA).write.mode("append").parquet(raw)
        append_processed(spark, raw, out, state).awaitTermination()
    rows = spark.read.parquet(out).orderBy("raw_id").collect()
    assert [(r["raw_id"], r["rx"], r["hmi_status"], str(r["event_date"])) for r in rows] == [
        (1, 5.5, "3", "2024-01-01"), (2, 5.5, "3", "2024-01-02"),
    ]


def test_gap_sessions_keep_events_exactly_one_gap_apart(spark):
    start = datetime(2024, 1, 1)
    rows = [("p", "x", "d", "c", "P1", start + timedelta(seconds=s), 50.0, 20.0) for s in (0, 1200, 2401)]
    df = spark.createDataFrame(rows, "phone string, project_number string, device_name string, charger_name string, position string, event_ts timestamp, eff double, temperature double")
    got = gap_sessions(df).orderBy("start_ts").select("source_row_count").collect()
    assert [r[0] for r in got] == [2, 1]
    assert df.filter(F.col("eff") > 0).count() == 3
