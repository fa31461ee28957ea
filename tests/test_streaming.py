import pytest
from pyspark.sql import functions as F


def test_windowed_psi_equals_batch_psi_per_day(spark):
    from loanlens.operators import metrics as me
    from loanlens.sources.fixture import read_table
    from loanlens.streaming.drift_stream import run_drift_stream_once
    sf = "/root/testdata/sf0.001"
    out = {r.window_start.date(): r for r in run_drift_stream_once(spark, sf).collect()}
    assert out, "closed windows expected"
    ev = read_table(spark, sf, "events")
    ref = ev.filter(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00")))
    for day in sorted(out)[:4]:
        cur = ev.filter(F.to_date("ts") == F.lit(day))
        assert out[day].n == cur.count()
        assert out[day].psi == pytest.approx(me.psi(ref, cur, "value"), abs=1e-5)


def test_every_row_of_a_table_of_unsorted_files_is_counted(spark, tmp_path):
    from loanlens.sources.fixture import read_table
    from loanlens.streaming.drift_stream import run_drift_stream_once
    sf = "/root/testdata/sf0.001"
    ev = read_table(spark, sf, "events")
    ev.repartition(6, F.xxhash64("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    out = run_drift_stream_once(spark, str(tmp_path)).orderBy("window_start").collect()
    assert sum(r.n for r in out) == ev.count()
    assert out == run_drift_stream_once(spark, sf).orderBy("window_start").collect()
