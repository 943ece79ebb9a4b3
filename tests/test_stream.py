import datetime as dt
import random

import pytest

from barloom.queries.services import batch_hourly_bars, stream_hourly_bars


@pytest.fixture
def many_files(spark, tmp_path):
    """More files than a micro-batch takes, shuffled in time."""
    rows = [(n, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=40 * n), "ab"[n % 2], float(n)) for n in range(240)]
    random.Random(3).shuffle(rows)
    folder = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").repartition(120).write.parquet(folder)
    return str(tmp_path)


def test_stream_of_many_files_out_of_order(spark, many_files):
    whole = lambda df: sorted(tuple(r) for r in df.collect())
    got = whole(stream_hourly_bars(spark, many_files))
    assert sum(r[-1] for r in got) == 240 and got == whole(batch_hourly_bars(spark, many_files))
