"""Windows on a stream give the rows that they give on the whole batch."""

import datetime

import pytest
from pyspark.sql import functions as F

from chronotext.streaming import windows


@pytest.mark.parametrize("how", [windows.sliding_counts, windows.sessions])
def test_stream_equals_batch(spark, tmp_path, how):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(at(m), m % 3, "ab"[m % 2]) for m in (0, 4, 9, 12, 33, 50, 51, 90, 200)] + [(at(5), 1, "a")]
    df = spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string")
    df.where(F.col("ts") < at(60)).write.parquet(f"{tmp_path}/in/1")
    df.where(F.col("ts") >= at(60)).write.parquet(f"{tmp_path}/in/2")
    end = spark.createDataFrame([(at(10_000), 99, "z")], df.schema)  # moves the watermark past all windows
    end.write.parquet(f"{tmp_path}/in/3")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    name = f"seen_{how.__name__}"
    query = how(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = sorted(map(tuple, spark.table(name).collect()))
    assert got == sorted(map(tuple, how(df).collect())) and got
