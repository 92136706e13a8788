"""State that ends by event time, against a replay of the batches."""

from datetime import datetime, timedelta

import pandas as pd

from causeway.streaming import state

BEGIN = datetime(2024, 1, 1)


def test_values_expire_by_the_watermark(spark, tmp_path):
    at = lambda m: BEGIN + timedelta(minutes=m)
    batches = [
        [("a", 1.0, at(0)), ("b", 5.0, at(1)), ("a", 2.0, at(3))],
        [("a", 1.5, at(2)), ("c", 7.0, at(20))],  # an older value doesn't count
        [("c", 8.0, at(40)), ("d", 1.0, None)],  # the watermark passes a and b
        [("a", 9.0, at(4)), ("a", 3.0, at(41))],  # a row behind the watermark, and the key alive again
        [("e", 0.0, at(90))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, v double, t timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    out = []
    stream = spark.readStream.schema("k string, v double, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = state.expiring(stream, "k", "t", "v", "10 minutes")
    found.writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    minutes = lambda t: (pd.Timestamp(t) - pd.Timestamp(BEGIN)).total_seconds() / 60
    got = sorted((k, v, minutes(t), e) for k, v, t, e in out)
    assert [x for x in got if not x[3]] == [("a", 2.0, 3.0, False), ("a", 3.0, 41.0, False), ("b", 5.0, 1.0, False), ("c", 7.0, 20.0, False), ("c", 8.0, 40.0, False), ("e", 0.0, 90.0, False)]
    ended = [x[:3] for x in got if x[3]]
    assert {("a", 2.0, 3.0), ("b", 5.0, 1.0), ("c", 8.0, 40.0)} <= set(ended) and len(ended) == len(set(ended))
