import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetext.operators import segments as S
from kinetext.streaming import sessions


@pytest.fixture
def stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(1).sortWithinPartitions("event_id").write.parquet(str(tmp_path / "in"))
    return lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    return spark.table(name)


def test_sessions(spark, sf, stream):
    got = run(spark, sessions.session_counts(stream(), "6 hours"), "sessions_t", "complete")
    assert got.agg({"events": "sum"}).first()[0] == 1000 and got.count() > 100
    longest = got.selectExpr("max(unix_timestamp(end) - unix_timestamp(start)) AS s").first()["s"]
    assert longest >= 6 * 3600


def blocks(df):
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return df.select(F.col("user_id").alias("entry"), F.col("event_id").alias("pos"), start.alias("start_ms"), (start + F.floor(F.col("value") * 240000).cast("long")).alias("end_ms"), (F.col("event_type") == "signup").alias("is_full"))


def batches(spark, sf, tmp_path, n):
    """Events in order, as files that come one after the other."""
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").toPandas()
    for i, part in enumerate(np.array_split(np.arange(len(events)), n)):
        path = tmp_path / f"{i}.parquet"
        events.iloc[part].to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    schema = spark.read.parquet(str(tmp_path / "0.parquet")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_stateful_marking_equals_the_batch_form(spark, sf, tmp_path):
    got = {(r["entry"], r["pos"]): (r["inside"], r["is_end"]) for r in run(spark, sessions.mark_sentences(blocks(batches(spark, sf, tmp_path, 3)), idle_ms=None), "inside_t", "append").collect()}
    want, state, last = {}, {}, {}
    whole = S.mark_sentences(blocks(spark.read.parquet(f"{sf}/events.parquet")), ["entry"])
    for r in whole.orderBy("entry", "pos").collect():
        end, is_open = state.get(r["entry"], (-1, False))
        if r["is_full"]:
            end, is_open = r["end_ms"], True
        elif r["start_ms"] > end:
            is_open = False
        state[r["entry"]] = (end, is_open)
        want[r["entry"], r["pos"]] = (is_open, r["is_end"])
        last[r["entry"]] = r["pos"]
    waiting = {(e, p) for e, p in last.items() if want[e, p][0]}  # the next block has yet to come
    assert waiting and got == {k: v for k, v in want.items() if k not in waiting}


class State:
    """What a marker needs of a group's state."""

    def __init__(self, value=None, timed_out=False):
        self.get, self.exists, self.hasTimedOut, self.wait = value, value is not None, timed_out, None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_idle_entries_are_closed():
    mark, state = sessions._marker(500), State()
    rows = pd.DataFrame({"entry": [1, 1], "pos": [3, 4], "start_ms": [0, 5], "end_ms": [10, 20], "is_full": [True, False]})
    (first,) = mark((1,), iter([rows]), state)
    assert first[["pos", "inside", "is_end"]].values.tolist() == [[3, True, False]] and state.wait == 500
    state.hasTimedOut = True
    (rest,) = mark((1,), iter([]), state)
    assert rest[["pos", "start_ms", "end_ms", "is_full", "inside", "is_end"]].values.tolist() == [[4, 5, 20, False, True, True]] and not state.exists


def test_blocks_out_of_order_are_an_error():
    rows = pd.DataFrame({"entry": [1], "pos": [9], "start_ms": [0], "end_ms": [1], "is_full": [True]})
    with pytest.raises(ValueError, match="came after"):
        list(sessions._marker(1)((1,), iter([rows]), State((5, False, 10, 0, 0, False))))
