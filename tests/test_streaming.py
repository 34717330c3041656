"""Streams that stop and start in the middle, against a batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import raster as R
from fieldloom.streaming.accumulators import StreamingAccumulator
from fieldloom.streaming.histograms import histogram_of


def params(hist):
    return R.robust_stats(hist, ["event_type"], 256, False)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def arriving(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value")
    events.repartition(9).write.parquet(f"{tmp_path}/all")
    files = sorted((tmp_path / "all").glob("part-*.parquet"))
    (tmp_path / "in").mkdir()

    def come(n):
        for f in files[:n]:
            f.rename(tmp_path / "in" / f.name)
        del files[:n]

    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return events, come, stream


@pytest.mark.parametrize("keep", [16, 2])
def test_stop_and_start(spark, arriving, tmp_path, keep):
    events, come, stream = arriving
    begin = lambda: StreamingAccumulator(spark, f"{tmp_path}/state", histogram_of, params, keep)
    assert begin().total() is None and begin().latest() is None
    come(4)
    begin().start(stream()).awaitTermination()
    half = rows(begin().total())
    assert half == rows(histogram_of(spark.read.parquet(f"{tmp_path}/in"))) and rows(begin().latest()) == rows(params(begin().total()))
    begin().start(stream()).awaitTermination()  # nothing new
    assert rows(begin().total()) == half
    come(5)
    again = begin()
    again.start(stream()).awaitTermination()
    assert rows(again.total()) == rows(histogram_of(events)) != half
    assert rows(again.latest()) == rows(params(histogram_of(events)))
    assert len(again._numbers("parts")) <= max(9, keep) and (keep == 16 or len(again._numbers("parts")) <= 4) and len(again._numbers("params")) <= 2


@pytest.mark.parametrize("where", ["params", "partial"])
def test_a_batch_that_fails_runs_again(spark, arriving, tmp_path, where):
    """A batch dies after or before its partial histogram is written: the restart counts it once."""
    events, come, stream = arriving
    come(9)
    calls = []

    def dying(f, kind):
        def run(df):
            if kind == where:
                calls.append(1)
                if len(calls) == 4:
                    raise RuntimeError("died")
            return f(df)

        return run

    acc = StreamingAccumulator(spark, f"{tmp_path}/state", dying(histogram_of, "partial"), dying(params, "params"), 3)
    with pytest.raises(Exception, match="died"):
        acc.start(stream()).awaitTermination()
    before = acc.total().agg(F.sum("w")).first()[0]
    assert 0 < before < events.count()
    acc.start(stream()).awaitTermination()
    assert rows(acc.total()) == rows(histogram_of(events)) and rows(acc.latest()) == rows(params(histogram_of(events)))
