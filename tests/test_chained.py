"""Streams with typed states: stopped and restarted, with rows sent twice, they say what the batch says."""

import pytest
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import paper
from tidebar.streaming import chained


def _run(make, source, sink, work):
    """One run of a stream from its checkpoint, until all files that are there have been read."""
    query = chained.follow(make(source), sink, f"{work}/c", every=None)
    assert query.awaitTermination(120) and query.exception() is None


def _source(spark, schema, path):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


def test_longer_bars_of_a_restarted_stream(spark, tmp_path):
    start = 1_700_000_400 - 1_700_000_400 % 3600
    # series b has a hole over the end of an hour, and one over whole hours
    ticks = spark.range(500).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("series"), F.timestamp_seconds(start + F.col("id") * 61).alias("ts"), F.col("id").alias("seq"),
        ((F.col("id") * 7919) % 101).cast("double").alias("price"), F.lit(1.5).alias("volume"),
    ).where("series = 'a' or (not seq between 45 and 75 and not seq between 200 and 330)")
    make = lambda t: chained.chained_bars(t, 600, (1800, 3600), "5 minutes")
    bounds = [(0, 179), (170, 299), (295, 499)]  # each file repeats the end of the one before
    for k, (low, high) in enumerate(bounds):
        ticks.where(F.col("seq").between(low, high)).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
        _run(make, _source(spark, ticks.schema, f"{tmp_path}/in"), f"{tmp_path}/out", tmp_path)
    names = ("series", "time", "open", "high", "low", "close", "volume", "trades")
    got = sorted((r.seconds, *(r[c] for c in names)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    own = ticks.withColumns({"time": F.unix_seconds("ts"), "time_ms": F.unix_millis("ts")})
    every = sorted((s, *(r[c] for c in names)) for s in (600, 1800, 3600) for r in B.tumbling(own, s).collect())
    ended = start + 499 * 61 - 300
    assert [r for r in got if r[2] + r[0] <= ended] == [r for r in every if r[2] + r[0] <= ended]
    assert set(got) <= set(every) and len(got) == len(set(got)) and {r[0] for r in got} == {600, 1800, 3600}


def test_a_stream_that_looks_for_more(spark, tmp_path):
    """Rows that come while it runs are written as well; a second start goes on where the first one ended."""
    rows = lambda low, high: spark.range(low, high).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows(0, 5)
    for part in range(2):
        query = chained.follow(_source(spark, "id long", f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c", "1 second")
        rows(5 + 5 * part, 10 + 5 * part)
        query.processAllAvailable()
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(15))


def test_longer_bars_must_hold_whole_ones(spark):
    with pytest.raises(ValueError, match="multiples"):
        chained.chained_bars(spark.range(1), 600, (900,))


def test_accounts_of_a_restarted_stream(spark, tmp_path):
    targets = spark.range(120).select(
        F.when(F.col("id") % 3 == 0, "y").otherwise("x").alias("account"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("coin"),
        (F.floor(F.col("id") / 2) * 3600).alias("time"), F.lit(101.0).alias("high"), F.lit(99.0).alias("low"),
        (100 + F.sin(F.col("id"))).alias("close"), (F.col("id") % 5 < 2).cast("double").alias("target"),
    )
    config = paper.Config(max_coins=2)
    for k, (low, high) in enumerate([(0, 19), (15, 39), (35, 59)]):
        targets.where(F.col("time").between(low * 3600, high * 3600)).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
        _run(lambda t: chained.kept_accounts(t, config), _source(spark, targets.schema, f"{tmp_path}/in"), f"{tmp_path}/out", tmp_path)
    key = lambda df: sorted((r.account, r.coin, r.time, round(r.equity, 9), round(r.fee, 9), r.reason) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(paper.replay(targets, config))
