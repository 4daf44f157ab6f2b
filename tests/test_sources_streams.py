"""Files, recorded pages, synthetic series, and that streams say what batches say."""

import pytest
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import paper
from tidebar.sources import files, lookups, synth
from tidebar.streaming import live


def test_csv_headers_and_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,2,3,1,2.5,10\n2024-01-01,1,2,0.5,2,-5\nx,1,1,1,0,1\n")
    got = files.read_csv(spark, f"file://{tmp_path}/a.csv").collect()
    assert [(r.time, r.close, r.volume) for r in got] == [(1704067200, 2.0, 0.0), (1704153600, 2.5, 10.0)]
    (tmp_path / "b.csv").write_text('"my price";when\n3;1\n4;2\n')
    got = files.read_csv(spark, f"file://{tmp_path}/b.csv").collect()
    assert [(r.open, r.close, r.volume) for r in got] == [(3.0, 3.0, 0.0), (4.0, 4.0, 0.0)]
    with pytest.raises(ValueError):
        files.resolve_header(["a", "b"])
    files.write_csv(files.read_csv(spark, f"file://{tmp_path}/a.csv"), f"file://{tmp_path}/out")
    assert files.read_csv(spark, f"file://{tmp_path}/out").count() == 2


def test_pages_keep_the_first_bar_and_the_last_print(spark):
    pages = spark.createDataFrame([("a", 0, "[[60, 1, 2, 1, 2, 5], [0, 1, 1, 1, 1, 5]]"), ("a", 1, "[[60, 9, 9, 9, 9, 9], [120, 0, 1, 0, 3, 1], [180, 1, 1, 1, 0, 1]]")], "series string, page int, body string")
    got = files.bars_from_pages(pages, 60).orderBy("time").collect()
    assert [(r.time, r.open, r.close) for r in got] == [(0, 1.0, 1.0), (60, 1.0, 2.0), (120, 3.0, 3.0)]
    assert files.bars_from_pages(pages, 60, last=1).first().time == 120
    prints = spark.createDataFrame([("a", 0, '[{"time": 1, "fundingRate": "0.1", "premium": "1"}, {"time": 1, "fundingRate": "0.2"}]')], "series string, page int, body string")
    assert tuple(files.prints_from_pages(prints).first()) == ("a", 1, 0.2, None)
    spans = files.request_spans(spark.createDataFrame([("a", 0, 4_000_000_000)], "series string, start_ms long, end_ms long"))
    assert [(r.from_ms, r.to_ms) for r in spans.orderBy("from_ms").collect()] == [(0, 1728000000), (1728000000, 3456000000), (3456000000, 4000000000)]


def test_rows_without_a_time_are_numbered_in_order(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"p{part}.csv").write_text("close\n" + "".join(f"{10 * part + i + 1}\n" for i in range(3)))
    got = files.read_csv(spark, f"file://{tmp_path}/*.csv").collect()
    assert sorted(r.time for r in got) == list(range(1, 10)) and [r.time for r in got] == sorted(r.time for r in got)
    (tmp_path / "same.csv").write_text("time,close\n5,1\n5,2\n4,3\n")
    assert [r.close for r in files.read_csv(spark, f"file://{tmp_path}/same.csv").collect()] == [3.0, 1.0, 2.0]


def test_page_report(spark):
    pages = spark.createDataFrame([("a", 0, "[[1700000060000, 1, 1, 1, 1, 1], [1700000000000, 1, 1, 1, 1, 1]]"), ("a", 1, "[[1700000060, 2, 2, 2, 2, 2], [1700000300, 1, 1, 1, 1, 1]]")], "series string, page int, body string")
    r = files.page_report(pages, 60).first()
    assert (r.rows, r.copies, r.bars, r.gaps, r.largest_gap) == (4, 1, 3, 3, 3)


def test_synthetic_series_repeat(spark):
    a = synth.synthetic_bars(spark, 2, 300)
    assert a.count() == 600 and a.where("low > least(open, close) or high < greatest(open, close)").count() == 0
    one, two = (x.where("series = 's1'").agg(F.sum("close")).first()[0] for x in (a, synth.synthetic_bars(spark, 5, 300)))
    assert one == two


def test_registry_and_models(spark, tmp_path):
    files.register_test(spark, f"file://{tmp_path}/r", {"id": "t1", "pValue": 0.2})
    files.register_test(spark, f"file://{tmp_path}/r", {"id": "t2", "pValue": 0.4})
    assert {r.id for r in files.registry(spark, f"file://{tmp_path}/r").collect()} == {"t1", "t2"}
    models = spark.createDataFrame([("a", "hmm", [0.5])], "series string, kind string, pi array<double>")
    files.write_models(models, f"file://{tmp_path}/m")
    assert files.read_models(spark, f"file://{tmp_path}/m").count() == 1
    back = files.models_from_json(files.model_json(models), "series string, kind string, pi array<double>")
    assert back.collect() == models.collect()


def test_streamed_bars_are_the_batch_bars(spark, tmp_path):
    ticks = spark.range(400).select(
        F.lit("a").alias("series"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 37).alias("ts"), F.col("id").alias("seq"), ((F.col("id") * 7919) % 101).cast("double").alias("price"), F.lit(1.0).alias("volume")
    )
    ticks.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")
    query = live.live_bars(stream, 600, "0 seconds").writeStream.format("memory").queryName("live_bars").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    batch = B.tumbling(ticks.withColumns({"time": F.unix_seconds("ts"), "time_ms": F.unix_millis("ts")}), 600)
    got = {(r.time, r.open, r.close, r.volume) for r in spark.table("live_bars").collect()}
    every = sorted((r.time, r.open, r.close, r.volume) for r in batch.collect())
    assert got == set(every[:-1])  # the last bar has not ended


def test_streamed_account_is_the_replay(spark, tmp_path):
    targets = spark.range(60).select(
        F.lit("x").alias("account"), F.lit("a").alias("coin"), (F.col("id") * 3600).alias("time"), F.lit(101.0).alias("high"), F.lit(99.0).alias("low"),
        (100 + F.sin(F.col("id"))).alias("close"), (F.col("id") % 5 < 2).cast("double").alias("target"),
    )
    for part in range(3):
        targets.where(F.col("time").between(part * 20 * 3600, (part * 20 + 19) * 3600)).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    stream = spark.readStream.schema(targets.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = live.live_accounts(stream).writeStream.format("memory").queryName("live_accounts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: [(r.time, round(r.equity, 9), r.reason) for r in df.orderBy("time").collect()]
    assert key(spark.table("live_accounts")) == key(paper.replay(targets))


def test_prints_of_ranges_keep_the_last_span(spark):
    """Spans that overlap at their edge, a missing premium, stamps and rates that are no numbers, and pages nobody asked for."""
    import json
    import math

    hour = 3_600_000
    ranges = spark.createDataFrame([("a", 0, 4 * hour), ("b", 0, 0)], "series string, start_ms long, end_ms long")
    page = lambda *rows: json.dumps([dict(zip(("time", "fundingRate", "premium"), r)) for r in rows])
    pages = [
        ("a", 0, page((hour, "0.1", "0.5"), (2 * hour, "0.2", None), (None, "9", "9"))), ("a", 2 * hour, page((2 * hour, "0.3", "x"), (3 * hour, "bad", "1"), (3 * hour + 1, "0.4", 2))),
        ("a", 9 * hour, page((10 * hour, "7", "7"))), ("b", 0, page((hour, "7", "7"))),
    ]
    found = files.prints_in_ranges(spark.createDataFrame(pages, "series string, from_ms long, body string"), ranges, most_hours=2)
    rows = sorted((r.series, r.time_ms, r.rate, r.premium) for r in found.collect())
    assert [r[:3] for r in rows] == [("a", hour, 0.1), ("a", 2 * hour, 0.3), ("a", 3 * hour + 1, 0.4)]
    assert rows[0][3] == 0.5 and math.isnan(rows[1][3]) and rows[2][3] == 2.0


def test_lookups(spark):
    rows = spark.createDataFrame([("5m", " SOL"), ("12H", "polygon"), ("1d", "somewhere-new")], "length string, network string")
    seconds = lookups.seconds_of(F.col("length"))
    found = rows.select(seconds.alias("s"), lookups.bars_per_year(seconds).alias("y"), lookups.bars_per_day(seconds).alias("d"), lookups.network_id(F.col("network")).alias("n")).collect()
    assert [(r.s, r.d, r.n) for r in found] == [(300, 288, "solana"), (43_200, 2, "polygon_pos"), (86_400, 1, "somewhere-new")]
    assert found[2].y == 365.25
    assert [r[0] for r in spark.createDataFrame([("1m",), ("1M",), ("1w",)], "length string").select(lookups.perp_seconds_of(F.col("length"))).collect()] == [60, 2_592_000, 604_800]
    with pytest.raises(Exception, match="unsupported bar length"):
        spark.createDataFrame([("7m",)], "length string").select(lookups.seconds_of(F.col("length"))).collect()
