"""Bars from delimited files and from recorded pages of listings services, and the sinks for bars, models and results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import gap_audit

#: Names a column may go by, the likeliest first.
FIELDS = {
    "time": ("time", "timestamp", "date", "open_time", "unix"), "open": ("open",), "high": ("high",), "low": ("low",),
    "close": ("close", "price", "last"), "volume": ("volume", "vol", "amount", "quote_volume"),
}


def resolve_header(names: list[str]) -> dict[str, str]:
    """Which column is which field: by its whole name first, then by a part of it. A close is needed."""
    plain = {n: n.strip().strip("\"'").lower() for n in names}
    found = {}
    for field, options in FIELDS.items():
        match = next((n for o in options for n in names if plain[n] == o), None)
        match = match or next((n for o in options for n in names if o in plain[n]), None)
        if match:
            found[field] = match
    if "close" not in found:
        raise ValueError(f"no close or price column in: {', '.join(names)}")
    return found


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Adds the number of each row of a file, from 1: its place in its part, after the rows of the parts before, of which
    there is one count each."""
    low = F.lit((1 << 33) - 1)
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(low)})
    sizes = placed.groupBy("_part").agg((F.max("_place") + 1).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("_part"), F.coalesce(before, F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place") + 1).drop("_at", "_part", "_place", "_start")


def read_csv(spark: SparkSession, path: str, series: str = "csv") -> DataFrame:
    """Bars of a file with a header, ``;`` or ``,``; rows without a positive close are left out, in order of time.

    Other prices default to the close, the volume to 0. A time that is neither a number nor a date is the row's number.
    """
    head = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
    if head is None:
        raise ValueError("the file is empty")
    sep = ";" if head[0].count(";") > head[0].count(",") else ","
    raw = numbered(spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).csv(path), "_n")
    at = resolve_header([c for c in raw.columns if c != "_n"])
    text = lambda f: F.trim(F.regexp_replace(F.col(f"`{at[f]}`"), "[\"']", ""))
    number = lambda f: F.expr(f"try_cast(_{f} as double)")
    rows = raw.select(*(text(f).alias(f"_{f}") for f in at), "_n")
    rows = rows.withColumn("close", number("close")).where((F.col("close") > 0) & ~F.isnan("close") & (F.col("close") < float("inf")))
    stamp = F.col("_n")
    if "time" in at:
        dated = F.expr("unix_seconds(try_cast(_time as timestamp))")
        stamp = F.when(F.col("_time").rlike(r"^[\d.]+$"), number("time").cast("long")).otherwise(F.coalesce(dated, F.col("_n")))
    part = lambda f, default: F.coalesce(number(f), default) if f in at else default
    return rows.select(
        F.lit(series).alias("series"), stamp.cast("long").alias("time"),
        *(part(f, F.col("close")).alias(f) for f in ("open", "high", "low")), "close", F.greatest(part("volume", F.lit(0.0)), F.lit(0.0)).alias("volume"), "_n",
    ).orderBy("time", "_n").drop("_n")


def _seconds(stamp: Column) -> Column:
    return F.floor(F.when(stamp > 1e11, stamp / 1000).otherwise(stamp)).cast("long")


def page_report(pages: DataFrame, seconds: int) -> DataFrame:
    """Of each series of recorded pages: rows, bars, copies that were left out, bars missing and the longest gap."""
    rows = pages.select("series", F.explode(F.from_json("body", "array<array<double>>")).alias("v")).select("series", _seconds(F.col("v")[0]).alias("time"))
    counts = rows.groupBy("series").agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count_distinct("time")).alias("copies"))
    return counts.join(gap_audit(bars_from_pages(pages, seconds), seconds), "series", "left")


def bars_from_pages(pages: DataFrame, seconds: int, last: int | None = None) -> DataFrame:
    """Bars of recorded pages (series, page, body), body a JSON list of [time, open, high, low, close, volume].

    Times are seconds, or milliseconds where they are too large for that. A bar that several pages hold counts as the first page has it; bars without a positive close are left out; other
    prices that are not positive become the close; ``last`` keeps the newest so many.
    """
    rows = pages.select("series", "page", F.posexplode(F.from_json("body", "array<array<double>>")).alias("pos", "v"))
    rows = rows.select("series", "page", "pos", _seconds(F.col("v")[0]).alias("time"), *(F.col("v")[i + 1].alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))))
    w = Window.partitionBy("series", "time").orderBy("page", "pos")
    rows = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1 and close > 0")
    price = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.col("close")).alias(c)
    bars = rows.select("series", "time", *(price(c) for c in ("open", "high", "low")), "close", "volume")
    if last is None:
        return bars
    newest = Window.partitionBy("series").orderBy(F.col("time").desc())
    return bars.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last).drop("_r")


def flow_bars_from_pages(pages: DataFrame, last: int | None = None) -> DataFrame:
    """Bars with a count of trades from recorded pages, newest first, body a JSON list of {t (ms), o, h, l, c, v, n} as texts or numbers.

    A bar that several pages hold counts as the first one has it; bars without a positive close are left out, other prices
    default to the close, volume and count to 0; ``last`` keeps the newest so many.
    """
    kind = "array<struct<t:string,o:string,h:string,l:string,c:string,v:string,n:string>>"
    rows = pages.select("series", "page", F.posexplode(F.from_json("body", kind)).alias("pos", "r"))
    number = lambda f: F.expr(f"try_cast(r.{f} as double)")
    rows = rows.select("series", "page", "pos", F.floor(number("t") / 1000).cast("long").alias("time"), *(number(f).alias(f) for f in "ohlcvn"))
    rows = rows.where("time is not null and c > 0 and not isnan(c) and c < double('infinity')")
    w = Window.partitionBy("series", "time").orderBy("page", "pos")
    rows = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    price = lambda f, name: F.when((F.col(f) != 0) & ~F.isnan(f), F.col(f)).otherwise(F.col("c")).alias(name)
    count = lambda f: F.greatest(F.coalesce(F.when(~F.isnan(f), F.col(f)), F.lit(0.0)), F.lit(0.0))
    bars = rows.select("series", "time", price("o", "open"), price("h", "high"), price("l", "low"), F.col("c").alias("close"), count("v").alias("volume"), count("n").cast("long").alias("trades"))
    if last is None:
        return bars
    newest = Window.partitionBy("series").orderBy(F.col("time").desc())
    return bars.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last).drop("_r")


def prints_from_pages(pages: DataFrame) -> DataFrame:
    """Funding prints of recorded pages, body a JSON list of {time, fundingRate, premium}; of one stamp the last counts."""
    kind = "array<struct<time:bigint,fundingRate:string,premium:string>>"
    rows = pages.select("series", "page", F.posexplode(F.from_json("body", kind)).alias("pos", "v"))
    one = rows.groupBy("series", F.col("v.time").alias("time_ms")).agg(F.max_by("v", F.struct("page", "pos")).alias("v"))
    return one.select("series", "time_ms", F.col("v.fundingRate").cast("double").alias("rate"), F.col("v.premium").cast("double").alias("premium"))


def request_spans(ranges: DataFrame, most_hours: int = 480) -> DataFrame:
    """Tiles (series, start_ms, end_ms) into spans of at most so many hours, for sources that bound a request."""
    span = most_hours * 3_600_000
    starts = F.explode(F.sequence(F.col("start_ms"), F.col("end_ms") - 1, F.lit(span))).alias("from_ms")
    tiled = ranges.where("end_ms > start_ms").select("series", "end_ms", starts)
    return tiled.select("series", "from_ms", F.least(F.col("from_ms") + span, "end_ms").alias("to_ms"))


def prints_in_ranges(pages: DataFrame, ranges: DataFrame, most_hours: int = 480) -> DataFrame:
    """Funding prints of the asked ranges (series, start_ms, end_ms) from pages recorded span by span (series, from_ms, body).

    Only pages of spans that the ranges are tiled into count, and of a stamp in several of them the one of the last span;
    rows without a finite stamp or rate are left out, and a premium that is missing is NaN.
    """
    kind = "array<struct<time:string,fundingRate:string,premium:string>>"
    spans = request_spans(ranges, most_hours).select("series", "from_ms").distinct()
    rows = pages.join(spans, ["series", "from_ms"]).select("series", "from_ms", F.posexplode(F.from_json("body", kind)).alias("pos", "v"))
    number = lambda f: F.expr(f"try_cast(v.{f} as double)")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.select("series", "from_ms", "pos", number("time").alias("time_ms"), number("fundingRate").alias("rate"), number("premium").alias("premium"))
    rows = rows.where(finite(F.col("time_ms")) & finite(F.col("rate")))
    one = rows.groupBy("series", F.col("time_ms").cast("long").alias("time_ms")).agg(F.max_by(F.struct("rate", "premium"), F.struct("from_ms", "pos")).alias("v"))
    premium = F.when(finite(F.col("v.premium")), F.col("v.premium")).otherwise(F.lit(float("nan")))
    return one.select("series", "time_ms", "v.rate", premium.alias("premium"))


def fresh(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Rows of a landing table that were saved within the last ``ttl_seconds``."""
    return cache.where(F.col("saved_at") > now - ttl_seconds)


def write_csv(bars: DataFrame, path: str) -> None:
    """time, open, high, low, close, volume with a header; as many files as there are partitions, in order of time."""
    bars.select("time", "open", "high", "low", "close", "volume").orderBy("time").write.mode("overwrite").option("header", True).csv(path)


def write_models(models: DataFrame, path: str) -> None:
    """A model table, by kind, to which runs are appended."""
    models.write.mode("append").partitionBy("kind").parquet(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def model_json(models: DataFrame) -> DataFrame:
    """Each model as one JSON text."""
    return models.select("series", F.to_json(F.struct(*models.columns)).alias("body"))


def models_from_json(texts: DataFrame, schema: str) -> DataFrame:
    return texts.select(F.from_json("body", schema).alias("m")).select("m.*")


def register_test(spark: SparkSession, path: str, entry: dict) -> None:
    """Adds a line to the registry of tests that were decided on beforehand."""
    spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").write.mode("append").text(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    kind = "id string, date string, hypothesis string, test string, pValue double, verdict string, familySize int"
    return spark.read.schema(kind).json(path)
