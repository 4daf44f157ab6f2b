"""Registered queries over bars, features, alignment and flow, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, bars as B, features as X, flow, ic
from ..sources import tape
from .common import BARS, DAILY, FEATURES, HOUR, PRINTS, TICKS, bars_sql, daily, features, hourly, prints, r, rounded, rs

OHLCV = ["open", "high", "low", "close", "volume"]


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hourly(spark, sf_dir))


def bars_daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(daily(spark, sf_dir), 2)


def bars_rollup_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.rollup(hourly(spark, sf_dir), 4))


ROLLUP = """rolled AS (
  SELECT series, min(time) AS time, arg_min(open, idx) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, idx) AS close, sum(volume) AS volume
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY time) - 1 AS idx FROM bars)
  GROUP BY series, idx // 4 HAVING count(*) = 4)"""


def gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.gap_audit(hourly(spark, sf_dir), HOUR)


GAPS = """gaps AS (
  SELECT *, lag(close) OVER w AS prev, lag(time) OVER w AS prev_time,
         coalesce(greatest(CAST(floor((time - lag(time) OVER w) / 3600 + 0.5) AS BIGINT) - 1, 0), 0) AS missing
  FROM bars WINDOW w AS (PARTITION BY series ORDER BY time))"""


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.fill_gaps(hourly(spark, sf_dir), HOUR))


def gap_fill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.gap_fill_counts(hourly(spark, sf_dir), HOUR, 2)


def median_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.median_spacing(hourly(spark, sf_dir)), 3)


def closed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.closed_bars(hourly(spark, sf_dir), HOUR, 1_705_000_000).select("series", "time")


def last_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.last_bars(hourly(spark, sf_dir), 20).select("series", "time", "close")


def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of one second and series are pages of one bar: the first by sequence stays."""
    ticks = tape.event_ticks(spark, sf_dir).select("series", (F.floor(F.col("time") / 600) * 600).alias("time"), "seq", "price")
    return B.first_seen(ticks, ["series", "time"], ["seq"])


def features_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir))


def scaler_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.fit_scaler(features(spark, sf_dir), X.PRICE_FEATURES, F.col("row") < 100))


def features_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    scaled = X.scale(rows, X.fit_scaler(rows, X.PRICE_FEATURES, F.col("row") < 100), X.PRICE_FEATURES)
    return rounded(scaled.select("series", "row", *X.PRICE_FEATURES))


SCALER = """scaler AS (
  SELECT series, avg(log_return) AS m0, greatest(stddev_pop(log_return), 1e-12) AS s0,
         avg(realized_vol) AS m1, greatest(stddev_pop(realized_vol), 1e-12) AS s1,
         avg(volume_surge) AS m2, greatest(stddev_pop(volume_surge), 1e-12) AS s2
  FROM features WHERE row < 100 GROUP BY series)"""


def clip_3sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.clip(features(spark, sf_dir), X.PRICE_FEATURES).select("series", "row", *X.PRICE_FEATURES))


def _clipped(c: str) -> str:
    mid, dev = f"avg({c}) OVER s", f"3 * stddev_pop({c}) OVER s"
    return r(f"least(greatest({c}, {mid} - {dev}), {mid} + {dev})", c)


def asof_strict_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as prints for the bars of every other series, two hours fresh at most."""
    bars = hourly(spark, sf_dir).where("series <> 'purchase'").select("series", "time")
    ticks = tape.event_ticks(spark, sf_dir).where("series = 'purchase'").groupBy("time_ms").agg(F.max("price").alias("value"))
    # all series share the prints, so each close is looked up once
    clock = bars.select(F.lit("purchase").alias("series"), "time").distinct()
    found = align.align_step(clock, ticks.withColumn("series", F.lit("purchase")), HOUR, 7_200_000).drop("series")
    return rounded(bars.join(found, "time").select("series", "time", "value", "age_ms"))


def asof_completed_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir)
    joined = align.completed_bar(bars.select("series", "time", "close"), B.rollup(bars, 4), 4, ["close"])
    return joined.select("series", "time", "close", "higher_close", "ready")


def range_sum_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.rollup(hourly(spark, sf_dir), 4)
    return rounded(align.range_sum(bars, prints(spark, sf_dir)), 9)


def panel_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_panel(hourly(spark, sf_dir), ["close"])


def bucket_grid_logret(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hourly(spark, sf_dir).withColumn("log_return", X.log_return())
    return rounded(align.bucket_grid(rows, "log_return", 4 * HOUR))


def price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir)
    days = spark.range(0, 40).select((F.col("id") * 86400 + 1_703_900_000).alias("at"))
    return align.price_at(bars, bars.select("series").distinct().crossJoin(days))


def flow_rolling_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prints(spark, sf_dir).select("series", "time", flow.rolling_z("rate", 48).alias("z")))


def flow_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prints(spark, sf_dir).select("series", "time", (flow.rolling_sum("rate", 24) * 1e4).alias("carry_bps")))


def flow_count_surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hourly(spark, sf_dir).select("series", "time", flow.count_surge(20).alias("trade_count_surge")))


def flow_size_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hourly(spark, sf_dir).select("series", "time", flow.size_z(20).alias("avg_trade_size_z")))


def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.flow_columns(hourly(spark, sf_dir), prints(spark, sf_dir), HOUR, z_window=48))


def augmented_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = flow.trim_leading(flow.flow_columns(hourly(spark, sf_dir), prints(spark, sf_dir), HOUR, z_window=24))
    names = ["funding_bps", "trade_count_surge"]
    return rounded(flow.augment(features(spark, sf_dir), columns, names).select("series", "row", "log_return", *names))


FLOW = f"""{PRINTS},
scores AS (
  SELECT series, time_ms, rate * 1e4 AS funding_bps, premium * 1e4 AS premium_bps,
         CASE WHEN n = $Z THEN CASE WHEN rs > 1e-12 THEN (rate - rm) / rs ELSE 0 END END AS funding_z,
         CASE WHEN n = $Z THEN CASE WHEN ps > 1e-12 THEN (premium - pm) / ps ELSE 0 END END AS premium_z,
         CASE WHEN cn = 24 THEN cs * 1e4 END AS carry_bps
  FROM (SELECT *, count(*) OVER w AS n, avg(rate) OVER w AS rm, stddev_pop(rate) OVER w AS rs, avg(premium) OVER w AS pm,
               stddev_pop(premium) OVER w AS ps, count(*) OVER c AS cn, sum(rate) OVER c AS cs
        FROM prints WINDOW w AS (PARTITION BY series ORDER BY time ROWS BETWEEN $B PRECEDING AND CURRENT ROW),
             c AS (PARTITION BY series ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))),
sized AS (SELECT *, CASE WHEN trades > 0 AND volume > 0 THEN ln(volume / trades) END AS size FROM bars),
tape AS (
  SELECT series, time, (time + 3600) * 1000 AS close_ms,
         CASE WHEN n = 20 THEN ln((trades + 1e-8) / (total / 20 + 1e-8)) END AS trade_count_surge,
         CASE WHEN n = 20 AND k >= 2 AND size IS NOT NULL
              THEN CASE WHEN sd > 1e-12 THEN (size - m) / sd ELSE 0 END END AS avg_trade_size_z
  FROM (SELECT *, count(*) OVER w AS n, CAST(sum(trades) OVER w AS DOUBLE) AS total, count(size) OVER w AS k, avg(size) OVER w AS m,
               stddev_pop(size) OVER w AS sd
        FROM sized WINDOW w AS (PARTITION BY series ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))"""


def _flow(z: int) -> str:
    return FLOW.replace("$Z", str(z)).replace("$B", str(z - 1))


def _carried(name: str) -> str:
    """A column of the scores at each bar, by a strict as-of join with an inclusive tolerance of four hours."""
    return f"""c_{name} AS (
  SELECT t.series, t.time, CASE WHEN t.close_ms - p.time_ms <= 14400000 THEN p.{name} END AS {name}
  FROM tape t ASOF LEFT JOIN (SELECT * FROM scores WHERE {name} IS NOT NULL) p ON t.series = p.series AND t.close_ms > p.time_ms)"""


FLOW_NAMES = [*flow.PRINT_COLUMNS, *flow.TAPE_COLUMNS]


def _flow_table(z: int) -> str:
    joins = " ".join(f"JOIN c_{n} USING (series, time)" for n in flow.PRINT_COLUMNS)
    every = " AND ".join(f"{n} IS NOT NULL" for n in FLOW_NAMES)
    parts = ",\n".join(_carried(n) for n in flow.PRINT_COLUMNS)
    return f"""{_flow(z)},
{parts},
flow AS (SELECT series, time, {', '.join(FLOW_NAMES)}, {every} AS valid FROM tape {joins})"""


def next_bar_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.next_return(features(spark, sf_dir), HOUR).select("series", "row", "next_return"))


def forward_cum_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).where("close > 0").withColumn("ret", F.exp(F.least("log_return", F.lit(5.0))) - 1)
    return rounded(X.forward_cumulative(rows, "ret", 5).select("series", "row", "forward"), 4)


def ic_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.next_return(features(spark, sf_dir))
    return rounded(ic.measure_ic(rows, ["realized_vol", "volume_surge", "log_return"], "next_return"))


def state_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of states by mean return in basis points, here of hours of the day."""
    rows = features(spark, sf_dir).where("abs(log_return) < 5").groupBy("series", (F.floor(F.col("time") / HOUR) % 24).alias("state")).agg((F.avg("log_return") * 1e4).alias("bps"))
    from ..operators.strategy import label_state

    return rounded(rows.withColumn("label", label_state(F.col("bps"))), 4)


_W = "(PARTITION BY series ORDER BY time)"
_IC = f"""WITH {FEATURES},
target AS (
  SELECT *, lead(log_return) OVER w AS y, CASE WHEN row_number() OVER w - 1 < count(*) OVER (PARTITION BY series) // 2
         THEN 'first' ELSE 'second' END AS half FROM features WINDOW w AS (PARTITION BY series ORDER BY row)),
long AS (
  SELECT series, half, 'realized_vol' AS feature, realized_vol AS x, y FROM target
  UNION ALL SELECT series, half, 'volume_surge', volume_surge, y FROM target
  UNION ALL SELECT series, half, 'log_return', log_return, y FROM target),
parts AS (
  SELECT series, feature, 'all' AS part, x, y FROM long WHERE y IS NOT NULL
  UNION ALL SELECT series, feature, half, x, y FROM long WHERE y IS NOT NULL),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY series, feature, part ORDER BY x)
            + (count(*) OVER (PARTITION BY series, feature, part, x) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (PARTITION BY series, feature, part ORDER BY y)
            + (count(*) OVER (PARTITION BY series, feature, part, y) - 1) / 2.0::DOUBLE AS ry FROM parts),
stats AS (
  SELECT series, feature, part, count(*) AS n,
         CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS pearson,
         CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0
              THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END AS spearman
  FROM ranked GROUP BY ALL)
SELECT series, feature, part, n, {rs('pearson', 'spearman')},
       {r('CASE WHEN n > 3 THEN spearman * sqrt(n - 2) / sqrt(greatest(1 - spearman * spearman, 1e-12)) END', 't')} FROM stats"""

SQL = {
    "bars_1h": f"WITH {BARS} SELECT series, time, {rs(*OHLCV)}, trades FROM bars",
    "bars_daily_orders": f"WITH {DAILY} SELECT series, time, {rs(*OHLCV, places=2)}, trades FROM daily",
    "bars_rollup_4": f"WITH {BARS}, {ROLLUP} SELECT series, time, {rs(*OHLCV)} FROM rolled",
    "gap_audit": f"WITH {BARS}, {GAPS} SELECT series, count(*) AS bars, CAST(sum(missing) AS BIGINT) AS gaps, max(missing) AS largest_gap FROM gaps GROUP BY series",
    "gap_fill": f"""WITH {BARS}, {GAPS}
SELECT series, time, {rs(*OHLCV)}, false AS filled FROM bars
UNION ALL SELECT series, prev_time + k * 3600, {', '.join(r('prev', c) for c in OHLCV[:4])}, CAST(0 AS DOUBLE) AS volume, true
FROM gaps, unnest(range(1, missing + 1)) AS u(k) WHERE missing BETWEEN 1 AND 12""",
    "gap_fill_counts": f"""WITH {BARS}, {GAPS}
SELECT series, CAST(sum(CASE WHEN missing <= 2 THEN missing ELSE 0 END) AS BIGINT) AS filled,
       CAST(sum(CASE WHEN missing > 2 THEN missing ELSE 0 END) AS BIGINT) AS skipped FROM gaps GROUP BY series""",
    "median_spacing": f"""WITH {BARS},
steps AS (SELECT series, time - lag(time) OVER {_W} AS step FROM bars),
sorted AS (SELECT series, list_sort(list(step)) AS l FROM steps WHERE step IS NOT NULL GROUP BY series)
SELECT series, l[len(l) // 2 + 1] AS median_step,
       {r('CASE WHEN len(l) + 1 >= 10 AND l[len(l) // 2 + 1] BETWEEN 1 AND 31 * 86400 THEN 365.25 * 86400 / l[len(l) // 2 + 1] ELSE 105120 END', 'bars_per_year', 3)} FROM sorted""",
    "closed_bars": f"WITH {BARS} SELECT series, time FROM bars WHERE time + 3600 <= 1705000000",
    "last_bars": f"WITH {BARS} SELECT series, time, close FROM bars QUALIFY row_number() OVER (PARTITION BY series ORDER BY time DESC) <= 20",
    "dedupe_first_seen": f"""WITH {TICKS}
SELECT series, (time // 600) * 600 AS time, min(seq) AS seq, arg_min(price, seq) AS price, count(*) AS copies FROM ticks GROUP BY ALL""",
    "features_price": f"WITH {FEATURES} SELECT series, row, idx, time, {rs('close', *X.PRICE_FEATURES)} FROM features",
    "scaler_train": f"""WITH {FEATURES}, {SCALER}
SELECT series, {', '.join(r(f'm{i}', f'{n}_mean') + ', ' + r(f's{i}', f'{n}_sd') for i, n in enumerate(X.PRICE_FEATURES))} FROM scaler""",
    "features_scaled": f"""WITH {FEATURES}, {SCALER}
SELECT series, row, {', '.join(r(f'({n} - m{i}) / s{i}', n) for i, n in enumerate(X.PRICE_FEATURES))} FROM features JOIN scaler USING (series)""",
    "clip_3sigma": f"""WITH {FEATURES}
SELECT series, row, {', '.join(map(_clipped, X.PRICE_FEATURES))} FROM features WINDOW s AS (PARTITION BY series)""",
    "asof_strict_stale": f"""WITH {BARS},
points AS (SELECT time_ms, max(price) AS value FROM ticks WHERE series = 'purchase' GROUP BY time_ms),
closes AS (SELECT series, time, (time + 3600) * 1000 AS close_ms FROM bars WHERE series <> 'purchase'),
found AS (SELECT c.*, p.value, c.close_ms - p.time_ms AS age FROM closes c ASOF LEFT JOIN points p ON c.close_ms > p.time_ms)
SELECT series, time, {r('CASE WHEN age <= 7200000 THEN value END', 'value')}, CASE WHEN age <= 7200000 THEN age END AS age_ms FROM found""",
    "asof_completed_bar": f"""WITH {BARS}, {ROLLUP},
base AS (SELECT *, row_number() OVER {_W} - 1 AS idx FROM bars),
top AS (SELECT *, row_number() OVER {_W} - 1 AS idx FROM rolled)
SELECT b.series, b.time, b.close, t.close AS higher_close, t.close IS NOT NULL AS ready
FROM base b LEFT JOIN top t ON b.series = t.series AND t.idx = (b.idx + 1) // 4 - 1""",
    "range_sum_funding": f"""WITH {PRINTS}, {ROLLUP},
held AS (SELECT series, time, lead(time) OVER {_W} AS next_time FROM rolled),
spans AS (SELECT series, time, coalesce(next_time, 9000000000) AS until, next_time FROM held)
SELECT s.series, s.time, {r('coalesce(sum(p.rate), CAST(0 AS DOUBLE))', 'total', 9)}, count(p.rate) AS prints
FROM spans s LEFT JOIN prints p ON p.series = s.series AND p.time_ms > s.time * 1000 AND p.time_ms <= s.until * 1000
WHERE s.next_time IS NOT NULL GROUP BY ALL""",
    "panel_align": f"""WITH {BARS}
SELECT s.series, t.time, b.close FROM (SELECT DISTINCT time FROM bars) t CROSS JOIN (SELECT DISTINCT series FROM bars) s
LEFT JOIN bars b ON b.series = s.series AND b.time = t.time""",
    "bucket_grid_logret": f"""WITH {FEATURES},
sums AS (SELECT series, time // 14400 AS bucket, sum(log_return) AS log_return FROM returns GROUP BY ALL),
grid AS (SELECT unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM sums)
SELECT s.series, g.bucket * 14400 AS time, {r('coalesce(x.log_return, CAST(0 AS DOUBLE))', 'log_return')}
FROM grid g CROSS JOIN (SELECT DISTINCT series FROM sums) s LEFT JOIN sums x ON x.series = s.series AND x.bucket = g.bucket""",
    "price_lookup": f"""WITH {BARS},
asked AS (SELECT s.series, CAST(i * 86400 + 1703900000 AS BIGINT) AS at FROM (SELECT DISTINCT series FROM bars) s, range(40) AS t(i)),
first AS (SELECT series, arg_min(close, time) AS c FROM bars GROUP BY series)
SELECT a.series, a.at, coalesce(b.close, f.c) AS price
FROM asked a ASOF LEFT JOIN bars b ON a.series = b.series AND a.at >= b.time JOIN first f ON f.series = a.series""",
    "flow_rolling_z": f"""WITH {_flow(48)} SELECT p.series, p.time, {r('s.funding_z', 'z')} FROM prints p JOIN scores s USING (series, time_ms)""",
    "flow_carry": f"""WITH {_flow(48)} SELECT p.series, p.time, {r('s.carry_bps', 'carry_bps')} FROM prints p JOIN scores s USING (series, time_ms)""",
    "flow_count_surge": f"WITH {_flow(48)} SELECT series, time, {rs('trade_count_surge')} FROM tape",
    "flow_size_z": f"WITH {_flow(48)} SELECT series, time, {rs('avg_trade_size_z')} FROM tape",
    "flow_table": f"WITH {_flow_table(48)} SELECT series, time, {rs(*FLOW_NAMES)}, valid FROM flow",
    "augmented_features": f"""WITH {_flow_table(24)},
ret AS (
  SELECT *, row_number() OVER w - 1 AS idx, coalesce(ln(greatest(close, 1e-18) / greatest(lag(close) OVER w, 1e-18)), CAST(0 AS DOUBLE)) AS log_return
  FROM bars WINDOW w AS {_W})
SELECT series, idx - 5 AS row, {rs('log_return', 'funding_bps', 'f.trade_count_surge').replace(' AS f.', ' AS ')}
FROM ret JOIN flow f USING (series, time) WHERE f.valid AND idx >= 5""",
    "next_bar_return": f"""WITH {FEATURES}
SELECT series, row, {r('CASE WHEN lead(time) OVER w - time = 3600 THEN lead(log_return) OVER w END', 'next_return')} FROM features WINDOW w AS {_W}""",
    "forward_cum_5": f"""WITH {FEATURES},
kept AS (SELECT series, row, time, exp(least(log_return, 5)) - 1 AS ret FROM features WHERE close > 0)
SELECT series, row, {r('CASE WHEN count(ret) OVER w = 5 THEN product(1 + ret) OVER w - 1 END', 'forward', 4)}
FROM kept WINDOW w AS (PARTITION BY series ORDER BY time ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""",
    "ic_halves": _IC,
    "state_labels": f"""WITH {FEATURES},
states AS (SELECT series, (time // 3600) % 24 AS state, avg(log_return) * 1e4 AS bps FROM features WHERE abs(log_return) < 5 GROUP BY ALL)
SELECT series, state, {r('bps', places=4)}, CASE WHEN bps > 20 THEN 'PUMP' WHEN bps > 3 THEN 'drift-up' WHEN bps < -20 THEN 'DUMP'
       WHEN bps < -3 THEN 'bleed' ELSE 'chop' END AS label FROM states""",
}

QUERIES = {name: globals()[name] for name in SQL}
