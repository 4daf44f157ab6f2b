"""Registered queries over positions, trades, accounts, listings and tests of results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.special import EULER
from ..operators import align, bars as B, confluence, features as X, forecast, nulls, perp, power, rotation, screen, snooping, strategy, trades
from ..session import settled
from ..sources import tape
from .common import FEATURES, HOUR, r, rounded, rs

COST, FIRST_ROW, ENTRY = 30.0, 50, 0.002
TRIALS = 40


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of prices that stay away from zero: the value over a thousand."""
    return B.tumbling(tape.event_ticks(spark, sf_dir).withColumn("price", F.col("price") + 1000), HOUR)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule in place of a model: the mean of the last three returns, turned round."""
    w = Window.partitionBy("series").orderBy("row").rowsBetween(-2, 0)
    return X.price_features(quoted(spark, sf_dir)).withColumn("expected", -F.avg("log_return").over(w))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy.long_only(forecasts(spark, sf_dir), ENTRY, 0.0)


def traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy.traded(positions(spark, sf_dir), FIRST_ROW)


QUOTED = FEATURES.replace("value AS price", "value + 1000 AS price")
POSITIONS = f"""{QUOTED},
forecasts AS (
  SELECT *, -avg(log_return) OVER (PARTITION BY series ORDER BY row ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS expected FROM features),
positions AS (
  SELECT *, coalesce(last_value(CASE WHEN expected > {ENTRY} THEN CAST(1 AS DOUBLE) WHEN expected <= 0 THEN CAST(0 AS DOUBLE) END IGNORE NULLS)
            OVER (PARTITION BY series ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CAST(0 AS DOUBLE)) AS position
  FROM forecasts)"""
TRADED = f"""{POSITIONS},
traded AS (
  SELECT * FROM (SELECT *, exp(lead(log_return) OVER (PARTITION BY series ORDER BY row)) - 1 AS ret FROM positions)
  WHERE ret IS NOT NULL AND row >= {FIRST_ROW}),
nets AS (
  SELECT *, abs(position - coalesce(lag(position) OVER w, 0)) AS delta,
         position * ret - abs(position - coalesce(lag(position) OVER w, 0)) * {COST} * 1e-4 AS net
  FROM traded WINDOW w AS (PARTITION BY series ORDER BY row)),
curve AS (
  SELECT *, product(1 + net) OVER w AS equity, product(1 + ret) OVER w AS buy_hold
  FROM nets WINDOW w AS (PARTITION BY series ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
drawn AS (
  SELECT *, 1 - equity / greatest(max(equity) OVER w, 1) AS drawdown
  FROM curve WINDOW w AS (PARTITION BY series ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def position_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(positions(spark, sf_dir).select("series", "row", "expected", "position"))


def positions_with_shorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 100 rows, each from no position, with shorts and a flat bar between a long and a short."""
    rows = forecasts(spark, sf_dir).select("series", "row", "expected", F.floor(F.col("row") / 100).alias("block"))
    plan = strategy.Strategy(cost_bps=5, entry_bps=20, allow_short=True)
    return strategy.decide(rows, plan).select("series", "row", "position")


def compound_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategy.compound(traded(spark, sf_dir), COST))


def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategy.equity_curve(traded(spark, sf_dir), COST).select("series", "row", "net", "equity", "buy_hold", "drawdown"))


def bt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategy.metrics(traded(spark, sf_dir), COST, 8766.0))


def cost_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strategy.cost_sweep(forecasts(spark, sf_dir)))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.trades(positions(spark, sf_dir), COST, FIRST_ROW)


def trade_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ledger(spark, sf_dir).drop("win"))


def trade_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades.summarize(ledger(spark, sf_dir)))


def trade_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades.window_report(ledger(spark, sf_dir), quoted(spark, sf_dir)))


LEDGER = f"""{POSITIONS},
ahead AS (
  SELECT * FROM (
    SELECT *, exp(lead(log_return) OVER w) - 1 AS ret, lead(time) OVER w AS next_time, lead(close) OVER w AS next_close,
           CASE WHEN position > 1e-9 THEN 1 WHEN position < -1e-9 THEN -1 ELSE 0 END AS dir
    FROM positions WINDOW w AS (PARTITION BY series ORDER BY row)) WHERE ret IS NOT NULL AND row >= $FIRST),
islands AS (
  SELECT *, sum(new) OVER (PARTITION BY series ORDER BY row) AS run FROM (
    SELECT *, CASE WHEN dir IS DISTINCT FROM lag(dir) OVER (PARTITION BY series ORDER BY row) THEN 1 ELSE 0 END AS new FROM ahead)),
ledger AS (
  SELECT series, min(row) AS entry_row, max(row) + 1 AS exit_row, min(time) AS entry_time, max(next_time) AS exit_time, max(dir) AS direction,
         count(*) AS bars_held, arg_min(close, row) AS entry_price, arg_max(next_close, row) AS exit_price,
         product(1 + dir * ret) - 1 AS gross_return, CAST({2 * COST * 1e-4} AS DOUBLE) AS cost_paid,
         product(1 + dir * ret) * (1 - {COST * 1e-4}) * (1 - {COST * 1e-4}) - 1 AS net_return
  FROM islands WHERE dir <> 0 GROUP BY series, run)"""
_LEDGER = LEDGER.replace("$FIRST", str(FIRST_ROW))


def ceiling_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perfect foresight over whole series; it grows without bound, so growth is given as its logarithm."""
    found = nulls.ceiling(strategy.traded(X.price_features(quoted(spark, sf_dir))))
    return rounded(found.withColumns({"log_growth": F.log1p("roi"), "log_buy_hold": F.log1p("buy_hold")}).drop("roi", "buy_hold"))


PERP = perp.Perp(equity=50.0, leverage=9.0, taker_bps=4.5, maintenance=0.05, min_order=10.0)


def perp_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = quoted(spark, sf_dir)
    rows = positions(spark, sf_dir).join(bars.select("series", "time", "high", "low"), ["series", "time"])
    funding = bars.select("series", "time", ((F.col("close") - 1000) * 1e-7).alias("total"))
    return perp.account(rows, funding, PERP)


def perp_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(perp_ledger(spark, sf_dir))


def perp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(perp.account_summary(perp_ledger(spark, sf_dir), PERP))


_PERP = f"""{LEDGER.replace('$FIRST', '0')},
held AS (
  SELECT i.*, lead_high AS next_high, lead_low AS next_low, first_value(i.close) OVER (PARTITION BY i.series, i.run ORDER BY i.row) AS entry,
         sum((i.close - 1000) * 1e-7) OVER (PARTITION BY i.series, i.run ORDER BY i.row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried
  FROM islands i JOIN (SELECT b.series, b.time, lead(b.high) OVER w AS lead_high, lead(b.low) OVER w AS lead_low FROM bars b
                       WINDOW w AS (PARTITION BY series ORDER BY time)) b USING (series, time) WHERE dir <> 0),
worst AS (SELECT *, 1 + 9 * (next_low / entry - 1 - 0.00045 - carried) <= 9 * 0.05 AS broken FROM held),
cut AS (SELECT *, min(CASE WHEN broken THEN row END) OVER (PARTITION BY series, run) AS cut FROM worst),
trips AS (
  SELECT series, run, min(row) AS entry_row, max(row) + 1 AS exit_row, max(dir) AS direction, max(entry) AS entry_price,
         CASE WHEN max(cut) IS NOT NULL THEN arg_max(next_low, row) ELSE arg_max(next_close, row) END AS exit_price,
         arg_max(carried, row) AS carried, max(cut) IS NOT NULL AS liquidated
  FROM cut WHERE cut IS NULL OR row <= cut GROUP BY series, run),
factors AS (
  SELECT *, 9 * (exit_price / entry_price - 1) AS gross, 9 * 0.00045 * (1 + exit_price / entry_price) AS fee, 9 * carried AS paid FROM trips),
made AS (
  SELECT *, CASE WHEN liquidated THEN 0 ELSE greatest(1 + gross - fee - paid, 0) END AS factor FROM factors),
path AS (
  SELECT *, 50 * coalesce(product(factor) OVER (PARTITION BY series ORDER BY entry_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS unit FROM made),
stopped AS (
  SELECT *, max(CASE WHEN unit * 9 < 10 OR unit <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY entry_row) AS stop FROM path),
account AS (
  SELECT series, entry_row, exit_row, direction, entry_price, exit_price, liquidated, unit * 9 AS notional, unit * gross AS gross_pnl,
         unit * fee AS fees, unit * paid AS funding, unit * (gross - fee - paid) AS net_pnl, unit * factor AS equity_after
  FROM stopped WHERE stop = 0)"""


def _voted(spark: SparkSession, sf_dir: str, rule: confluence.Rule, bear: float) -> DataFrame:
    bars = quoted(spark, sf_dir)
    w = Window.partitionBy("series").orderBy("time").rowsBetween(-2, 0)

    def told(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("log_return", X.log_return())
        return rows.select("series", "time", F.avg("log_return").over(w).alias("expected"), F.lit(1.0).alias("bull"), F.lit(bear).alias("bear"))

    seen = confluence.stack(bars, {"bias": (told(B.rollup(bars, 4)), 4), "setup": (told(B.rollup(bars, 2)), 2), "trigger": (told(bars), 1)})
    done = confluence.combine(confluence.votes(seen, rule), rule)
    return done.select("series", "time", "ready", "bulls", "bears", "agreement", "position")


def confluence_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir, confluence.Rule(), 0.0)


def confluence_shorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides: three must agree to enter, a position is held until nobody votes for it, and a flip passes through flat."""
    return _voted(spark, sf_dir, confluence.Rule(exit_on_bias_flip=False, allow_short=True), 1.0)


_BARS = QUOTED[: QUOTED.index(",\nreturns AS")]
_ROLE = """{role} AS (
  SELECT series, idx, avg(lr) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS e FROM (
    SELECT series, idx, coalesce(ln(greatest(close, 1e-18) / greatest(lag(close) OVER (PARTITION BY series ORDER BY idx), 1e-18)), CAST(0 AS DOUBLE)) AS lr
    FROM (SELECT series, g AS idx, arg_max(close, idx) AS close FROM (SELECT *, idx // {f} AS g FROM base) GROUP BY series, g HAVING count(*) = {f})))"""
_VOTES = f"""WITH {_BARS},
base AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY time) - 1 AS idx FROM bars),
{_ROLE.format(role='bias', f=4)},
{_ROLE.format(role='setup', f=2)},
{_ROLE.format(role='trig', f=1)},
seen AS (
  SELECT b.series, b.time, x.e AS be, y.e AS se, z.e AS te FROM base b
  LEFT JOIN bias x ON x.series = b.series AND x.idx = (b.idx + 1) // 4 - 1
  LEFT JOIN setup y ON y.series = b.series AND y.idx = (b.idx + 1) // 2 - 1
  LEFT JOIN trig z ON z.series = b.series AND z.idx = b.idx),
votes AS (
  SELECT *, be IS NOT NULL AND se IS NOT NULL AND te IS NOT NULL AS ready,
         coalesce(CAST(be > 0 AS INTEGER) + CAST(se > 0 AS INTEGER) + CAST(te > 0 AS INTEGER), 0) AS bulls,
         coalesce(CAST(be < 0 AS INTEGER) + CAST(se < 0 AS INTEGER) + CAST(te < 0 AS INTEGER), 0) AS bears FROM seen)
SELECT series, time, ready, bulls, bears, CASE WHEN ready THEN bulls - bears ELSE 0 END AS agreement,
       coalesce(last_value(CASE WHEN NOT ready THEN CAST(0 AS DOUBLE) WHEN be > 0 AND bulls = 3 THEN CAST(1 AS DOUBLE)
                                WHEN NOT be > 0 THEN CAST(0 AS DOUBLE) END IGNORE NULLS)
                OVER (PARTITION BY series ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CAST(0 AS DOUBLE)) AS position
FROM votes"""


_SHORTS = _VOTES[: _VOTES.index("SELECT series, time, ready")].replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY time) AS k FROM votes),
held AS (
  SELECT series, k, CASE WHEN ready AND be > 0 AND bulls = 3 THEN 1 WHEN ready AND be < 0 AND bears = 3 THEN -1 ELSE 0 END AS side FROM placed WHERE k = 1
  UNION ALL
  SELECT p.series, p.k, CASE WHEN NOT p.ready THEN 0
         WHEN h.side = 1 THEN CASE WHEN p.bulls = 0 THEN 0 ELSE 1 END
         WHEN h.side = -1 THEN CASE WHEN p.bears = 0 THEN 0 ELSE -1 END
         WHEN p.be > 0 AND p.bulls = 3 THEN 1 WHEN p.be < 0 AND p.bears = 3 THEN -1 ELSE 0 END
  FROM held h JOIN placed p ON p.series = h.series AND p.k = h.k + 1)
SELECT series, time, ready, bulls, bears, CASE WHEN ready THEN bulls - bears ELSE 0 END AS agreement, CAST(side AS DOUBLE) AS position
FROM placed JOIN held USING (series, k)"""


def rotation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nulls.rotation_null(traded(spark, sf_dir), nulls.shift_table(spark, TRIALS), COST))


_SHUFFLE = f"""WITH {TRADED}, shifts AS (SELECT CAST(t AS BIGINT) AS trial FROM range({TRIALS}) AS u(t)),
own AS (SELECT series, row_number() OVER w - 1 AS i, position, ret FROM traded WINDOW w AS (PARTITION BY series ORDER BY row)),
dealt AS (
  SELECT series, trial, i, ret, row_number() OVER (PARTITION BY series, trial ORDER BY
         (((trial + 1) * 7919 + i * 104729 + 13) * 48271 % 2147483647) * 16807 % 2147483647, i) - 1 AS j FROM own CROSS JOIN shifts),
totals AS (
  SELECT d.series, d.trial, product(1 + p.position * d.ret) - 1 AS total FROM dealt d JOIN own p ON p.series = d.series AND p.i = d.j GROUP BY ALL),
actual AS (SELECT series, product(1 + position * ret) - 1 AS actual, avg(CASE WHEN abs(position) > 1e-9 THEN 1 ELSE 0 END) AS exposure FROM own GROUP BY series),
lists AS (
  SELECT series, actual, exposure, list_sort(list(total)) AS l, count(*) FILTER (WHERE total >= actual) AS beat, count(*) AS trials
  FROM totals JOIN actual USING (series) GROUP BY ALL)
SELECT series, {rs('actual', 'exposure')}, {r(f'l[{int(0.5 * (TRIALS - 1)) + 1}]', 'median_random')}, {r(f'l[{int(0.05 * (TRIALS - 1)) + 1}]', 'p05')},
       {r(f'l[{int(0.95 * (TRIALS - 1)) + 1}]', 'p95')}, {r('beat / CAST(trials AS DOUBLE)', 'p_value')}, trials FROM lists"""
_SHIFTS = f"shifts AS (SELECT CAST(t AS BIGINT) AS trial, ((t + 99) * 7919 + 104729) % 1000003 AS draw FROM range({TRIALS}) AS u(t))"
_ROTATION = f"""WITH {TRADED}, {_SHIFTS},
own AS (SELECT series, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series) AS n, position, ret FROM traded WINDOW w AS (PARTITION BY series ORDER BY row)),
turned AS (
  SELECT a.series, s.trial, a.i, a.ret, b.position FROM own a CROSS JOIN shifts s
  JOIN own b ON b.series = a.series AND b.i = (a.i + 1 + s.draw % greatest(a.n - 1, 1)) % a.n),
turn_nets AS (
  SELECT *, position * ret - abs(position - coalesce(lag(position) OVER (PARTITION BY series, trial ORDER BY i), 0)) * {COST} * 1e-4 AS net FROM turned),
totals AS (SELECT series, trial, product(1 + net) - 1 AS total FROM turn_nets GROUP BY ALL),
actual AS (SELECT series, product(1 + net) - 1 AS actual, avg(CASE WHEN abs(position) > 1e-9 THEN 1 ELSE 0 END) AS exposure FROM nets GROUP BY series),
lists AS (
  SELECT series, actual, exposure, list_sort(list(total)) AS l, count(*) FILTER (WHERE total >= actual) AS beat, count(*) AS trials
  FROM totals JOIN actual USING (series) GROUP BY ALL)
SELECT series, {rs('actual', 'exposure')}, {r(f'l[{int(0.5 * (TRIALS - 1)) + 1}]', 'median_random')}, {r(f'l[{int(0.05 * (TRIALS - 1)) + 1}]', 'p05')},
       {r(f'l[{int(0.95 * (TRIALS - 1)) + 1}]', 'p95')}, {r('beat / CAST(trials AS DOUBLE)', 'p_value')}, trials FROM lists"""


def rotation_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series against every rotation of its positions."""
    return rounded(rotation.rotation_exact(traded(spark, sf_dir), COST))


_EXACT = f"""WITH {TRADED},
own AS (SELECT series, list(position ORDER BY row) AS p, list(ret ORDER BY row) AS r, count(*) AS n FROM traded GROUP BY series),
turned AS (SELECT series, k AS shift, list_concat(p[k + 1:], p[:k]) AS q, r FROM own, unnest(range(0, n)) AS u(k)),
totals AS (
  SELECT series, shift, list_aggregate(list_transform(list_zip(q, r, list_prepend(CAST(0 AS DOUBLE), q)),
         lambda z: 1 + z[1] * z[2] - abs(z[1] - z[3]) * {COST} * 1e-4), 'product') - 1 AS total FROM turned),
actual AS (SELECT series, total AS actual FROM totals WHERE shift = 0)
SELECT series, {r('actual')}, count(*) AS shifts, {r('count(*) FILTER (WHERE total >= actual - 1e-12 * (1 + abs(actual))) / CAST(count(*) AS DOUBLE)', 'p_exact')}
FROM totals JOIN actual USING (series) WHERE shift > 0 GROUP BY series, actual"""


def permutation_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without costs, against free orders of the positions."""
    return rounded(nulls.permutation_test(traded(spark, sf_dir), nulls.shift_table(spark, TRIALS), 0.0))


def forecast_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasts(spark, sf_dir)
    ahead = F.exp(F.lead("log_return").over(Window.partitionBy("series").orderBy("row"))) - 1
    rows = rows.select("series", "time", F.col("expected").alias("forecast"), ahead.alias("ret"))
    return align.align_panel(rows, ["forecast", "ret"])


def forecast_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecast.forecast_test(forecast_panel(spark, sf_dir), nulls.shift_table(spark, TRIALS), (1, 4)))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge a bar, bars held and spread of returns of each series' positions, in basis points."""
    rows = traded(spark, sf_dir)
    before = F.coalesce(F.lag("position").over(Window.partitionBy("series").orderBy("row")), F.lit(0.0))
    return rows.withColumn("entered", ((F.col("position") > 0) & (before <= 0)).cast("int")).groupBy("series").agg(
        (F.avg(F.when(F.col("position") > 0, F.col("ret"))) * 1e4).alias("edge_bps"), (F.sum("position") / F.nullif(F.sum("entered"), F.lit(0))).alias("hold")
    )


def power_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What it takes to see the edge that each series' positions have had, at their own holds and at ten times the edge."""
    own = _edges(spark, sf_dir).where("hold is not null").select("series", "edge_bps", "hold", F.explode(F.array(F.lit(1.0), F.lit(10.0))).alias("times"))
    asked = own.select(F.round(F.abs("edge_bps") * F.col("times"), 6).alias("edge_bps"), F.round("hold", 6).alias("hold"))
    return rounded(power.table(asked, power.Edge(0, 1, 40, 9, 0.65, 48)))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_panel(traded(spark, sf_dir).select("series", "time", "position", "ret"), ["position", "ret"])


def pooled_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nulls.pooled_statistic(panel(spark, sf_dir), 4.5))


def panel_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nulls.per_series(panel(spark, sf_dir), 4.5))


def panel_rotation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nulls.panel_test(panel(spark, sf_dir), nulls.shift_table(spark, TRIALS), 4.5))


_PANEL = f"""WITH {TRADED}, {_SHIFTS},
axis AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM traded)),
panel AS (
  SELECT s.series, a.time, a.i, a.n, t.position, t.ret FROM axis a CROSS JOIN (SELECT DISTINCT series FROM traded) s
  LEFT JOIN traded t ON t.series = s.series AND t.time = a.time),
pnets AS (
  SELECT *, (position * ret - 4.5e-4 * abs(position - coalesce(last_value(position IGNORE NULLS) OVER w, 0))) * 1e4 AS net
  FROM panel WINDOW w AS (PARTITION BY series ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pturned AS (
  SELECT a.series, s.trial, a.i, a.ret, b.position FROM panel a CROSS JOIN shifts s
  JOIN panel b ON b.series = a.series AND b.i = (a.i + 1 + s.draw % greatest(a.n - 1, 1)) % a.n),
ptrials AS (
  SELECT trial, avg(net) AS bps FROM (
    SELECT *, (position * ret - 4.5e-4 * abs(position - coalesce(last_value(position IGNORE NULLS) OVER w, 0))) * 1e4 AS net
    FROM pturned WINDOW w AS (PARTITION BY series, trial ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY trial),
pactual AS (SELECT coalesce(avg(net), 0) AS bps, count(net) AS observations FROM pnets)"""


def panel_rotation_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled statistic against every rotation common to all series."""
    return rounded(rotation.panel_exact(panel(spark, sf_dir), 4.5))


_FORECAST_TEST = f"""WITH {POSITIONS}, {_SHIFTS},
told AS (SELECT series, time, expected AS forecast, exp(lead(log_return) OVER (PARTITION BY series ORDER BY row)) - 1 AS ret FROM positions),
axis AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM told)),
own AS (
  SELECT s.series, a.i, a.n, t.forecast, t.ret FROM axis a CROSS JOIN (SELECT DISTINCT series FROM told) s
  LEFT JOIN told t ON t.series = s.series AND t.time = a.time),
later AS (
  SELECT series, i, n, 1 AS horizon, ret FROM own WHERE ret IS NOT NULL
  UNION ALL SELECT * FROM (
    SELECT series, i, n, 4 AS horizon, CASE WHEN count(ret) OVER w = 4 THEN product(1 + ret) OVER w - 1 END AS ret FROM own
    WINDOW w AS (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE ret IS NOT NULL),
turned AS (
  SELECT series, horizon, ret, CAST(-1 AS BIGINT) AS trial, i AS j FROM later
  UNION ALL SELECT series, horizon, ret, trial, (i + 1 + draw % greatest(n - 1, 1)) % n FROM later CROSS JOIN shifts),
pairs AS (
  SELECT trial, horizon, o.forecast AS f, t.ret AS r FROM turned t JOIN own o ON o.series = t.series AND o.i = t.j WHERE o.forecast IS NOT NULL),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY trial, horizon ORDER BY f) + (count(*) OVER (PARTITION BY trial, horizon, f) - 1) / 2.0 AS rf,
         rank() OVER (PARTITION BY trial, horizon ORDER BY r) + (count(*) OVER (PARTITION BY trial, horizon, r) - 1) / 2.0 AS rr FROM pairs),
each AS (
  SELECT trial, horizon, count(*) AS n, corr(f, r) AS ic, corr(rf, rr) AS rk, covar_pop(f, r) / var_pop(f) AS slope FROM ranked GROUP BY ALL),
trials AS (
  SELECT trial, max(CASE WHEN horizon = 1 THEN n END) AS n, max(CASE WHEN horizon = 1 THEN ic END) AS ic, max(CASE WHEN horizon = 1 THEN slope END) AS slope,
         sum(rk) / 2 AS rk FROM each GROUP BY trial),
drawn AS (SELECT list_sort(list(ic)) AS ics, list_sort(list(rk)) AS ranks, count(*) AS trials FROM trials WHERE trial >= 0),
seen AS (SELECT n AS observations, slope, ic, rk, ics, ranks, trials, ranks[{min(TRIALS - 1, int(0.5 * TRIALS)) + 1}] AS centre FROM trials, drawn WHERE trial = -1)
SELECT observations, {rs('slope', 'ic')}, {r('rk', 'rank_ic')},
       {r('(len(list_filter(ics, lambda d: d >= ic)) + 1) / CAST(trials + 1 AS DOUBLE)', 'p_value')},
       {r('(len(list_filter(ranks, lambda d: abs(d - centre) >= abs(rk - centre))) + 1) / CAST(trials + 1 AS DOUBLE)', 'p_rank')},
       {r('(len(list_filter(ranks, lambda d: d <= rk)) + 1) / CAST(trials + 1 AS DOUBLE)', 'p_rank_lower')},
       {', '.join(r(f'ics[{min(TRIALS - 1, int(f * TRIALS)) + 1}]', f'{n}_ic') for f, n in ((0.5, 'median'), (0.05, 'p05'), (0.95, 'p95')))},
       {', '.join(r(f'ranks[{min(TRIALS - 1, int(f * TRIALS)) + 1}]', f'{n}_rank_ic') for f, n in ((0.5, 'median'), (0.05, 'p05'), (0.95, 'p95')))}, trials
FROM seen"""


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen strategies, three costs by series, with the logs of their hourly net returns."""
    rows = forecasts(spark, sf_dir).withColumn("cost_bps", F.explode(F.array(*map(F.lit, (0.0, 5.0, 20.0)))))
    rows = rows.withColumn("cell", F.concat_ws("/", "series", F.col("cost_bps").cast("int").cast("string")))
    w = Window.partitionBy("cell").orderBy("row")
    event = F.when(F.col("expected") > 2e-4 * F.col("cost_bps"), 1.0).when(F.col("expected") <= 0, 0.0)
    rows = rows.withColumn("position", F.coalesce(F.last(event, True).over(w), F.lit(0.0))).withColumn("ret", F.exp(F.lead("log_return").over(w)) - 1)
    rows = strategy.accounted(rows.where("ret is not null"), F.col("cost_bps"), ("cell",))
    return rows.select(F.col("cell").alias("series"), "time", F.log(F.greatest(1 + F.col("net"), F.lit(1e-9))).alias("value"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategies on one clock: log nets summed on a grid of four hours."""
    grid = align.bucket_grid(_logs(spark, sf_dir), "value", 4 * HOUR)
    return grid.withColumn("i", snooping.place_on_grid(4 * HOUR))


_CELLS = f"""WITH RECURSIVE {QUOTED},
levels AS (
  SELECT f.*, c AS cost_bps, f.series || '/' || CAST(CAST(c AS INTEGER) AS VARCHAR) AS cell,
         -avg(log_return) OVER (PARTITION BY f.series, c ORDER BY row ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS expected
  FROM features f, unnest([0.0::DOUBLE, 5, 20]) AS u(c)),
lpos AS (
  SELECT *, coalesce(last_value(CASE WHEN expected > 2e-4 * cost_bps THEN CAST(1 AS DOUBLE) WHEN expected <= 0 THEN CAST(0 AS DOUBLE) END IGNORE NULLS)
            OVER (PARTITION BY cell ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CAST(0 AS DOUBLE)) AS position,
         exp(lead(log_return) OVER (PARTITION BY cell ORDER BY row)) - 1 AS ret FROM levels),
lnet AS (
  SELECT cell, time, ln(greatest(1 + position * ret - abs(position - coalesce(lag(position) OVER (PARTITION BY cell ORDER BY row), 0)) * cost_bps * 1e-4, 1e-9)) AS v
  FROM lpos WHERE ret IS NOT NULL),
lsum AS (SELECT cell, time // 14400 AS bucket, sum(v) AS v FROM lnet GROUP BY ALL),
lgrid AS (SELECT unnest(range(min(bucket), max(bucket) + 1)) AS bucket, min(bucket) AS zero FROM lsum),
cells AS (
  SELECT c.cell AS series, g.bucket * 14400 AS time, g.bucket - g.zero AS i, coalesce(s.v, CAST(0 AS DOUBLE)) AS value
  FROM lgrid g CROSS JOIN (SELECT DISTINCT cell FROM lsum) c LEFT JOIN lsum s ON s.cell = c.cell AND s.bucket = g.bucket)"""
RESAMPLES, BLOCK = 1000, 6.0


def _family(spark: SparkSession, sf_dir: str):
    """Statistics and resampled means of all cells; each is read several times by every test, so it is computed once."""
    cells = settled(_cells(spark, sf_dir))
    n = cells.agg(F.max("i")).first()[0] + 1
    blocks = snooping.resample_blocks(spark, n, RESAMPLES, BLOCK)
    return settled(snooping.long_run(cells, BLOCK)), settled(snooping.block_means(cells, blocks, n))


_FAMILY = f"""{_CELLS},
size AS (SELECT max(i) + 1 AS n FROM cells),
draws AS (
  SELECT b, i, n, ((b * 7919 + i * 104729 + 13) * 48271 % 2147483647) * 16807 % 2147483647 AS u,
         (((b + 1000003) * 7919 + i * 104729 + 13) * 48271 % 2147483647) * 16807 % 2147483647 % n AS first
  FROM size, range({RESAMPLES}) AS x(b), unnest(range(n)) AS y(i)),
starts AS (
  SELECT *, last_value(CASE WHEN i = 0 OR u < {int(2_147_483_647 / BLOCK)} THEN {{'at': i, 'first': first}} END IGNORE NULLS)
         OVER (PARTITION BY b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM draws),
resamples AS (SELECT b, i, (s['first'] + i - s['at']) % n AS j FROM starts),
means AS (SELECT c.series, r.b, avg(c.value) AS boot FROM resamples r JOIN cells c ON c.i = r.j GROUP BY ALL),
base_stats AS (SELECT series, count(*) AS n, avg(value) AS mean FROM cells GROUP BY series),
cov AS (
  SELECT a.series, z.n, b.i - a.i AS lag, sum((a.value - z.mean) * (b.value - z.mean)) / z.n AS c
  FROM cells a JOIN base_stats z ON z.series = a.series JOIN cells b ON b.series = a.series AND b.i >= a.i AND b.i - a.i <= 165
  GROUP BY a.series, z.n, b.i - a.i),
weights AS (
  SELECT *, CAST(n - lag AS DOUBLE) / n * pow({1 - 1 / BLOCK}::DOUBLE, lag) + CAST(lag AS DOUBLE) / n * pow({1 - 1 / BLOCK}::DOUBLE, n - lag) AS w FROM cov),
stats AS (
  SELECT b.series, b.n, b.mean, sqrt(greatest(x.v, 0)) AS omega FROM base_stats b JOIN (
    SELECT series, sum(CASE WHEN lag = 0 THEN c WHEN w >= 1e-12 THEN 2 * w * c ELSE 0 END) AS v FROM weights GROUP BY series) x USING (series)),
tstats AS (SELECT *, CASE WHEN omega > 0 THEN sqrt(n) * mean / omega ELSE 0 END AS t FROM stats)"""


def long_run_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snooping.long_run(_cells(spark, sf_dir), BLOCK), 8)


def rc_max_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snooping.reality_check(*_family(spark, sf_dir)))


def spa_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snooping.spa(*_family(spark, sf_dir)))


def rw_stepdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snooping.step_down(*_family(spark, sf_dir)))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snooping.moments(_cells(spark, sf_dir)))


def effective_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snooping.effective_trials(_cells(spark, sf_dir)))


def pair_corr_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.price_features(quoted(spark, sf_dir)).select("series", "time", F.col("log_return").alias("value"))
    return rounded(snooping.pair_correlations(rows))


def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snooping.deflated_sharpe(snooping.moments(settled(_cells(spark, sf_dir)))))


def block_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snooping.block_lengths(_cells(spark, sf_dir)))


def judge_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir).withColumn("step", F.lit(HOUR))
    return rounded(snooping.judge(logs, 4 * HOUR, RESAMPLES))


_M = "avg(pow(c.value - m, {k}::DOUBLE))"


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell for each series and number of bars rolled together."""
    out = None
    for factor in (1, 2, 4):
        w = Window.partitionBy("series").orderBy("row").rowsBetween(-2, 0)
        rows = X.price_features(B.rollup(quoted(spark, sf_dir), factor)).withColumn("expected", -F.avg("log_return").over(w))
        done = strategy.metrics(strategy.traded(strategy.long_only(rows, ENTRY, 0.0)), 5.0, 8766.0 / factor)
        done = done.select("series", F.lit(factor).alias("cell"), F.col("position_changes").alias("trades"), "exposure", (F.col("total_return") - F.col("buy_hold_return")).alias("excess"), (1 - F.col("hit_rate")).alias("miss_rate"), F.when(F.col("bars") < 150, "too few bars").alias("skipped"))
        out = done if out is None else out.unionByName(done)
    return out


def best_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screen.best_cells(_sweep(spark, sf_dir), then="miss_rate").drop("skipped"))


def rejected_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are made to fail: too few trades of one series, too much exposure or no result of others."""
    name = F.col("series")
    cells = _sweep(spark, sf_dir).withColumns(
        {
            "trades": F.when(name == "click", F.col("cell")).otherwise(F.col("trades")),
            "exposure": F.when(name == "view", 0.95).otherwise(F.col("exposure")),
            "skipped": F.when(name == "purchase", "no fit").otherwise(F.col("skipped")),
        }
    )
    cells = cells.withColumn("trades", F.when((name == "click") & (F.col("cell") > 2), 2).otherwise(F.col("trades")))
    return screen.rejection_reasons(cells, then="miss_rate")


def top_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as venues, one a nation, that publish their markets as parallel arrays; some are delisted or have no price."""
    rows = tape.read_table(spark, sf_dir, "supplier")
    market = F.struct(
        "s_suppkey", F.col("s_name").alias("names"), F.col("s_acctbal").alias("marks"), (F.col("s_acctbal") - F.col("s_nationkey")).alias("previous"),
        F.col("s_nationkey").cast("double").alias("interest"), ((F.col("s_suppkey") * 37) % 1009).cast("double").alias("notional"), (F.col("s_suppkey") % 7 == 0).alias("delisted"),
    )
    listed = rows.groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 1000).alias("page")).agg(F.collect_list(market).alias("l"))  # pages of a thousand
    names = ("names", "marks", "previous", "interest", "notional", "delisted")
    universe = listed.select(*(F.col(f"l.{c}").alias(c) for c in names))
    return rounded(screen.top_markets(screen.markets_of(universe), 25))


def markets_with_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every market with its best cell, and defaults for those that have none."""
    rows = tape.read_table(spark, sf_dir, "events").select(F.col("event_type").alias("series")).distinct()
    markets = rows.unionByName(rows.select(F.concat("series", F.lit("-perp")).alias("series")))
    best = screen.best_cells(_sweep(spark, sf_dir), then="miss_rate").select("series", "cell", "trades", "excess")
    return rounded(screen.with_defaults(markets, best, "series", {"cell": 0, "trades": 0, "excess": 0.0}))


def sanitized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with hidden characters put in, blanks around, too long or empty."""
    rows = tape.read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    odd = F.when(F.col("p_partkey") % 5 == 0, F.lit(" \u200b\u202e ")).when(F.col("p_partkey") % 5 == 1, F.repeat("p_name", 6)).otherwise(
        F.concat(F.lit("  "), F.substring("p_name", 1, 3), F.lit("\u0007\ufeff"), F.substring("p_name", 4, 99), F.lit(" "))
    )
    return rows.select("p_partkey", screen.sanitize(odd, 30).alias("name"))


def _pool_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recorded pages of a listing, a hundred pools a page; every tenth pool is on the next page as well."""
    part = tape.read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    page = F.floor(F.col("p_partkey") / 100) + 1
    pool = F.struct(
        F.struct(
            F.when(F.col("p_partkey") % 50 == 7, F.lit(None)).otherwise(F.concat(F.lit("0x"), F.col("p_partkey"))).alias("address"),
            F.concat(F.regexp_replace("p_name", " ", "-"), F.lit(" / USD")).alias("name"), F.col("p_retailprice").cast("string").alias("base_token_price_usd"),
            F.when(F.col("p_partkey") % 20 == 3, "0").otherwise(F.col("p_retailprice").cast("string")).alias("reserve_in_usd"),
            F.lit("2024-01-01T00:00:00Z").alias("pool_created_at"), F.struct((F.col("p_size") * 10).cast("string").alias("h24")).alias("volume_usd"),
            F.struct(F.struct(F.col("p_size").alias("buys"), (F.col("p_partkey") % 7).alias("sells")).alias("h24")).alias("transactions"),
        ).alias("attributes"),
        F.struct(F.struct(F.struct(F.lit("swap").alias("id")).alias("data")).alias("dex")).alias("relationships"),
    )
    pages = F.when(F.col("p_partkey") % 10 == 0, F.array(page, page + 1)).otherwise(F.array(page))
    rows = part.select(F.explode(pages).alias("page"), "p_partkey", pool.alias("pool"))
    listed = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "pool"))).alias("l"))
    body = F.to_json(F.struct(F.transform("l", lambda x: x["pool"]).alias("data")))
    return listed.select(F.lit("net").alias("network"), F.col("page").cast("int").alias("page"), body.alias("body"))


def top_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screen.top_pools(_pool_pages(spark, sf_dir), F.lit("2024-03-01").cast("timestamp"))
    found = found.withColumn("turnover", F.when(F.col("turnover") < float("inf"), F.col("turnover")))
    return rounded(found.select("address", "name", "base", "quote", "dex", "price", "liquidity", "volume", "trades", "age_days", "score", "turnover"))


def trending_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screen.trending_pools(_pool_pages(spark, sf_dir), 20).select("address", "name", "price", "volume", "liquidity", "change_24h"))


def _sweep_sql() -> str:
    parts = []
    for factor in (1, 2, 4):
        parts.append(f"""m{factor} AS (
  SELECT series, {factor} AS cell, count(*) FILTER (WHERE delta > 1e-9) AS trades, avg(CASE WHEN abs(position) > 1e-9 THEN 1 ELSE 0 END) AS exposure,
         product(1 + net) - product(1 + ret) AS excess,
         1 - coalesce(count(*) FILTER (WHERE position > 1e-9 AND position * ret > 0) / nullif(CAST(count(*) FILTER (WHERE position > 1e-9) AS DOUBLE), 0), 0) AS miss_rate,
         CASE WHEN count(*) < 150 THEN 'too few bars' END AS skipped
  FROM (SELECT *, abs(position - coalesce(lag(position) OVER w, 0)) AS delta, position * ret - abs(position - coalesce(lag(position) OVER w, 0)) * 5e-4 AS net FROM (
    SELECT *, exp(lead(lr) OVER (PARTITION BY series ORDER BY idx)) - 1 AS ret,
           coalesce(last_value(CASE WHEN e > {ENTRY} THEN CAST(1 AS DOUBLE) WHEN e <= 0 THEN CAST(0 AS DOUBLE) END IGNORE NULLS)
             OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CAST(0 AS DOUBLE)) AS position FROM (
      SELECT *, -avg(lr) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS e FROM (
        SELECT * FROM (SELECT series, idx, coalesce(ln(close / lag(close) OVER (PARTITION BY series ORDER BY idx)), CAST(0 AS DOUBLE)) AS lr, count(*) OVER (PARTITION BY series) AS n
          FROM (SELECT series, g AS idx, arg_max(close, idx) AS close FROM (SELECT *, idx // {factor} AS g FROM base) GROUP BY series, g HAVING count(*) = {factor}))
        WHERE idx >= 5 AND n >= 7)))
    WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY idx)) GROUP BY series)""")
    return f"""WITH {_BARS},
base AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY time) - 1 AS idx FROM bars),
{', '.join(parts)},
sweep AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m4),
best AS (
  SELECT * FROM sweep WHERE skipped IS NULL AND trades >= 3 AND exposure <= 0.9
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY excess DESC, miss_rate, cell) = 1)"""


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol"), (F.col("p_retailprice") * 400).alias("liquidity"),
        (F.col("p_size") * 9000.0).alias("volume"), (F.col("p_partkey") % 30).alias("age_days"),
    )


_LISTINGS = """WITH listings AS (
  SELECT p_partkey AS id, p_name AS symbol, p_retailprice * 400 AS liquidity, p_size * 9000.0::DOUBLE AS volume, p_partkey % 30 AS age_days FROM part),
scored AS (SELECT *, sqrt(greatest(liquidity, 0) * greatest(volume, 0)) AS score FROM listings)"""


def screen_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screen.screen(_listings(spark, sf_dir), 10))


def search_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screen.search(_listings(spark, sf_dir), "$ring", 300_000, 50_000))


def bar_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape.read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("days"), (F.col("p_partkey") % 90 + 6).alias("bars_per_day"))
    return screen.bar_budget(rows)


_WIN = "(PARTITION BY series ORDER BY row)"
SQL = {
    "position_hysteresis": f"WITH {POSITIONS} SELECT series, row, {rs('expected', 'position')} FROM positions",
    "compound_cost": f"WITH {TRADED} SELECT series, {r('product(1 + net) - 1', 'total')} FROM nets GROUP BY series",
    "equity_curve": f"WITH {TRADED} SELECT series, row, {rs('net', 'equity', 'buy_hold', 'drawdown')} FROM drawn",
    "bt_metrics": f"""WITH {TRADED}, logs AS (SELECT *, ln(greatest(1 + net, 1e-9)) AS l FROM drawn)
SELECT series, {r('CASE WHEN stddev_samp(l) > 0 THEN avg(l) / stddev_samp(l) * sqrt(8766::DOUBLE) ELSE 0 END', 'sharpe')}, {r('max(drawdown)', 'max_drawdown')},
       {r('coalesce(count(*) FILTER (WHERE position > 1e-9 AND position * ret > 0) / nullif(CAST(count(*) FILTER (WHERE position > 1e-9) AS DOUBLE), 0), 0)', 'hit_rate')},
       count(*) FILTER (WHERE delta > 1e-9) AS position_changes, {r('sum(delta)', 'turnover')},
       {r('count(*) FILTER (WHERE position > 1e-9) / CAST(count(*) AS DOUBLE)', 'exposure')}, count(*) AS bars, {r(f'sum(delta * {COST} * 1e-4)', 'cost_drag')},
       {r('arg_max(equity, row) - 1', 'total_return')}, {r('arg_max(buy_hold, row) - 1', 'buy_hold_return')} FROM logs GROUP BY series""",
    "cost_sweep": f"""WITH {POSITIONS},
levels AS (SELECT f.*, c AS cost_bps FROM forecasts f, unnest([0.0::DOUBLE, 5, 10, 20, 30, 50]) AS u(c)),
lpos AS (
  SELECT *, coalesce(last_value(CASE WHEN expected > 2 * cost_bps * 1e-4 THEN CAST(1 AS DOUBLE) WHEN expected <= 0 THEN CAST(0 AS DOUBLE) END IGNORE NULLS)
            OVER (PARTITION BY series, cost_bps ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CAST(0 AS DOUBLE)) AS p,
         exp(lead(log_return) OVER (PARTITION BY series, cost_bps ORDER BY row)) - 1 AS ret FROM levels),
lnet AS (SELECT *, abs(p - coalesce(lag(p) OVER (PARTITION BY series, cost_bps ORDER BY row), 0)) AS d FROM lpos WHERE ret IS NOT NULL)
SELECT series, cost_bps, {r('product(1 + p * ret - d * cost_bps * 1e-4) - 1', 'total_return')}, count(*) FILTER (WHERE d > 1e-9) AS position_changes FROM lnet GROUP BY ALL""",
    "trade_ledger": f"""WITH {_LEDGER} SELECT series, entry_row, exit_row, entry_time, exit_time, direction, bars_held,
{rs('entry_price', 'exit_price', 'gross_return', 'cost_paid', 'net_return')} FROM ledger""",
    "trade_stats": f"""WITH {_LEDGER}
SELECT series, count(*) AS trades, count(*) FILTER (WHERE net_return > 0) AS wins, {r('count(*) FILTER (WHERE net_return > 0) / CAST(count(*) AS DOUBLE)', 'win_rate')},
       {r('product(1 + net_return) - 1', 'roi')}, {r('coalesce(avg(net_return) FILTER (WHERE net_return > 0), 0)', 'avg_win')},
       {r('coalesce(avg(net_return) FILTER (WHERE net_return <= 0), 0)', 'avg_loss')}, {r('max(net_return)', 'best_trade')}, {r('min(net_return)', 'worst_trade')},
       {r('avg(bars_held)', 'avg_bars_held')},
       {r('coalesce(sum(net_return) FILTER (WHERE net_return > 0), 0) / nullif(coalesce(abs(sum(net_return) FILTER (WHERE net_return <= 0)), 0), 0)', 'profit_factor')}
FROM ledger GROUP BY series""",
    "trade_windows": f"""WITH {_LEDGER},
last AS (SELECT series, max(time) AS t, arg_max(close, time) AS c, arg_min(close, time) AS f FROM bars GROUP BY series),
spans AS (SELECT l.*, s.span, l.t - s.secs AS at FROM last l, (VALUES ('24h', 86400), ('5d', 432000), ('1w', 604800), ('2w', 1209600)) AS s(span, secs)),
priced AS (SELECT s.*, coalesce(b.close, s.f) AS price FROM spans s ASOF LEFT JOIN bars b ON s.series = b.series AND s.at >= b.time)
SELECT p.series, p.span, count(g.net_return) AS trades, count(*) FILTER (WHERE g.net_return > 0) AS wins,
       {r('coalesce(product(1 + g.net_return) - 1, 0)', 'roi')}, {r('p.c / p.price - 1', 'buy_hold')}
FROM priced p LEFT JOIN ledger g ON g.series = p.series AND g.entry_time >= p.at GROUP BY p.series, p.span, p.c, p.price""",
    "ceiling_oracle": f"""WITH {QUOTED},
own AS (
  SELECT series, row_number() OVER {_WIN} - 1 AS i, ret FROM (
    SELECT series, row, exp(lead(log_return) OVER {_WIN}) - 1 AS ret FROM features) WHERE ret IS NOT NULL),
held AS (
  SELECT series, i, ret, h AS hold, CASE WHEN product(1 + ret) OVER (PARTITION BY series, h, i // h) > 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p
  FROM own, unnest([1, 5, 20]) AS u(h)),
moved AS (SELECT *, abs(p - coalesce(lag(p) OVER (PARTITION BY series, hold ORDER BY i), 0)) AS d FROM held)
SELECT series, hold, c AS cost_bps, {r('sum(ln(1 + p * ret - d * c * 1e-4))', 'log_growth')}, count(*) FILTER (WHERE d > 1e-9) AS position_changes,
       {r('avg(p)', 'exposure')}, {r('sum(ln(1 + ret))', 'log_buy_hold')}, count(*) AS bars
FROM moved, unnest([0.0::DOUBLE, 10, 30, 50]) AS v(c) GROUP BY ALL""",
    "perp_account": f"""WITH {_PERP} SELECT series, entry_row, exit_row, direction, liquidated,
{rs('entry_price', 'exit_price', 'notional', 'gross_pnl', 'fees', 'funding', 'net_pnl', 'equity_after')} FROM account""",
    "perp_summary": f"""WITH {_PERP}
SELECT series, count(*) AS trades, count(*) FILTER (WHERE net_pnl > 0) AS wins, {r('arg_max(equity_after, entry_row)', 'final_equity')},
       {r('sum(fees)', 'total_fees')}, {r('sum(funding)', 'total_funding')}, max(liquidated) AS liquidated,
       CAST(sum(exit_row - entry_row) AS BIGINT) AS bars_in_market FROM account GROUP BY series""",
    "confluence_votes": _VOTES,
    "rotation_null": _ROTATION,
    "rotation_exact": _EXACT,
    "confluence_shorts": _SHORTS,
    "pooled_stat": f"{_PANEL} SELECT {r('bps')}, observations FROM pactual",
    "panel_per_series": f"""{_PANEL} SELECT series, count(net) AS bars, {r('coalesce(avg(net), 0)', 'net_bps')},
{r('avg(CASE WHEN position IS NOT NULL THEN CASE WHEN abs(position) > 1e-9 THEN 1 ELSE 0 END END)', 'exposure')} FROM pnets GROUP BY series""",
    "panel_rotation_null": f"""{_PANEL},
lists AS (SELECT a.bps, a.observations, list_sort(list(t.bps)) AS l, count(*) FILTER (WHERE t.bps >= a.bps) AS beat, count(*) AS trials
          FROM ptrials t, pactual a GROUP BY ALL)
SELECT observations, {r('bps', 'actual_bps')}, {r(f'l[{min(TRIALS - 1, int(0.5 * TRIALS)) + 1}]', 'median_bps')}, {r(f'l[{min(TRIALS - 1, int(0.05 * TRIALS)) + 1}]', 'p05_bps')},
       {r(f'l[{min(TRIALS - 1, int(0.95 * TRIALS)) + 1}]', 'p95_bps')}, {r('(beat + 1) / CAST(trials + 1 AS DOUBLE)', 'p_value')}, trials FROM lists""",
    "long_run_variance": f"{_FAMILY} SELECT series, n, {rs('mean', 'omega', places=8)} FROM stats",
    "rc_max_stat": f"""{_FAMILY},
actual AS (SELECT max(sqrt(n) * mean) AS statistic, arg_max(series, (sqrt(n) * mean, series)) AS best FROM stats),
tops AS (SELECT b, max(sqrt(n) * (boot - mean)) AS v FROM means JOIN stats USING (series) GROUP BY b)
SELECT best, {r('statistic')}, {r('(1 + count(*) FILTER (WHERE v >= statistic)) / CAST(count(*) + 1 AS DOUBLE)', 'p_value')} FROM tops, actual GROUP BY best, statistic""",
    "spa_stat": f"""{_FAMILY},
g AS (
  SELECT *, mean AS gu, greatest(mean, 0) AS gl,
         CASE WHEN mean >= -omega / sqrt(n) * CASE WHEN n >= 16 THEN sqrt(2 * ln(ln(n))) ELSE 0 END THEN mean ELSE 0 END AS gc FROM tstats),
actual AS (SELECT greatest(max(t), 0) AS statistic, arg_max(series, (t, series)) AS best, count(*) AS models FROM g),
tops AS (
  SELECT b, greatest(max(sqrt(n) * (boot - gu) / omega), 0) AS u, greatest(max(sqrt(n) * (boot - gl) / omega), 0) AS l,
         greatest(max(sqrt(n) * (boot - gc) / omega), 0) AS c FROM means JOIN g USING (series) WHERE omega > 0 GROUP BY b)
SELECT best, {r('statistic')}, models, {', '.join(r(f'(1 + count(*) FILTER (WHERE {v} >= statistic)) / CAST(count(*) + 1 AS DOUBLE)', f'p_{k}') for v, k in (('u', 'upper'), ('l', 'lower'), ('c', 'consistent')))}
FROM tops, actual GROUP BY best, statistic, models""",
    "rw_stepdown": f"""{_FAMILY},
ranked AS (SELECT *, row_number() OVER (ORDER BY t DESC, series) AS rank FROM tstats),
z AS (
  SELECT m.b, k.series, k.t, k.rank, max(CASE WHEN omega > 0 THEN sqrt(n) * (boot - mean) / omega END)
         OVER (PARTITION BY m.b ORDER BY k.rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS top
  FROM means m JOIN ranked k USING (series)),
raw AS (SELECT series, t, rank, (1 + count(*) FILTER (WHERE top >= t)) / CAST(count(*) + 1 AS DOUBLE) AS p FROM z GROUP BY ALL),
adjusted AS (SELECT series, t, rank, max(p) OVER (ORDER BY rank) AS adjusted_p FROM raw)
SELECT series, rank, {rs('t', 'adjusted_p')}, adjusted_p <= 0.05 AS rejected FROM adjusted""",
    "moments": f"""{_CELLS}, m AS (SELECT series AS s, avg(value) AS m, count(*) AS n FROM cells GROUP BY series),
p AS (SELECT c.series, n, m, {_M.format(k=2)} AS m2, {_M.format(k=3)} AS m3, {_M.format(k=4)} AS m4 FROM cells c JOIN m ON s = c.series GROUP BY ALL)
SELECT series, n, {r('CASE WHEN m2 > 0 THEN m / sqrt(m2) ELSE 0 END', 'sharpe')}, {r('CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5::DOUBLE) ELSE 0 END', 'skew')},
       {r('CASE WHEN m2 > 0 THEN m4 / (m2 * m2) ELSE 3 END', 'kurtosis')} FROM p""",
    "effective_trials": f"""{_CELLS},
pairs AS (
  SELECT a.series AS x, b.series AS y, coalesce(CASE WHEN var_pop(a.value) > 0 AND var_pop(b.value) > 0
         THEN covar_pop(a.value, b.value) / sqrt(var_pop(a.value) * var_pop(b.value)) END, 0) AS rho
  FROM cells a JOIN cells b ON a.i = b.i AND a.series < b.series GROUP BY ALL),
one AS (SELECT avg(rho) AS rho, (SELECT count(DISTINCT series) FROM cells) AS models FROM pairs)
SELECT models, {r('rho')}, {r('greatest(1, rho + (1 - rho) * models)', 'effective')} FROM one""",
    "pair_corr_avg": f"""WITH {QUOTED}
SELECT a.series AS "left", b.series AS "right", count(*) AS n, {r('covar_pop(a.log_return, b.log_return) / sqrt(var_pop(a.log_return) * var_pop(b.log_return))', 'rho')}
FROM features a JOIN features b ON a.time = b.time AND a.series < b.series GROUP BY ALL HAVING count(*) >= 30""",
    "best_by_series": f"{_sweep_sql()} SELECT series, cell, trades, {rs('exposure', 'excess', 'miss_rate')} FROM best",
    "rejected_series": f"""{_sweep_sql()},
made AS (
  SELECT series, cell, CASE WHEN series = 'click' THEN least(cell, 2) ELSE trades END AS trades, CASE WHEN series = 'view' THEN 0.95 ELSE exposure END AS exposure,
         CASE WHEN series = 'purchase' THEN 'no fit' ELSE skipped END AS skipped FROM sweep)
SELECT series, CASE WHEN count(*) FILTER (WHERE skipped IS NULL) = 0 THEN arg_min(skipped, cell)
       WHEN max(CASE WHEN skipped IS NULL THEN trades END) < 3 THEN 'no cell traded more than ' || max(CASE WHEN skipped IS NULL THEN trades END) || ' times'
       WHEN min(CASE WHEN skipped IS NULL THEN exposure END) > 0.9 THEN 'every cell is in the market more than 90% of the time'
       ELSE 'no cell has 3 trades and at most 90% exposure' END AS reason
FROM made GROUP BY series HAVING count(*) FILTER (WHERE skipped IS NULL AND trades >= 3 AND exposure <= 0.9) = 0""",
    "top_markets": f"""SELECT s_name AS coin, {r('s_acctbal', 'mark')}, {r('CAST(s_suppkey * 37 % 1009 AS DOUBLE)', 'notional')},
       {r('coalesce(s_acctbal / nullif(s_acctbal - s_nationkey, 0) - 1, 0)', 'change_24h')}, {r('s_nationkey * s_acctbal', 'open_interest')}
FROM supplier WHERE s_suppkey % 7 <> 0 AND s_acctbal > 0 ORDER BY s_suppkey * 37 % 1009 DESC, s_name LIMIT 25""",
    "markets_with_best": f"""{_sweep_sql()},
markets AS (SELECT DISTINCT event_type AS series FROM events UNION ALL SELECT DISTINCT event_type || '-perp' FROM events)
SELECT m.series, coalesce(b.cell, 0) AS cell, coalesce(b.trades, 0) AS trades, {r('coalesce(b.excess, 0)', 'excess')} FROM markets m LEFT JOIN best b USING (series)""",
    "sanitized_names": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '?' WHEN length(n) > 30 THEN substr(n, 1, 30) || '...' ELSE n END AS name
FROM (SELECT p_partkey, trim(CASE WHEN p_partkey % 5 = 1 THEN repeat(p_name, 6) ELSE p_name END) AS n FROM part)""",
    "top_pools": f"""SELECT '0x' || p_partkey AS address, n AS name, replace(p_name, ' ', '-') AS base, 'USD' AS quote, 'swap' AS dex, {r('p_retailprice', 'price')},
       {r('liquidity')}, {r('p_size * 10.0::DOUBLE', 'volume')}, CAST(p_size + p_partkey % 7 AS BIGINT) AS trades, {r('60.0::DOUBLE', 'age_days')},
       {r('sqrt(liquidity * p_size * 10)', 'score')}, {r('CASE WHEN liquidity > 0 THEN p_size * 10 / liquidity END', 'turnover')}
FROM (SELECT *, CASE WHEN length(replace(p_name, ' ', '-') || ' / USD') > 32 THEN substr(replace(p_name, ' ', '-') || ' / USD', 1, 32) || '...' ELSE replace(p_name, ' ', '-') || ' / USD' END AS n,
             CASE WHEN p_partkey % 20 = 3 THEN CAST(0 AS DOUBLE) ELSE p_retailprice END AS liquidity FROM part) WHERE p_partkey % 50 <> 7""",
    "trending_pools": f"""SELECT CASE WHEN p_partkey % 50 = 7 THEN '' ELSE '0x' || p_partkey END AS address, n AS name, {r('p_retailprice', 'price')}, {r('p_size * 10.0::DOUBLE', 'volume')},
       {r('CASE WHEN p_partkey % 20 = 3 THEN 0 ELSE p_retailprice END', 'liquidity')}, CAST(0 AS DOUBLE) AS change_24h
FROM (SELECT *, CASE WHEN length(replace(p_name, ' ', '-') || ' / USD') > 32 THEN substr(replace(p_name, ' ', '-') || ' / USD', 1, 32) || '...' ELSE replace(p_name, ' ', '-') || ' / USD' END AS n FROM part)
WHERE p_partkey < 100 ORDER BY p_partkey LIMIT 20""",
    "screen_top": f"""{_LISTINGS},
good AS (SELECT *, volume / liquidity AS turnover FROM scored WHERE liquidity >= 250000 AND volume >= 100000 AND volume / liquidity <= 50 AND age_days >= 7),
one AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY lower(symbol) ORDER BY score DESC, symbol, id) = 1)
SELECT id, symbol, age_days, {rs('liquidity', 'volume', 'score', 'turnover')} FROM (SELECT * FROM one ORDER BY score DESC, id LIMIT 10)""",
    "search_pairs": f"""{_LISTINGS} SELECT id, symbol, age_days, {rs('liquidity', 'volume', 'score')} FROM scored
WHERE lower(symbol) LIKE '%ring%' AND liquidity >= 300000 AND volume >= 50000""",
    "bar_budgets": """WITH b AS (SELECT p_partkey AS id, p_size AS days, p_partkey % 90 + 6 AS bars_per_day FROM part),
c AS (SELECT *, days * bars_per_day AS wanted, least(days * bars_per_day, 5000) AS bars FROM b),
d AS (SELECT *, least(greatest(CAST(floor(bars * 0.5 + 0.5) AS BIGINT), 300), 1500) AS train_size FROM c),
e AS (SELECT *, least(greatest(CAST(floor(train_size / 3 + 0.5) AS BIGINT), 100), 500) AS test_size FROM d)
SELECT *, wanted > 5000 AS truncated, bars >= train_size + test_size + 2 AS fits FROM e""",
}

SQL["permutation_shuffle"] = _SHUFFLE
SQL["forecast_test"] = _FORECAST_TEST
SQL["positions_with_shorts"] = f"""WITH RECURSIVE {POSITIONS},
told AS (SELECT series, row, row // 100 AS block, row % 100 AS k, expected FROM forecasts),
held AS (
  SELECT series, block, k, row, CASE WHEN expected > 0.002 THEN CAST(1 AS DOUBLE) WHEN expected < -0.002 THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS position
  FROM told WHERE k = 0
  UNION ALL
  SELECT t.series, t.block, t.k, t.row, CASE
    WHEN h.position > 0 THEN CASE WHEN t.expected > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    WHEN h.position < 0 THEN CASE WHEN t.expected < 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    WHEN t.expected > 0.002 THEN CAST(1 AS DOUBLE) WHEN t.expected < -0.002 THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  FROM held h JOIN told t ON t.series = h.series AND t.block = h.block AND t.k = h.k + 1)
SELECT series, row, position FROM held"""
#: The lag windows reach at most n - 1; autocovariances of every lag come from a self-join.
SQL["block_lengths"] = f"""{_CELLS},
z AS (SELECT series, i, value - avg(value) OVER (PARTITION BY series) AS x, count(*) OVER (PARTITION BY series) AS n, max(abs(value)) OVER (PARTITION BY series) AS top FROM cells),
cov AS (
  SELECT a.series, a.n, a.top, b.i - a.i AS k, sum(a.x * b.x) / a.n AS c FROM z a JOIN z b ON b.series = a.series AND b.i >= a.i
  WHERE b.i - a.i <= ceil(sqrt(a.n)) + 2 * greatest(5, ceil(sqrt(log10(a.n)))) GROUP BY a.series, a.n, a.top, b.i - a.i),
rho AS (
  SELECT *, abs(c / first_value(c) OVER (PARTITION BY series ORDER BY k)) AS size, first_value(c) OVER (PARTITION BY series ORDER BY k) AS c0,
         2 * sqrt(log10(n) / n) AS band, greatest(5, ceil(sqrt(log10(n)))) AS quiet FROM cov),
runs AS (
  SELECT *, count(*) OVER w AS ahead, max(size) OVER w AS loudest FROM rho
  WINDOW w AS (PARTITION BY series ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
reach AS (
  SELECT series, any_value(n) AS n, any_value(c0) AS c0, any_value(top) AS top, any_value(quiet) AS quiet,
         coalesce(min(CASE WHEN k >= 1 AND ahead = 5 AND loudest < band THEN k END), max(CASE WHEN k >= 1 AND size > band THEN k END)) AS m FROM runs GROUP BY series),
wide AS (SELECT *, greatest(1, least(2 * m, ceil(sqrt(n)) + quiet, n - 1)) AS w FROM reach),
sums AS (
  SELECT w.series, w.n, w.m, w.c0, w.top, 2 * sum(CASE WHEN k BETWEEN 1 AND w THEN least(greatest(2 * (1 - k / w), 0), 1) * k * c ELSE 0 END) AS g,
         w.c0 + 2 * sum(CASE WHEN k BETWEEN 1 AND w THEN least(greatest(2 * (1 - k / w), 0), 1) * c ELSE 0 END) AS s
  FROM wide w JOIN cov USING (series) GROUP BY w.series, w.n, w.m, w.c0, w.top)
SELECT series, {r('''CASE WHEN n < 8 OR sqrt(greatest(c0, 0)) <= 1e-12 * CASE WHEN top > 0 THEN top ELSE 1 END OR m IS NULL OR s = 0 THEN 1
       ELSE least(greatest(pow(g * g / (s * s), 1.0 / 3) * pow(n, 1.0 / 3), 1), CASE WHEN pow(g * g / (s * s), 1.0 / 3) * pow(n, 1.0 / 3) < 1 THEN 1 ELSE ceil(least(3 * sqrt(n), n / 3.0)) END) END''', 'block')} FROM sums"""

#: Every rotation, the panel joined to itself once for each of them.
SQL["panel_rotation_exact"] = f"""{_PANEL},
eturned AS (
  SELECT a.series, s.shift, a.i, a.ret, b.position FROM panel a, LATERAL (SELECT unnest(range(1, a.n)) AS shift) s
  JOIN panel b ON b.series = a.series AND b.i = (a.i + s.shift) % a.n),
etrials AS (
  SELECT shift, avg(net) AS bps FROM (
    SELECT *, (position * ret - 4.5e-4 * abs(position - coalesce(last_value(position IGNORE NULLS) OVER w, 0))) * 1e4 AS net
    FROM eturned WINDOW w AS (PARTITION BY series, shift ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY shift)
SELECT a.observations, {r('a.bps', 'actual_bps')}, count(*) AS shifts,
       {r('count(*) FILTER (WHERE t.bps >= a.bps - 1e-9 * (1 + abs(a.bps))) / CAST(count(*) AS DOUBLE)', 'p_exact')}
FROM etrials t, pactual a GROUP BY a.observations, a.bps"""
#: The normal distribution as 1/2 and its density times a series of positive terms; its inverse by halving.
_PHI = """CASE WHEN {z} > 6.5 THEN 1 WHEN {z} < -6.5 THEN 0 ELSE 0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) *
  list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(2.0 * k + 2) + k * ln(2) + lgamma(k + 1.0)))) END"""
SQL["deflated_sharpe"] = f"""{_CELLS}, m AS (SELECT series AS s, avg(value) AS m, count(*) AS n FROM cells GROUP BY series),
p AS (SELECT c.series, n, m, {_M.format(k=2)} AS m2, {_M.format(k=3)} AS m3, {_M.format(k=4)} AS m4 FROM cells c JOIN m ON s = c.series GROUP BY ALL),
own AS (
  SELECT series, n, CASE WHEN m2 > 0 THEN m / sqrt(m2) ELSE 0 END AS sharpe, CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5::DOUBLE) ELSE 0 END AS skew,
         CASE WHEN m2 > 0 THEN m4 / (m2 * m2) ELSE 3 END AS kurtosis FROM p),
family AS (SELECT greatest(count(*), 2) AS trials, coalesce(var_samp(sharpe), 0) AS v FROM own),
asked AS (
  SELECT v, 1 - {EULER} AS weight, 1 - 1 / CAST(trials AS DOUBLE) AS q FROM family
  UNION ALL SELECT v, {EULER}, 1 - 1 / (trials * exp(1)) FROM family),
halved AS (
  SELECT 0 AS step, v, weight, q, 0::DOUBLE AS low, 10::DOUBLE AS high FROM asked
  UNION ALL SELECT step + 1, v, weight, q, CASE WHEN c < q THEN z ELSE low END, CASE WHEN c < q THEN high ELSE z END
  FROM (SELECT *, (low + high) / 2 AS z, {_PHI.format(z='((low + high) / 2)')} AS c FROM halved WHERE step < 60)),
bar AS (SELECT sqrt(any_value(v)) * sum(weight * low) AS benchmark FROM halved WHERE step = 60),
scored AS (SELECT *, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe AS spread FROM own, bar),
judged AS (SELECT *, CASE WHEN n >= 2 AND spread > 0 THEN (sharpe - benchmark) * sqrt(n - 1) / sqrt(spread) END AS z FROM scored)
SELECT series, {rs('sharpe', 'benchmark')}, {r(_PHI.format(z='z'), 'deflated')} FROM judged"""

_UNCHECKED = ("judge_sweep", "power_table")
QUERIES = {name: globals()[name] for name in (*SQL, *_UNCHECKED)}
