"""Registered queries over regime models: fixed models with SQL, fits and what follows from them without."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..models import blocked, grouped, signals, sweep
from ..models.grouped import _MODEL, _MODEL_NAMES
from ..operators import align, features as X, nulls, paper, strategy
from ..operators.screen import best_cells
from ..session import settled
from ..sources import tape
from .common import HOUR, r, rounded, rs
from .trading import POSITIONS, QUOTED, positions, quoted

NAMES = list(X.PRICE_FEATURES)
#: Walk-forward sizes and reach of durations that suit the length of the series here.
TRAIN, TEST, MOST = 100, 40, 20
#: Sweeps of a Gibbs chain, half of them burn-in: those of the operator.
GIBBS = 2000
PI, A = [0.5, 0.3, 0.2], [0.7, 0.2, 0.1, 0.3, 0.4, 0.3, 0.1, 0.3, 0.6]
MU, VAR, PRICE = [-2.0, 0.0, 2.0], [4.0, 2.0, 4.0], 6.0


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoted(spark, sf_dir)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.price_features(bars(spark, sf_dir))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return X.scale(rows, X.fit_scaler(rows, X.PRICE_FEATURES, F.lit(True)), X.PRICE_FEATURES)


def _fixed(rows: DataFrame) -> DataFrame:
    """The same model for every series."""
    values = {"states": F.lit(3), "pi": PI, "a": A, "mu": MU, "var": VAR, "score": F.lit(0.0), "rounds": F.lit(0)}
    types = dict(f.split() for f in _MODEL.split(", "))
    column = lambda c: F.lit(None) if c not in values else F.array(*map(F.lit, values[c])) if isinstance(values[c], list) else values[c]
    return rows.select("series").distinct().select("series", *(column(c).cast(types[c]).alias(c) for c in _MODEL_NAMES))


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("series", "row", (F.col("log_return") * 100).alias("x"))


def hmm_filter_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir)
    found = grouped.beliefs(rows, _fixed(rows), ["x"])
    return rounded(found.select("series", "row", *(F.col("now")[i].alias(f"p{i}") for i in range(3)), *(F.col("ahead")[i].alias(f"q{i}") for i in range(3))))


def viterbi_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _x(spark, sf_dir)
    return grouped.decoded(rows, _fixed(rows), ["x"])


def jump_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocked.arrived(_x(spark, sf_dir), ["x"], np.array(MU)[:, None], PRICE)


def state_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grouped.occupancy(jump_online(spark, sf_dir)))


_ROWS = f"""{QUOTED},
obs AS (SELECT series, CAST(row AS BIGINT) AS row, log_return * 100 AS x FROM features)"""
_E = ", ".join(f"exp(-0.5 * (ln(2 * pi()) + ln({v}::DOUBLE) + (x - ({m})) * (x - ({m})) / {v})) AS e{i}" for i, (m, v) in enumerate(zip(MU, VAR)))
_NEXT = [" + ".join(f"f.p{i} * {A[3 * i + j]}" for i in range(3)) for j in range(3)]
_FILTER = f"""WITH RECURSIVE {_ROWS},
dens AS (SELECT *, {_E} FROM obs),
f AS (
  SELECT series, row, {', '.join(f'{PI[j]} * e{j} / ({PI[0]} * e0 + {PI[1]} * e1 + {PI[2]} * e2) AS p{j}' for j in range(3))} FROM dens WHERE row = 0
  UNION ALL
  SELECT d.series, d.row, {', '.join(f'({_NEXT[j]}) * d.e{j} / (({_NEXT[0]}) * d.e0 + ({_NEXT[1]}) * d.e1 + ({_NEXT[2]}) * d.e2) AS p{j}' for j in range(3))}
  FROM f JOIN dens d ON d.series = f.series AND d.row = f.row + 1)
SELECT series, row, {', '.join(r(f'p{j}') for j in range(3))}, {', '.join(r(_NEXT[j], f'q{j}') for j in range(3))} FROM f"""
_L = ", ".join(f"(x - ({m})) * (x - ({m})) AS l{i}" for i, m in enumerate(MU))
_STEP = [f"d.l{j} + least(f.v{j}, least(f.v0, f.v1, f.v2) + {PRICE})" for j in range(3)]
_ONLINE = f"""{_ROWS},
loss AS (SELECT *, {_L} FROM obs),
f AS (
  SELECT series, row, l0 AS v0, l1 AS v1, l2 AS v2 FROM loss WHERE row = 0
  UNION ALL
  SELECT series, row, w0 - least(w0, w1, w2), w1 - least(w0, w1, w2), w2 - least(w0, w1, w2) FROM (
    SELECT d.series, d.row, {', '.join(f'{s} AS w{j}' for j, s in enumerate(_STEP))} FROM f JOIN loss d ON d.series = f.series AND d.row = f.row + 1)),
online AS (SELECT series, row, CASE WHEN v0 <= v1 AND v0 <= v2 THEN 0 WHEN v1 <= v2 THEN 1 ELSE 2 END AS state FROM f)"""
_LOG = [[f"ln({A[3 * i + j]}::DOUBLE)" for j in range(3)] for i in range(3)]
_BEST = [f"greatest({', '.join(f'f.s{i} + {_LOG[i][j]}' for i in range(3))})" for j in range(3)]
_FROM = [f"CASE WHEN f.s0 + {_LOG[0][j]} >= f.s1 + {_LOG[1][j]} AND f.s0 + {_LOG[0][j]} >= f.s2 + {_LOG[2][j]} THEN 0 WHEN f.s1 + {_LOG[1][j]} >= f.s2 + {_LOG[2][j]} THEN 1 ELSE 2 END" for j in range(3)]
_VITERBI = f"""WITH RECURSIVE {_ROWS},
dens AS (SELECT *, {_E} FROM obs),
f AS (
  SELECT series, row, {', '.join(f'ln({PI[j]}::DOUBLE) + ln(e{j}) AS s{j}' for j in range(3))}, 0 AS b0, 0 AS b1, 0 AS b2 FROM dens WHERE row = 0
  UNION ALL
  SELECT d.series, d.row, {', '.join(f'{_BEST[j]} + ln(d.e{j})' for j in range(3))}, {', '.join(_FROM)}
  FROM f JOIN dens d ON d.series = f.series AND d.row = f.row + 1),
ends AS (SELECT series, max(row) AS row FROM f GROUP BY series),
path AS (
  SELECT f.series, f.row, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS state FROM f JOIN ends e ON e.series = f.series AND e.row = f.row
  UNION ALL
  SELECT p.series, p.row - 1, CASE p.state WHEN 0 THEN g.b0 WHEN 1 THEN g.b1 ELSE g.b2 END FROM path p JOIN f g ON g.series = p.series AND g.row = p.row WHERE p.row > 0)
SELECT series, row, state FROM path"""


def _fit(kind: str, restarts: int = 3, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grouped.fit_models(_scaled(spark, sf_dir), NAMES, kind, restarts=restarts, **options)

    return query


hmm_fit, jump_fit, student_fit = _fit("hmm"), _fit("jump", 8), _fit("student", 2)
hsmm_fit, student_hsmm_fit = _fit("hsmm", 2, most=MOST), _fit("student_hsmm", 1, most=MOST)


def hmm_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scaled(spark, sf_dir)
    return grouped.occupancy(grouped.decoded(rows, grouped.fit_models(rows, NAMES), NAMES))


def vb_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = grouped.posterior_draws(features(spark, sf_dir), NAMES, "vb", draws=500)
    return grouped.state_intervals(draws, "means")


def vb_hsmm_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = grouped.posterior_draws(features(spark, sf_dir), NAMES, "vb_hsmm", draws=500, most=MOST)
    return grouped.state_intervals(draws, "dwell")


def gibbs_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = grouped.posterior_draws(features(spark, sf_dir), NAMES, "gibbs", chains=2, rounds=GIBBS)
    return grouped.state_intervals(draws, "means")


def posterior_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    draws = grouped.posterior_draws(rows, NAMES, "vb", draws=500)
    models = grouped.fit_models(_scaled(spark, sf_dir), NAMES, restarts=2)
    seen = grouped.beliefs(_scaled(spark, sf_dir), models, NAMES)
    last = seen.groupBy("series").agg(F.max_by("ahead", "row").alias("probs"))
    return grouped.signal_interval(draws, last, 0.0060)


def state_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.select_states(features(spark, sf_dir), NAMES, (2, 3, 4))


def _forecasts(spark: SparkSession, sf_dir: str, kind: str, **options) -> DataFrame:
    return grouped.walk_forward(features(spark, sf_dir), NAMES, kind, train=TRAIN, test=TEST, restarts=2, **options)


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecasts(spark, sf_dir, "hmm").drop("probs", "skipped")


def _results(rows: DataFrame, forecasts: DataFrame, plan: strategy.Strategy, bars_per_year: float) -> tuple[DataFrame, DataFrame]:
    """Traded rows and metrics; positions of a block begin anew, the account does not."""
    decided = strategy.decide(forecasts.drop("probs"), plan).select("series", "row", "position")
    held = rows.join(decided, ["series", "row"], "left").withColumn("position", F.coalesce("position", F.lit(0.0)))
    done = strategy.traded(held, TRAIN)
    return done, strategy.metrics(done, plan.cost_bps, bars_per_year)


def walk_forward_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = strategy.Strategy(cost_bps=4.5, duration_aware=True)
    return _results(features(spark, sf_dir), _forecasts(spark, sf_dir, "hsmm", most=MOST), plan, 8766.0)[1]


SWEEP = sweep.Plan(factors=(1, 2), kinds=("hmm", "jump"), train=TRAIN, test=TEST, restarts=2, most=MOST, trials=50, rule=strategy.Strategy(cost_bps=4.5))


def sweep_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forwards of every series, two bar lengths and two of the five kinds of model, against rotations of themselves and perfect foresight.

    A cell that cannot be had is a row that says why.
    """
    found = sweep.sweep(bars(spark, sf_dir), SWEEP)
    return found.select("series", "cell", "trades", "exposure", "total_return", "ceiling", "excess", "p_value", "skipped")


def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_cells(sweep_cells(spark, sf_dir))


def signal_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar of each series under a scaler and a model that are given, with a position at hand in half of them."""
    rows = features(spark, sf_dir).select("series", "row", "time", "log_return")
    scaler = rows.select("series").distinct().select("series", F.lit(0.0).alias("log_return_mean"), F.lit(0.01).alias("log_return_sd"))
    held = rows.select("series").distinct().select("series", F.when(F.length("series") % 2 == 0, 1.0).otherwise(0.0).alias("previous"))
    found = signals.signal_now(rows, scaler, _fixed(rows), ["log_return"], "hmm", strategy.Strategy(cost_bps=0.5, duration_aware=True), held)
    return rounded(found.select("series", "time", "target", "expected", "hold", "state", *(F.col("probs")[i].alias(f"q{i}") for i in range(3))))


def state_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the given model's states in the units of each series' returns."""
    rows = features(spark, sf_dir)
    scaler = X.fit_scaler(rows, ("log_return",), F.col("row") < TRAIN)
    return rounded(grouped.state_units(_fixed(rows), scaler, ["log_return"]).drop("volatility"), 8)


def confluence_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fitted timeframes in agreement: rows, rows in the market and mean agreement of each series."""
    found = signals.walk_forward_confluence(bars(spark, sf_dir), {"bias": 4, "setup": 2, "trigger": 1}, 240, 120)
    return found.groupBy("series").agg(F.count(F.lit(1)).alias("rows"), F.sum("position").alias("in_market"), F.avg("agreement").alias("agreement"))


def collected_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration on every series, pooled and held against common rotations."""
    rows, forecasts = features(spark, sf_dir), settled(_forecasts(spark, sf_dir, "hmm"))
    decided = strategy.decide(forecasts.drop("probs"), strategy.Strategy(cost_bps=4.5, duration_aware=True))
    panel = align.align_panel(signals.collect_panel(rows, forecasts, decided, TRAIN), ["position", "ret"])
    return nulls.panel_test(panel, nulls.shift_table(spark, 100), 4.5)


def paper_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bars(spark, sf_dir)
    plan = strategy.Strategy(cost_bps=4.5)
    decided = strategy.decide(_forecasts(spark, sf_dir, "hmm").drop("probs"), plan)
    rows = features(spark, sf_dir).join(decided.select("series", "row", "position"), ["series", "row"])
    targets = rows.join(own.select("series", "time", "high", "low"), ["series", "time"]).select(
        F.col("series").alias("account"), F.col("series").alias("coin"), "time", "high", "low", "close", F.col("position").alias("target")
    )
    return paper.replay(targets)


def paper_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper.statistics(paper_log(spark, sf_dir))


_PAPER_ENTRY = 0.002


def _paper_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's positions for accounts of one coin each."""
    own = bars(spark, sf_dir)
    held = positions(spark, sf_dir).join(own.select("series", "time", "high", "low"), ["series", "time"])
    return held.select(F.col("series").alias("account"), F.col("series").alias("coin"), "time", "high", "low", "close", F.col("position").alias("target"))


def paper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts at three times leverage that follow a rule, bar by bar."""
    found = paper.replay(_paper_targets(spark, sf_dir), paper.Config(leverage=3.0))
    return rounded(found.select("account", "time", "equity", "buy_hold", "position", "fee", "reason"))


def _block_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw for each two days of each series: mean and dwell of each state of the online jump model, 0 where it does not occur."""
    w = Window.partitionBy("series").orderBy("row")
    rows = jump_online(spark, sf_dir).join(_x(spark, sf_dir).select("series", "row", "x"), ["series", "row"])
    rows = rows.withColumn("new", F.coalesce(F.col("state") != F.lag("state").over(w), F.lit(True)))
    each = lambda k: F.col("state") == k
    mean = [F.coalesce(F.avg(F.when(each(k), F.col("x"))), F.lit(0.0)) for k in range(3)]
    dwell = [F.count_if(each(k)) / F.greatest(F.count_if(each(k) & F.col("new")), F.lit(1)) for k in range(3)]
    return rows.groupBy("series", F.floor(F.col("row") / 48).alias("draw")).agg(F.array(*mean).alias("means"), F.array(*dwell).alias("dwell"))


def block_state_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the mean of each state spreads over the blocks of a series."""
    return rounded(grouped.state_intervals(_block_draws(spark, sf_dir), "means"))


def block_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the belief at hand is worth by the means and dwells of each block, and how surely it is above a cost."""
    seen = hmm_filter_fixed(spark, sf_dir)
    now = seen.groupBy("series").agg(F.max_by(F.array("q0", "q1", "q2"), "row").alias("probs"))
    return rounded(grouped.signal_interval(_block_draws(spark, sf_dir), now, 0.05))


def paper_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the accounts of the rule came to."""
    config = paper.Config(leverage=3.0)
    return rounded(paper.statistics(paper.replay(_paper_targets(spark, sf_dir), config), config))


def path_agreement_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest states of a given model against those of the online jump model: agreement under the best naming."""
    other = jump_online(spark, sf_dir).withColumnRenamed("state", "truth")
    return rounded(grouped.best_relabelling(viterbi_fixed(spark, sf_dir).join(other, ["series", "row"]), 3))


def paper_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts between bars: marked at each tick, without a trade."""
    config = paper.Config(leverage=3.0)
    targets = _paper_targets(spark, sf_dir)
    log = paper.replay(targets, config).join(targets.select("account", "coin", "time", "close"), ["account", "coin", "time"])
    ticks = tape.event_ticks(spark, sf_dir).withColumn("price", F.col("price") + 1000)
    ticks = ticks.select("series", "time_ms", "seq", "price")
    return rounded(paper.marked(log, ticks, HOUR, config), 2)  # money, which grows large at this leverage


def path_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted and decoded states against those of the online jump model on the same bars: agreement under the best naming."""
    rows = _scaled(spark, sf_dir)
    path = grouped.decoded(rows, grouped.fit_models(rows, NAMES, restarts=2), NAMES)
    other = jump_online(spark, sf_dir).withColumnRenamed("state", "truth")
    return grouped.best_relabelling(path.join(other, ["series", "row"]), 3)


SQL = {
    "hmm_filter_fixed": _FILTER,
    "viterbi_fixed": _VITERBI,
    "jump_online": f"WITH RECURSIVE {_ONLINE} SELECT series, row, state FROM online",
    "state_occupancy": f"""WITH RECURSIVE {_ONLINE},
starts AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY series ORDER BY row) THEN 1 ELSE 0 END AS new FROM online),
sums AS (SELECT series, state, count(*) AS rows, CAST(sum(new) AS BIGINT) AS runs FROM starts GROUP BY ALL)
SELECT series, state, rows, runs, {r('rows / CAST(sum(rows) OVER (PARTITION BY series) AS DOUBLE)', 'share')}, {r('rows / CAST(runs AS DOUBLE)', 'mean_run')} FROM sums""",
}
SQL["signal_now"] = f"""{_FILTER[: _FILTER.rindex("SELECT series, row")].rstrip()},
ends AS (SELECT series, max(row) AS row FROM f GROUP BY series),
ahead AS (
  SELECT f.series, x.time, f.p0, f.p1, f.p2, {', '.join(f'{q} AS q{j}' for j, q in enumerate(_NEXT))}, CASE WHEN length(f.series) % 2 = 0 THEN 1 ELSE 0 END AS previous
  FROM f JOIN ends e ON e.series = f.series AND e.row = f.row JOIN features x ON x.series = f.series AND x.row = f.row),
told AS (SELECT *, 0.01 * ({' + '.join(f'q{j} * ({m})' for j, m in enumerate(MU))}) AS expected FROM ahead)
SELECT series, time, CASE WHEN expected > CASE WHEN previous > 0 THEN 0 ELSE 1e-4 / {1 / (1 - A[8])} END THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS target,
       {r('expected')}, {r(f'CAST({1 / (1 - A[8])} AS DOUBLE)', 'hold')}, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS state, {rs('q0', 'q1', 'q2')} FROM told"""
SQL["state_units"] = f"""WITH {QUOTED},
scaler AS (SELECT series, avg(log_return) AS m, greatest(stddev_pop(log_return), 1e-12) AS s FROM features WHERE row < {TRAIN} GROUP BY series)
SELECT series, state, {r(f'CASE state {" ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(MU))} END * s + m', 'mean_return', 8)}
FROM scaler, (VALUES (0), (1), (2)) AS v(state)"""
_ACCOUNTS = f"""WITH RECURSIVE {POSITIONS},
told AS (
  SELECT p.series AS account, p.time, b.high, b.low, p.close, p.position AS target, row_number() OVER (PARTITION BY p.series ORDER BY p.time) AS k
  FROM positions p JOIN bars b ON b.series = p.series AND b.time = p.time),
acc AS (
  SELECT account, k, time, close, 1000::DOUBLE AS equity, 1000::DOUBLE AS hold, target AS position, abs(target) * 3000 * 4.5e-4 AS fee,
         CASE WHEN target > 0 THEN 'entry' ELSE '' END AS reason, 1000 - abs(target) * 3000 * 4.5e-4 AS cash, target * 3000 AS notional, false AS dead FROM told WHERE k = 1
  UNION ALL
  SELECT account, k, time, close, equity, hold, CASE WHEN gone THEN CAST(0 AS DOUBLE) ELSE target END,
         CASE WHEN gone THEN notional * 4.5e-4 ELSE abs(target - position) * equity * 3 * 4.5e-4 END,
         CASE WHEN gone THEN 'liquidation' WHEN target = position THEN '' WHEN target = 0 THEN 'exit' ELSE 'entry' END,
         CASE WHEN gone THEN CAST(0 AS DOUBLE) ELSE equity - abs(target - position) * equity * 3 * 4.5e-4 END,
         CASE WHEN gone THEN CAST(0 AS DOUBLE) ELSE target * equity * 3 END, gone
  FROM (
    SELECT a.account, t.k, t.time, t.close, t.target, a.position, a.notional, a.hold * t.close / a.close AS hold,
           a.position > 0 AND a.cash + a.notional * (t.low / a.close - 1) <= a.notional / 20 AS gone,
           CASE WHEN a.position > 0 AND a.cash + a.notional * (t.low / a.close - 1) <= a.notional / 20 THEN CAST(0 AS DOUBLE)
                ELSE a.cash + a.notional * (t.close / a.close - 1) END AS equity
    FROM acc a JOIN told t ON t.account = a.account AND t.k = a.k + 1 WHERE NOT a.dead) AS step)"""
SQL["paper_records"] = f"{_ACCOUNTS} SELECT account, time, {rs('equity', 'fee')}, {r('hold', 'buy_hold')}, {r('position')}, reason FROM acc"
SQL["paper_marks"] = f"""{_ACCOUNTS},
points AS (SELECT account, (time + 3600) * 1000 - 1 AS at, equity - fee AS settled, position * equity * 3 AS worth, close FROM acc)
SELECT account, account AS coin, time_ms, seq, {r('price', places=2)}, {r('settled + worth * (price / close - 1)', 'equity', 2)}
FROM ticks ASOF JOIN points ON points.account = ticks.series AND ticks.time_ms > points.at"""
SQL["paper_statistics"] = f"""{_ACCOUNTS},
points AS (
  SELECT *, lag(equity) OVER w AS before, time - lag(time) OVER w AS gap, max(equity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak,
         CASE WHEN reason = 'entry' THEN 1 WHEN reason IN ('exit', 'liquidation') THEN 0 END AS side FROM acc WINDOW w AS (PARTITION BY account ORDER BY time)),
sides AS (
  SELECT *, coalesce(last_value(side IGNORE NULLS) OVER (PARTITION BY account ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held,
         coalesce(last_value(side IGNORE NULLS) OVER (PARTITION BY account ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM points),
trips AS (
  SELECT *, last_value(CASE WHEN held = 1 AND was = 0 THEN equity END IGNORE NULLS) OVER (PARTITION BY account ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start,
         CASE WHEN before > 0 THEN ln(greatest(equity / before, 1e-9)) END AS step FROM sides),
sums AS (
  SELECT account, arg_max(CASE WHEN reason = 'liquidation' THEN 0 ELSE equity - fee END, k) / 1000 - 1 AS roi, arg_max(hold, k) / 1000 - 1 AS bought, avg(step) AS m, stddev_samp(step) AS s,
         list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps, max(CASE WHEN peak > 0 THEN 1 - equity / peak ELSE 0 END) AS max_drawdown,
         count(*) FILTER (WHERE held = 0 AND was = 1) AS round_trips, count(*) FILTER (WHERE held = 0 AND was = 1 AND equity > start) AS wins,
         count(*) FILTER (WHERE held = 1) / CAST(count(*) AS DOUBLE) AS exposure, sum(fee) / 1000 AS fee_drag FROM trips GROUP BY account)
SELECT account, {rs('roi')}, {r('CASE WHEN s > 0 AND len(gaps) > 1 THEN m / s * sqrt(31557600.0 / gaps[len(gaps) // 2 + 1]) ELSE 0 END', 'sharpe')}, {rs('max_drawdown')}, round_trips,
       {r('CASE WHEN round_trips > 0 THEN wins / CAST(round_trips AS DOUBLE) ELSE 0 END', 'win_rate')}, {rs('exposure', 'fee_drag')}, {r('roi - bought', 'over_buy_hold')} FROM sums"""
_TAIL = (1 - 0.9) / 2
_DRAWS = f"""WITH RECURSIVE {_ONLINE},
marked AS (
  SELECT o.series, o.row, o.state, b.x, CASE WHEN o.state IS DISTINCT FROM lag(o.state) OVER (PARTITION BY o.series ORDER BY o.row) THEN 1 ELSE 0 END AS new
  FROM online o JOIN obs b ON b.series = o.series AND b.row = o.row),
draws AS (
  SELECT series, row // 48 AS draw, {', '.join(f'coalesce(avg(x) FILTER (WHERE state = {k}), 0) AS m{k}' for k in range(3))},
         count(*) FILTER (WHERE state = 2) / CAST(greatest(coalesce(sum(new) FILTER (WHERE state = 2), 0), 1) AS DOUBLE) AS dwell
  FROM marked GROUP BY series, row // 48)"""


def _spread(value: str) -> str:
    """mean, low, high and the share above 0 of a group."""
    at = lambda f: f"list_sort(list({value}))[CAST(least(floor({f!r}::DOUBLE * count(*)), count(*) - 1) AS BIGINT) + 1]"
    return f"{r(f'avg({value})', 'mean')}, {r(at(_TAIL), 'low')}, {r(at(1 - _TAIL), 'high')}, {r(f'avg(CASE WHEN {value} > 0 THEN 1.0 ELSE 0.0 END)', 'p_positive')}"


SQL["block_state_means"] = f"""{_DRAWS},
long AS (SELECT series, k AS state, CASE k WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END AS value FROM draws, (VALUES (0), (1), (2)) AS v(k))
SELECT series, state, {_spread('value')} FROM long GROUP BY series, state"""
SQL["block_signal"] = f"""{_DRAWS},
seen AS ({_FILTER}),
now AS (SELECT series, arg_max(q0, row) AS q0, arg_max(q1, row) AS q1, arg_max(q2, row) AS q2 FROM seen GROUP BY series),
each AS (SELECT series, dwell AS hold, (q0 * m0 + q1 * m1 + q2 * m2) * dwell AS trade FROM draws JOIN now USING (series))
SELECT series, {_spread('trade')}, {r('list_sort(list(hold))[count(*) // 2 + 1]', 'median_hold')}, {r('avg(CASE WHEN trade > 0.05 THEN 1.0 ELSE 0.0 END)', 'p_above_cost')}
FROM each GROUP BY series"""
#: All six namings of three states.
SQL["path_agreement_fixed"] = f"""WITH likeliest AS ({_VITERBI}), arrived AS ({SQL["jump_online"]}),
pairs AS (SELECT l.series, l.state, a.state AS truth FROM likeliest l JOIN arrived a ON a.series = l.series AND a.row = l.row),
named AS (
  SELECT series, avg(CASE WHEN truth = n[state + 1] THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM pairs, (VALUES ([0, 1, 2]), ([0, 2, 1]), ([1, 0, 2]), ([1, 2, 0]), ([2, 0, 1]), ([2, 1, 0])) AS v(n) GROUP BY series, n)
SELECT series, {r('max(accuracy)', 'accuracy')} FROM named GROUP BY series"""
_UNCHECKED = (
    "hmm_fit", "hsmm_fit", "student_fit", "student_hsmm_fit", "jump_fit", "hmm_decoded", "vb_posterior", "vb_hsmm_posterior", "gibbs_posterior",
    "posterior_signal", "state_selection", "walk_forward", "walk_forward_metrics", "sweep_cells", "sweep_best", "paper_replay", "path_agreement",
    "confluence_walk_forward", "collected_panel",
)
QUERIES = {name: globals()[name] for name in (*SQL, *_UNCHECKED)}
