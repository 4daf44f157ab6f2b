"""Hand-computed goldens of the relational operators, and that nothing looks ahead."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions.special import normal_inv
from tidebar.operators import align, bars as B, confluence, features as X, flow, nulls, paper, perp, power, rotation, screen, snooping, strategy, trades

BAR = "series string, time long, open double, high double, low double, close double, volume double"


def flat(spark, closes, step=300, start=1_000_000):
    return spark.createDataFrame([("a", start + step * i, c, c, c, c, 100.0) for i, c in enumerate(map(float, closes))], BAR)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_rollup_drops_the_incomplete_group(spark):
    bars = spark.createDataFrame([("a", 0, 10.0, 12.0, 9.0, 11.0, 100.0), ("a", 300, 11.0, 15.0, 10.0, 14.0, 200.0), ("a", 600, 14.0, 14.0, 8.0, 9.0, 300.0)], BAR)
    assert rows(B.rollup(bars, 3)) == [("a", 0, 10.0, 15.0, 8.0, 9.0, 600.0)]
    assert B.rollup(flat(spark, range(1, 8)), 3).count() == 2


def test_gaps_are_filled_up_to_a_length(spark):
    bars = spark.createDataFrame([("a", t, 11.0, 11.0, 11.0, 11.0, 5.0) for t in (0, 300, 1500)], BAR)
    assert rows(B.fill_gaps(bars, 300).select("time", "close", "volume", "filled"), "time")[2:5] == [(t, 11.0, 0.0, True) for t in (600, 900, 1200)]
    assert rows(B.gap_audit(bars, 300)) == [("a", 3, 3, 3)]
    long = spark.createDataFrame([("a", t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in (0, 30000)], BAR)
    assert rows(B.gap_fill_counts(long, 300)) == [("a", 0, 99)] and B.fill_gaps(long, 300).count() == 2


def test_higher_bar_is_seen_once_it_has_ended(spark):
    bars = flat(spark, range(1, 25))
    seen = align.completed_bar(bars, B.rollup(bars, 12), 12, ["close"]).orderBy("idx").collect()
    assert [r.higher_idx for r in seen] == [-1] * 11 + [0] * 12 + [1]
    assert [r.ready for r in seen] == [False] * 11 + [True] * 13


def test_as_of_is_strict_and_the_tolerance_inclusive(spark):
    bars = flat(spark, [1, 1, 1, 1], step=1800, start=0)
    close = lambda i: (i + 1) * 1_800_000
    points = spark.createDataFrame([("a", close(0), 10.0), ("a", close(0) + 26, 20.0), ("a", close(2) - 1, 30.0)], "series string, time_ms long, value double")
    got = rows(align.align_step(bars, points, 1800, 1_800_001).select("time", "value", "age_ms"), "time")
    assert [v for _, v, _ in got] == [None, 20.0, 30.0, 30.0] and got[3][2] == 1_800_001
    assert rows(align.align_step(bars, points, 1800, 1_800_000).select("value"), "value")[0] == (None,)
    small = align.as_of_strict(bars.select("series", (F.col("time") * 1000).alias("at")), points, "at", block_ms=1000)
    whole = align.as_of_strict(bars.select("series", (F.col("time") * 1000).alias("at")), points, "at")
    assert rows(small, "at") == rows(whole, "at")


def test_flow_scores(spark):
    bars = flat(spark, [1, 1, 1, 1, 1]).withColumn("trades", F.when(F.col("time") == 1_000_900, 40).otherwise(10).cast("long"))
    got = [r[0] for r in rows(bars.select(flow.count_surge(3).alias("s"), "time"), "time")]
    assert got[:2] == [None, None] and got[2] == pytest.approx(0, abs=1e-9) and got[3] == pytest.approx(0.6931, abs=1e-3)
    with pytest.raises(ValueError):
        flow.augment(X.price_features(flat(spark, range(1, 20)), 2), bars, ["log_return"])


def test_trade_ledger_and_compounding(spark):
    feats = X.price_features(flat(spark, [100, 100, 100, 100, 100, 110, 121, 121]), 2)
    held = feats.withColumn("position", F.when(F.col("row").isin(2, 3), 1.0).otherwise(0.0))
    one = trades.trades(held, 0).collect()
    assert len(one) == 1 and one[0].entry_price == 100 and one[0].gross_return == pytest.approx(0.21) and one[0].bars_held == 2
    paid = trades.trades(held.withColumn("position", F.when(F.col("row") == 2, 1.0).otherwise(0.0)), 100).collect()[0]
    assert paid.net_return == pytest.approx(1.1 * 0.99**2 - 1) and paid.cost_paid == pytest.approx(0.02)
    series = spark.createDataFrame([("a", 0, 1.0, 0.1), ("a", 1, 1.0, 0.1)], "series string, row long, position double, ret double")
    assert strategy.compound(series, 0).first().total == pytest.approx(0.21)
    assert strategy.compound(series.where("row = 0"), 100).first().total == pytest.approx(0.09)


def test_features_do_not_look_ahead(spark):
    closes = [100 + (7 * i) % 13 for i in range(40)]
    a = X.price_features(flat(spark, closes)).where("row < 20")
    b = X.price_features(flat(spark, closes[:30] + [999] * 10)).where("row < 20")
    assert rows(a, "row") == rows(b, "row")


def perp_rows(spark, closes, lows=None, highs=None, held=(0,)):
    lows, highs = lows or closes, highs or closes
    data = [("a", i, 3600 * i, float(c), float(h), float(x), 1.0 if i in held else 0.0) for i, (c, h, x) in enumerate(zip(closes, highs, lows))]
    df = spark.createDataFrame(data, "series string, row long, time long, close double, high double, low double, position double")
    return df.withColumn("log_return", X.log_return())


def test_perp_account(spark):
    none = spark.createDataFrame([], "series string, time long, total double")
    free = perp.Perp(50, 2, 0, 0.05, 10)
    won = perp.account(perp_rows(spark, [100, 110, 110]), none, free).first()
    assert (won.notional, won.gross_pnl, won.equity_after) == pytest.approx((100, 10, 60))
    assert perp.account(perp_rows(spark, [100, 100, 100]), none, perp.Perp(50, 2, 4.5)).first().fees == pytest.approx(0.09)
    paid = spark.createDataFrame([("a", 0, 0.01)], "series string, time long, total double")
    assert perp.account(perp_rows(spark, [100, 100, 100]), paid, free).first().funding == pytest.approx(1)
    dead = perp.account(perp_rows(spark, [100, 100, 100, 120], lows=[100, 45, 100, 120], held=(0, 2)), none, free).collect()
    assert len(dead) == 1 and dead[0].liquidated and dead[0].equity_after == 0
    assert not perp.account(perp_rows(spark, [100, 100, 100], lows=[100, 60, 100]), none, free).first().liquidated
    assert perp.account(perp_rows(spark, [100, 110, 110]), none, perp.Perp(4, 2, 0, 0.05, 10)).count() == 0


def test_pooled_statistic(spark):
    kind = "series string, time long, position double, ret double"
    held = spark.createDataFrame([("a", t, p, 0.0) for t, p in enumerate((0.0, 1.0, 1.0, 0.0))], kind)
    assert nulls.pooled_statistic(held, 10).first().bps == pytest.approx(-2 * 0.001 / 4 * 1e4)
    gone = spark.createDataFrame([("a", 0, 1.0, 0.01), ("a", 1, None, 0.02), ("a", 2, 1.0, 0.01)], kind)
    assert tuple(nulls.pooled_statistic(gone, 0).first()) == (pytest.approx(100), 2)


def test_bucket_grid(spark):
    data = [("a", t, v) for t, v in ((0, 0.01), (900, 0.02), (1800, 0.03), (2700, 0.04), (7200, 0.5))]
    got = rows(align.bucket_grid(spark.createDataFrame(data, "series string, time long, value double"), "value", 3600).select("time", "value"), "time")
    assert got == [(0, pytest.approx(0.1)), (3600, 0.0), (7200, 0.5)]


def test_power_goldens():
    e = power.Edge(4.2, 10, 40, 9, 0.65, 48)
    assert power.sharpe_per_trade(e) == pytest.approx(0.26089, abs=1e-5)
    assert power.trades_needed(e) == pytest.approx(92, abs=1) and power.bars_needed(e) == pytest.approx(1413, abs=10)
    assert power.detectable_edge(e, 1076) == pytest.approx(4.69, abs=0.01)
    assert power.t_required(240) == pytest.approx(3.529, abs=0.01) == normal_inv(1 - 0.05 / 240)
    assert power.effective_series(29, 0.431) == pytest.approx(2.22, abs=0.01)
    assert power.variance_inflation(0, 5) == 1


def test_walk_forward_sizes(spark):
    got = screen.bar_budget(spark.createDataFrame([(2000, 1), (100, 1), (20000, 1), (401, 1), (402, 1)], "days int, bars_per_day int"), cap=20000)
    assert [(r.train_size, r.test_size, r.fits) for r in got.collect()] == [(1000, 333, True), (300, 100, False), (1500, 500, True), (300, 100, False), (300, 100, True)]


def test_confluence_needs_all_three_and_one_to_leave(spark):
    kind = "series string, time long, bias_expected double, setup_expected double, trigger_expected double, bias_bull double, bias_bear double"
    votes = [(1, 1, 1), (1, -1, -1), (-1, 1, 1), (1, 1, -1), (1, 1, 1), (None, 1, 1)]
    data = [("a", i, *(None if v is None else float(v) for v in x), 1.0, 1.0) for i, x in enumerate(votes)]
    voted = confluence.votes(spark.createDataFrame(data, kind))
    for rule in (confluence.Rule(), confluence.Rule(allow_short=True)):
        assert [r.position for r in confluence.combine(voted, rule).orderBy("time").collect()] == [1, 1, 0, 0, 1, 0]


def test_shorts_pass_through_zero(spark):
    data = [("a", 0, i, x) for i, x in enumerate((0.01, -0.01, -0.01, 0.0, 0.01))]
    plan = strategy.Strategy(entry_bps=50, allow_short=True)
    got = strategy.decide(spark.createDataFrame(data, "series string, block long, row long, expected double"), plan)
    assert [r.position for r in got.orderBy("row").collect()] == [1, 0, -1, 0, 1]


def test_paper_account_pays_for_turnover_and_ignores_repeats(spark):
    kind = "account string, coin string, time long, high double, low double, close double, target double"
    data = [("x", "a", 0, 100.0, 100.0, 100.0, 1.0), ("x", "a", 3600, 110.0, 110.0, 110.0, 0.0), ("x", "a", 3600, 1.0, 1.0, 1.0, 1.0)]
    log = paper.replay(spark.createDataFrame(data, kind)).orderBy("time").collect()
    assert [r.reason for r in log] == ["entry", "exit"] and log[0].fee == pytest.approx(0.45) and log[1].equity == pytest.approx(1000 - 0.45 + 100)
    wiped = [("x", "a", 0, 100.0, 100.0, 100.0, 1.0), ("x", "a", 3600, 100.0, 5.0, 100.0, 1.0), ("x", "a", 7200, 100.0, 100.0, 100.0, 1.0)]
    log = paper.replay(spark.createDataFrame(wiped, kind), paper.Config(leverage=5)).collect()
    assert len(log) == 2 and log[1].reason == "liquidation" and log[1].equity == 0


def test_snooping_family(spark):
    rng = np.random.default_rng(0)
    data = [(f"s{k}", i, float(v)) for k in range(6) for i, v in enumerate(rng.normal(0.05 if k == 0 else 0, 0.1, 240))]
    cells = spark.createDataFrame(data, "series string, i long, value double")
    stats = snooping.long_run(cells, 4.0)
    means = snooping.resample_means(cells, snooping.resample_table(spark, 240, 100, 4.0))
    found = snooping.spa(stats, means).first()
    assert found.best == "s0" and found.p_lower <= found.p_consistent <= found.p_upper < 0.05
    steps = {r.series: r for r in snooping.step_down(stats, means).collect()}
    assert steps["s0"].rejected and not any(steps[f"s{k}"].rejected for k in range(1, 6))
    assert snooping.reality_check(stats, means).first().p_value < 0.05
    assert snooping.effective_trials(cells).first().effective == pytest.approx(6, rel=0.15)


def test_screen(spark):
    kind = "id long, symbol string, liquidity double, volume double, age_days double"
    pools = spark.createDataFrame([(1, "AA", 3e5, 2e5, 9.0), (2, "aa", 9e5, 2e5, 9.0), (3, "BB", 1e5, 9e5, 9.0), (4, "CC", 3e5, 3e5, 1.0)], kind)
    assert [r.id for r in screen.screen(pools, 5).collect()] == [2]
    assert [r.id for r in screen.search(pools, "$aa").collect()] == [2, 1]
    assert spark.range(1).select(screen.sanitize(F.lit("‮ab\x07 "))).first()[0] == "ab"


@pytest.mark.parametrize(("n", "values"), [(37, (0.0, 1.0)), (40, (-1.0, 0.0, 1.0)), (12, tuple(np.linspace(0, 1, 12))), (1, (1.0,)), (2, (0.0, 1.0))])
def test_all_rotations_at_once(n, values):
    rng = np.random.default_rng(n)
    position, ret = rng.choice(values, n), rng.normal(0, 0.02, n)
    for cost in (0.0, 0.002):
        plain = []
        for s in range(n):
            q = np.roll(position, -s)
            plain.append(np.prod(1 + q * ret - np.abs(np.diff(q, prepend=0)) * cost) - 1)
        assert np.allclose(rotation.growths(position, ret, cost), plain)
    ruin = np.where(np.arange(n) == n // 2, -1.0, ret)
    assert np.allclose(rotation.growths(position, ruin, 0.0), [np.prod(1 + np.roll(position, -s) * ruin) - 1 for s in range(n)])


def test_panel_rotations_with_holes(spark):
    """Sums and counts of each rotation by hand, and the pooled tests with common and with own rotations."""
    rng = np.random.default_rng(1)
    rows, by_hand = [], {}
    for name in "ab":
        position = np.where(rng.random(23) < 0.3, np.nan, rng.choice([0.0, 1.0], 23))
        ret = np.where(rng.random(23) < 0.2, np.nan, rng.normal(0, 0.01, 23))
        rows += [(name, t, *(None if np.isnan(v) else float(v) for v in (position[t], ret[t]))) for t in range(23)]
        for s in range(23):
            last, total, seen = 0.0, 0.0, 0
            for p, x in zip(np.roll(position, -s), ret):
                if not np.isnan(p):
                    if not np.isnan(x):
                        total, seen = total + p * x - 4.5e-4 * abs(p - last), seen + 1
                    last = p
            by_hand[name, s] = (total, seen)
    panel = spark.createDataFrame(rows, "series string, time long, position double, ret double")
    found = {(r.series, r["shift"]): (r.net, r.seen) for r in rotation.panel_rotations(panel, 4.5).collect()}
    assert found.keys() == by_hand.keys() and all(found[k] == (pytest.approx(v[0], abs=1e-12), v[1]) for k, v in by_hand.items())
    bps = [1e4 * sum(by_hand[k, s][0] for k in "ab") / sum(by_hand[k, s][1] for k in "ab") for s in range(23)]
    exact = rotation.panel_exact(panel, 4.5).first()
    assert exact.shifts == 22 and exact.actual_bps == pytest.approx(bps[0]) and exact.p_exact == pytest.approx(np.mean(np.array(bps[1:]) >= bps[0] - 1e-9))
    shifts = nulls.shift_table(spark, 40)
    drawn = [bps[(1 + r.draw % 22) % 23] for r in shifts.collect()]
    common = nulls.panel_test(panel, shifts, 4.5).first()
    assert common.p_value == pytest.approx((1 + sum(d >= bps[0] - 1e-9 for d in drawn)) / 41) and common.median_bps == pytest.approx(sorted(drawn)[20])
    assert nulls.panel_test(panel, shifts, 4.5, common=False).first().trials == 40


def test_resampled_blocks_are_the_resampled_places(spark):
    cells = spark.range(3 * 50).selectExpr("string(id % 3) AS series", "id div 3 AS i", "sin(id) AS value")
    for block in (1.0, 4.0, 60.0):
        plain = snooping.resample_means(cells, snooping.resample_table(spark, 50, 20, block))
        found = snooping.block_means(cells, snooping.resample_blocks(spark, 50, 20, block), 50)
        a, b = ({(r.series, r.b): r.boot for r in df.collect()} for df in (plain, found))
        assert a.keys() == b.keys() and len(a) == 60 and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
