"""Live decisions, beliefs kept as state, marks, listings and tests of forecasts and records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.models import bayes, chain, grouped, jump, semi, signals
from tidebar.operators import flow, forecast, nulls, paper, power, screen, snooping, strategy
from tidebar.sources import files
from tidebar.streaming import live


def model(seed=0, k=3, width=2, most=None):
    rng = np.random.default_rng(seed)
    a = rng.random((k, k)) + np.eye(k) * 3
    m = chain.Model(np.full(k, 1 / k), a / a.sum(1, keepdims=True), rng.standard_normal((k, width)), rng.random((k, width)) + 0.5)
    return semi.from_chain(m, most) if most else m


def test_beliefs_step_by_step_are_those_of_the_batch():
    x = np.random.default_rng(1).standard_normal((120, 2))
    for m, kernel in ((model(), chain), (model(most=7), semi)):
        now, ahead = kernel.predictions(m, x)
        state = None
        for t in range(len(x)):
            state, one, two = kernel.belief_step(m, x[t], state)
            assert np.allclose(one, now[t], atol=1e-9) and np.allclose(two, ahead[t], atol=1e-9)
    m, state, out = model(), None, []
    for row in x:
        state, now, _ = jump.belief_step(m, row, state, 2.0)
        out.append(int(now.argmax()))
    assert out == jump.online(jump.losses(x, m.mu), 2.0).tolist()


def test_streamed_beliefs_are_the_batch_beliefs(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([("a", t, *map(float, rng.standard_normal(2))) for t in range(60)] + [("none", 0, 0.0, 0.0)], "series string, time long, x double, y double")
    saved = spark.createDataFrame([("a", *grouped.to_row(model(), 0.0, 1).values())], "series string, " + grouped._MODEL)
    for part, when in enumerate(("time < 25", "time between 20 and 59")):
        rows.where(when).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = live.live_beliefs(stream, saved, ["x", "y"]).writeStream.format("memory").queryName("beliefs").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = {r.time: r.ahead for r in spark.table("beliefs").collect()}
    truth = grouped.beliefs(rows.withColumn("row", F.col("time")), saved, ["x", "y"]).collect()
    assert len(got) == 60 and all(np.allclose(got[r.row], r.ahead) for r in truth)


def test_scaled_semi_markov_expectations_are_those_in_logs():
    x = np.random.default_rng(3).standard_normal((90, 2))
    m = model(most=9)
    given = chain.log_emissions(m, x), *semi._weights(m)
    for one, two in zip(semi.expectations(*given), semi._expectations_in_logs(*given)):
        assert np.allclose(one, two, atol=1e-9)
    far = given[0] - 1e5 * (np.arange(90)[:, None] % 2) * np.arange(3)  # out of range at times
    for one, two in zip(semi.expectations(far, *given[1:]), semi._expectations_in_logs(far, *given[1:])):
        assert np.allclose(one, two, atol=1e-6)


@pytest.mark.parametrize("plan", [strategy.Strategy(cost_bps=5), strategy.Strategy(cost_bps=5, entry_bps=20, exit_bps=3, allow_short=True, vol_target=0.01), strategy.Strategy(cost_bps=9, duration_aware=True), strategy.Strategy(confidence=0.6)])
def test_one_step_is_a_step_of_the_sequence(spark, plan):
    rng = np.random.default_rng(4)
    rows = [("a", 0, i, float(rng.normal(0, 0.002)), float(rng.uniform(0, 0.03)), float(rng.uniform(1, 9)), float(rng.random())) for i in range(200)]
    told = spark.createDataFrame(rows, "series string, block long, row long, expected double, volatility double, hold double, top double")
    done = strategy.decide(told, plan).orderBy("row").toPandas()
    before = spark.createDataFrame([(i, float(p)) for i, p in enumerate([0.0, *done.position[:-1]])], "row long, previous double")
    got = told.join(before, "row").withColumn("position", strategy.next_position(plan)).orderBy("row").toPandas()
    assert np.allclose(got.position, done.position)


def test_confluence_blocks_and_roles(spark):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.standard_normal(400) * 0.01))
    bars = spark.createDataFrame([("a", 300 * i, *[float(c)] * 4, 10.0 + i % 7) for i, c in enumerate(close)], "series string, time long, open double, high double, low double, close double, volume double")
    base = spark.createDataFrame([("a", i) for i in range(395)], "series string, row long")
    blocks = [tuple(r)[1:] for r in signals.expanding_blocks(base, 200, 90).orderBy("block").collect()]
    assert blocks == [(0, 200, 290), (1, 290, 395)]  # the rest of 15 rows joins the last block
    found = signals.walk_forward_confluence(bars, {"bias": 4, "setup": 2, "trigger": 1}, 200, 90).orderBy("row").toPandas()
    assert found.row.tolist() == list(range(200, 395)) and set(found.position) <= {0.0, 1.0} and found.agreement.abs().max() <= 3
    # nothing looks ahead: later bars change no earlier row of a block
    fewer = signals.walk_forward_confluence(bars.where("time < 300 * 396"), {"bias": 4, "setup": 2, "trigger": 1}, 200, 90).where("row < 290").orderBy("row").toPandas()
    assert fewer.position.tolist() == found.position[:90].tolist()


def test_shuffles_keep_exposure_and_rotations_turnover(spark):
    rows = spark.createDataFrame([("a", i, float(i < 30), 0.01 if i < 30 else -0.01) for i in range(100)], "series string, row long, position double, ret double")
    shifts = nulls.shift_table(spark, 50)
    free, turned = (nulls.permutation_test(rows, shifts, c).first() for c in (0.0, 10.0))
    assert free.p_value == 0 and free.exposure == 0.3 and free.actual == pytest.approx(1.01**30 - 1)
    assert turned.p_value == 0 and abs(free.median_random - (1.01**9 * 0.99**21 - 1)) < 0.1


def test_forecasts_that_know_and_that_do_not(spark):
    rng = np.random.default_rng(6)
    rows = [(s, t, float(f), float(f * sign + rng.normal(0, 0.1))) for s, sign in (("a", 1), ("b", 1)) for t, f in enumerate(rng.standard_normal(150))]
    panel = spark.createDataFrame(rows + [("a", 150, 1.0, None), ("b", 150, None, 0.5)], "series string, time long, forecast double, ret double")
    found = forecast.forecast_test(panel, nulls.shift_table(spark, 60)).first()
    assert found.observations == 300 and found.ic > 0.9 and found.rank_ic > 0.9 and found.slope == pytest.approx(1, abs=0.05)
    assert found.p_value == pytest.approx(1 / 61) and found.p_rank == pytest.approx(1 / 61) and found.p_rank_lower == 1


def test_block_lengths():
    assert snooping.block_length(np.full(50, 0.1)) == 1 and snooping.block_length(np.arange(5.0)) == 1
    rng = np.random.default_rng(7)
    noise = rng.standard_normal(2000)
    slow = noise.copy()
    for t in range(1, 2000):
        slow[t] += 0.9 * slow[t - 1]
    assert snooping.block_length(noise) < 5 < snooping.block_length(slow)


def test_power_of_records_and_tests(spark):
    e = power.Edge(4.2, 10, 40, 9, 0.65, 48)
    assert power.break_even(9, 10) == 0.9 and power.implied_annual_sharpe(e) == pytest.approx(power.sharpe_per_trade(e) * np.sqrt(0.65 * 48 * 365.25 / 10))
    assert power.years_required(1) == pytest.approx(6.18, abs=0.01) and power.years_required(power.annual_sharpe_required(3)) == pytest.approx(3)
    assert power.permutation_trials_required(0.05) == (20, 200)
    held, _ = power.experiment(power.Edge(1, 4, 1, 0, 0.5), 24, np.random.default_rng(0))
    assert held.tolist() == [1, 1, 1, 1, 0, 0, 0, 0] * 3
    strong = power.permutation_power(spark, power.Edge(60, 40, 20, 0, 0.2), 200, 20, 59).first()
    none = power.permutation_power(spark, power.Edge(0, 5, 20, 0, 0.5), 200, 60, 59, shuffle=True).first()
    assert strong.power > 0.9 and none.power < 0.3 and strong.experiments == 20


def test_marks_move_equity_and_trade_nothing(spark):
    log = spark.createDataFrame([("x", "a", 0, 1000.0, 1.0, 1.35, 100.0), ("x", "a", 3600, 1100.0, 0.0, 1.0, 110.0)], "account string, coin string, time long, equity double, position double, fee double, close double")
    ticks = spark.createDataFrame([("a", 1_000_000, 1, 90.0), ("a", 3_600_001, 2, 120.0), ("a", 7_300_000, 3, 50.0)], "series string, time_ms long, seq long, price double")
    got = [(r.seq, r.equity) for r in paper.marked(log, ticks, 3600, paper.Config(leverage=2.0)).orderBy("seq").collect()]
    assert got == [(2, pytest.approx(1000 - 1.35 + 2000 * 0.2)), (3, 1099.0)]
    held = spark.createDataFrame([("x", "a", 998.65, 2000.0, 100.0)], "account string, coin string, cash double, notional double, price double")
    now = live.live_marks(ticks.withColumn("ts", F.timestamp_millis("time_ms")), held).orderBy("ts").collect()
    assert [r.unrealized for r in now] == pytest.approx([-200, 400, -1000])


def test_listings_and_flow_pages(spark):
    body = '{"data": [{"attributes": {"address": "0x1", "name": "A / B", "reserve_in_usd": "0", "volume_usd": {"h24": "9"}}}, {"attributes": {"name": "lost"}}, {"attributes": {"address": "0x2", "name": null, "reserve_in_usd": "x"}}]}'
    pages = spark.createDataFrame([("n", 1, body), ("n", 2, body.replace("A / B", "later")), ("n", 3, "not json")], "network string, page int, body string")
    found = {r.address: r for r in screen.top_pools(pages, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert set(found) == {"0x1", "0x2"} and (found["0x1"].base, found["0x1"].quote, found["0x1"].turnover) == ("A", "B", float("inf"))
    assert found["0x2"].name == "?" and found["0x2"].age_days is None
    assert [r.pos for r in screen.trending_pools(pages, 2).orderBy("pos").collect()] == [0, 1]
    flow = spark.createDataFrame([("a", 0, '[{"t": 60999, "o": "0", "h": "x", "l": "2", "c": "3", "v": "-1", "n": 4}, {"t": 120000, "c": "0"}]'), ("a", 1, '[{"t": 60000, "c": "9"}]')], "series string, page int, body string")
    assert [tuple(r) for r in files.flow_bars_from_pages(flow).collect()] == [("a", 60, 3.0, 3.0, 2.0, 3.0, 0.0, 4)]


def test_flow_columns_with_holes_are_errors(spark):
    columns = spark.createDataFrame([("a", 0, None, False), ("a", 1, 1.0, True), ("a", 2, None, False)], "series string, time long, x double, valid boolean")
    assert flow.trim_leading(columns.where("time < 2")).count() == 1
    with pytest.raises(Exception, match="hole"):
        flow.trim_leading(columns).collect()
    features = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2)], "series string, time long, log_return double")
    assert flow.augment(features, columns.where("valid"), ["x"]).collect() == [("a", 1, 0.1, 1.0)]
    with pytest.raises(Exception, match="not finite"):
        flow.augment(features, columns, ["x"]).collect()
    with pytest.raises(ValueError):
        flow.augment(features, columns.withColumnRenamed("x", "log_return"), ["log_return"])


def test_counts_variances_and_given_starts():
    x = np.random.default_rng(9).standard_t(4, (400, 2))
    assert chain.parameter_count(model(width=3)) == 26 and chain.parameter_count(model(width=3, most=30)) == 113 and chain.parameter_count(model(k=5, width=3)) == 54
    m, total, _ = chain.fit(x, 2, fixed_nu=5.0)
    assert m.nu.tolist() == [5.0, 5.0] and np.allclose(chain.state_variance(m), m.var * 5 / 3)
    again, better, rounds = chain.fit(x, 2, start=m, fixed_nu=5.0)
    assert rounds <= 3 and better >= total - 1e-6 * len(x)
    free, most, _ = chain.fit(x, 2, student=True)
    assert chain.state_variance(chain.Model(m.pi, m.a, m.mu, m.var, np.array([2.0, 3.0])))[0, 0] == np.inf and most >= total - 1e-3 * len(x)


def test_posteriors_of_new_rows_are_those_of_the_fit():
    x, truth = chain.sample(chain.Model(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[-2.0], [2.0]]), np.ones((2, 1))), 400, np.random.default_rng(3))
    for start in (chain.fit(x, 2)[0], semi.from_chain(chain.fit(x, 2)[0], 30)):
        q, _, _ = bayes.fit_vb(x, 2, start)
        assert (bayes.posteriors(q, x).argmax(1) == truth).mean() > 0.95
        assert np.allclose(bayes.posteriors(q, x[:50]).sum(1), 1)


def test_states_in_their_own_units(spark):
    m = model(width=2)
    saved = spark.createDataFrame([("a", *grouped.to_row(m, 0.0, 1).values())], "series string, " + grouped._MODEL)
    scaler = spark.createDataFrame([("a", 0.5, 2.0, -1.0, 0.1)], "series string, log_return_mean double, log_return_sd double, realized_vol_mean double, realized_vol_sd double")
    got = grouped.state_units(saved, scaler, ["log_return", "realized_vol"]).orderBy("state").collect()
    assert np.allclose([(r.mean_return, r.volatility) for r in got], np.stack([m.mu[:, 0] * 2 + 0.5, np.exp(m.mu[:, 1] * 0.1 - 1)], 1))


def test_composed_maps_are_the_loop(spark, monkeypatch):
    """Maps of three states by array steps, and over blocks of rows in Spark, against one row after the other."""
    import pandas as pd

    from tidebar.operators import automaton

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        maps = rng.integers(0, 3, (n, 3))
        state, plain = np.arange(3), []
        for m in maps:
            state = m[state]
            plain.append(state)
        assert (automaton.composed(maps) == np.array(plain)).all()
    monkeypatch.setattr(automaton, "BLOCK", 9)
    drawn = {s: rng.integers(0, 3, (n, 3)) for s, n in (("a", 50), ("b", 9), ("c", 1))}
    rows = spark.createDataFrame([(s, 1000 - t, [int(x) for x in m], "kept") for s, maps in drawn.items() for t, m in enumerate(maps[::-1])], "series string, time long, m array<long>, other string")
    found = automaton.walked(rows.repartition(3), "time", lambda g: np.stack(g["m"].to_list()))
    by = {(r.series, r.time): r for r in found.collect()}
    for s, maps in drawn.items():
        state, first = 1, 1000 - len(maps) + 1
        for t, m in enumerate(maps):
            state = int(m[state])
            assert by[s, first + t].position == state - 1.0 and by[s, first + t].other == "kept"


def test_best_naming_of_many_states(spark):
    import itertools

    from tidebar.models import grouped

    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 4, 5, 6):
        counts = rng.integers(0, 50, (k, k))
        assert grouped.best_assignment(counts) == max(sum(counts[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k)))
    named = rng.permutation(12)
    rows = [("a", int(named[i % 12]), i % 12) for i in range(600)] + [("a", 0, 1)] * 5
    assert grouped.best_relabelling(spark.createDataFrame(rows, "series string, state int, truth int"), 12).first().accuracy > 0.99


def test_ranks_of_ranges_are_the_ranks(spark):
    """Mid-ranks over ranges against one window, with ties, few values and a key that the splitters have not seen."""
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = [(t, h, float(x), float(y)) for t in (-1, 0, 1) for h in (1, 4) for x, y in zip(rng.integers(0, 40, 300), rng.normal(0, 1 + t * t, 300))]
    pairs = spark.createDataFrame(rows, "trial long, horizon int, forecast double, ret double").repartition(3)
    found = forecast.distributed_ranks(pairs, {"forecast": "rf", "ret": "rr"}, sample=F.col("trial") == -1).toPandas().sort_values(["trial", "horizon", "forecast", "ret"])
    plain = pd.DataFrame(rows, columns=["trial", "horizon", "forecast", "ret"]).sort_values(["trial", "horizon", "forecast", "ret"])
    for name, value in (("rf", "forecast"), ("rr", "ret")):
        assert np.allclose(found[name].to_numpy(), plain.groupby(["trial", "horizon"])[value].rank().to_numpy())
