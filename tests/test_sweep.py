"""Sweeps that compute each cell once, say why a cell is missing, and can be rebuilt."""

import numpy as np
import pytest

from tidebar.models import sweep
from tidebar.operators import strategy

BAR = "series string, time long, open double, high double, low double, close double, volume double"
PLAN = sweep.Plan(factors=(1, 2), kinds=("hmm", "jump"), train=100, test=40, restarts=1, trials=9, hold=5, rule=strategy.Strategy(cost_bps=1))


def tape(spark, lengths):
    rows = []
    for k, (name, n) in enumerate(lengths.items()):
        rng = np.random.default_rng(k)
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 400) + 0.004 * np.sign(np.sin(np.arange(400) / 9))))
        rows += [(name, 3600 * t, float(close[t]), float(close[t] * 1.01), float(close[t] * 0.99), float(close[t]), float(100 + rng.random())) for t in range(n)]
    return spark.createDataFrame(rows, BAR).repartition(2)


def test_a_second_sweep_fits_nothing(spark, tmp_path, monkeypatch):
    path, lengths, asked = f"file://{tmp_path}/cells", {"a": 320, "b": 280, "short": 60}, []
    plain = sweep.computed
    monkeypatch.setattr(sweep, "computed", lambda bars, keys, factor, kind, *rest: (asked.append((factor, kind, sorted(r.series for r in keys.select("series").collect()))), plain(bars, keys, factor, kind, *rest))[1])
    first = {(r.series, r.cell): r for r in sweep.sweep(tape(spark, lengths), PLAN, path, now=1000).collect()}
    assert len(first) == 12 and len(asked) == 4
    assert first["short", "1/hmm"].skipped == "too few bars" and first["b", "2/jump"].skipped is not None
    own = first["a", "1/hmm"]
    assert own.skipped is None and own.ceiling > 0 and 0 <= own.p_value <= 1 and own.excess == pytest.approx(own.total_return - own.median_random)

    asked.clear()
    again = {(r.series, r.cell): r for r in sweep.sweep(tape(spark, lengths), PLAN, path, now=2000).collect()}
    assert not asked and again == first
    lengths["b"] += 1  # one more bar: other content, other keys; the rest stays
    sweep.sweep(tape(spark, lengths), PLAN, path, now=3000)
    assert asked and all(names == ["b"] for _, _, names in asked)
    assert sweep.stored(spark, path, now=3000, ttl_seconds=500).count() == 4  # what has expired is not there

    kept = spark.createDataFrame([own, first["a", "1/jump"]], sweep._RESULT)
    compared = sweep.rebuilt(tape(spark, lengths), kept, PLAN).collect()
    assert len(compared) == 2 and all(r.same for r in compared)
    wrong = kept.withColumn("total_return", kept["total_return"] + 0.01)
    assert not any(r.same for r in sweep.rebuilt(tape(spark, lengths), wrong, PLAN).collect())

    best = sweep.best_models(tape(spark, lengths), kept.selectExpr("*").withColumn("trades", kept["trades"] + 3).withColumn("exposure", kept["exposure"] * 0), PLAN).collect()
    assert [r.series for r in best] == ["a"] and best[0].skipped is None and len(best[0].mu) == 9 and best[0].log_return_sd > 0


def test_keys_depend_on_content(spark):
    keys = lambda bars, plan: {(r.series, r.factor, r.kind): r.key for r in sweep.cell_keys(bars, plan).collect()}
    bars = tape(spark, {"a": 50, "b": 50})
    one = keys(bars, PLAN)
    assert len(set(one.values())) == 8 and one == keys(bars.repartition(5), PLAN)
    assert not set(one.values()) & set(keys(bars, sweep.Plan(factors=(1, 2), kinds=("hmm", "jump"), train=101)).values())
    moved = keys(bars.withColumn("close", bars["close"] * (1 + (bars["series"] == "b").cast("int"))), PLAN)
    assert {k for k in one if one[k] != moved[k]} == {k for k in one if k[0] == "b"}


def test_cells_end_in_settled_rows(spark):
    """What a sweep gives is read from what was settled; no task holds the windows, sorts and joins of a cell, or of several, at once."""
    plan = sweep.Plan(factors=(1, 2), kinds=("jump",), train=100, test=40, restarts=1, trials=9, hold=5)
    found = sweep.sweep(tape(spark, {"a": 320}), plan)
    said = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in said for step in ("Window", "Join", "Sort", "Aggregate")), said
    assert {(r.series, r.cell) for r in found.collect()} == {("a", "1/jump"), ("a", "2/jump")}
