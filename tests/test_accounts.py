"""What an account came to, against its records taken one by one; flow columns with a hole."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidebar.operators import flow, paper

LOG = "account string, coin string, time long, equity double, buy_hold double, position double, fee double, reason string"


def by_hand(log, start):
    """Statistics of one account by its definitions, record by record."""
    log = sorted(log, key=lambda r: (r[2], r[1]))
    worth = [r[3] for r in log]
    at = lambda t: [r[3] for r in log if r[2] <= t][-1]
    steps = [math.log(max(b / a, 1e-9)) for a, b in zip(worth, worth[1:]) if a > 0]
    gaps = sorted(b[2] - a[2] for a, b in zip(log, log[1:]))
    pace = gaps[len(gaps) // 2] if len(gaps) > 1 else 0
    m = sum(steps) / max(len(steps), 1)
    s = math.sqrt(sum((x - m) ** 2 for x in steps) / max(len(steps) - 1, 1))
    peak, down = worth[0], 0.0
    for w in worth:
        peak = max(peak, w)
        down = max(down, 1 - w / peak if peak > 0 else 0)
    opened, spans, trips, wins = {}, [], 0, 0
    for _, coin, t, *_, reason in log:
        if reason in ("exit", "liquidation") and coin in opened:
            trips, wins = trips + 1, wins + (at(t) > at(opened[coin]))
            spans.append((opened.pop(coin), t))
        elif reason in ("entry", "flip"):
            opened.setdefault(coin, t)
    spans += [(t, math.inf) for t in opened.values()]
    last = log[-1]
    roi = (0.0 if last[7] == "liquidation" else last[3] - last[6]) / start - 1
    exposed = sum(any(a <= r[2] < b for a, b in spans) for r in log) / len(log)
    sharpe = m / s * math.sqrt(365.25 * 86400 / pace) if s > 0 and pace > 0 else 0.0
    return roi, sharpe, down, trips, wins / trips if trips else 0.0, exposed, sum(r[6] for r in log) / start, roi - (last[4] / start - 1)


def test_statistics_against_records_taken_one_by_one(spark):
    draw = random.Random(5)
    targets = []
    for account, coins, n in (("one", "a", 40), ("two", "ab", 30), ("three", "abc", 25), ("short", "a", 1), ("pair", "a", 2)):
        for coin in coins:
            price = 100.0
            for k in range(n):
                price *= 1 + draw.uniform(-0.04, 0.042)
                if draw.random() < 0.9 or n < 3:  # coins skip bars of their own
                    targets.append((account, coin, k * 3600 * (1 + (k > 20)), price * 1.01, price * 0.98, price, float(draw.choice([-1, 0, 0, 1, 1]))))
    targets += [("broke", "a", t * 3600, p, p, p, 1.0) for t, p in enumerate([100.0, 101.0, 3.0, 4.0])]
    config = paper.Config(max_coins=2, leverage=2.0)
    given = spark.createDataFrame(targets, "account string, coin string, time long, high double, low double, close double, target double")
    log = paper.replay(given, config)
    rows = [tuple(r[c.split()[0]] for c in LOG.split(", ")) for r in log.collect()]
    found = {r[0]: r[1:] for r in paper.statistics(spark.createDataFrame(rows, LOG).repartition(3), config).collect()}
    assert set(found) == {"one", "two", "three", "short", "pair", "broke"}
    for account, got in found.items():
        assert got == pytest.approx(by_hand([r for r in rows if r[0] == account], 1000.0), abs=1e-9), account
    assert found["broke"][0] == -1.0 and found["broke"][3:5] == (1, 0.0) and found["two"][3] > 3 and 0 < found["two"][4] < 1


def test_a_flow_column_may_not_have_a_hole(spark):
    """Rows before the first valid one go; a hole behind it is an error, in the series that has it."""
    say = lambda marks: spark.createDataFrame([(s, i, m) for s, own in marks.items() for i, m in enumerate(own)], "series string, time long, valid boolean")
    fine = flow.trim_leading(say({"a": [False, False, True, True], "b": [True, True], "c": [False]}))
    assert sorted((r.series, r.time) for r in fine.collect()) == [("a", 2), ("a", 3), ("b", 0), ("b", 1)]
    with pytest.raises(PySparkException, match="hole"):
        flow.trim_leading(say({"a": [False, True, False, True], "b": [True]})).select(F.col("valid")).collect()
