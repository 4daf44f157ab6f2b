"""Scans by blocks and side by side, against one sequence at a time and one group a series."""

import numpy as np
import pytest

from tidebar.models import bayes, blocked, chain, grouped, jump, scan, semi
from tidebar.models.chain import Model

NAMES = ["x", "y"]


def model(seed, k=3, width=2, student=False):
    rng = np.random.default_rng(seed)
    return Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.full(k, 2.0), k), rng.normal(size=(k, width)) * 2, rng.gamma(2, 0.5, (k, width)), np.array([3.0, 6.0, 20.0])[:k] if student else None)


def batch(models, x):
    return np.stack([chain.log_emissions(m, x) for m in models]), np.stack([m.pi for m in models]), np.stack([m.a for m in models])


@pytest.mark.parametrize("n", [1, 2, 5, 30, 31, 300])
def test_blocks_of_a_batch_are_the_plain_recursions(n):
    models, x = [model(s) for s in range(4)], np.random.default_rng(n).normal(size=(n, 2)) * 2
    log_b, pi, a = batch(models, x)
    gamma, moves, total = scan.expectations(log_b, pi, a)
    u = np.random.default_rng(1).random((4, n))
    drawn = scan.sample_paths(log_b, pi, a, u)
    for i, m in enumerate(models):
        alpha, own = chain.forward(log_b[i], m.pi, m.a)
        beta = chain.backward(log_b[i], m.a)
        assert total[i] == pytest.approx(own)
        assert np.allclose(gamma[i], chain.smoothed(alpha, beta)) and np.allclose(moves[i], chain.transitions(log_b[i], alpha, beta, m.a))
        p, z = alpha[-1], np.empty(n, int)
        for t in range(n - 1, -1, -1):  # filter forwards, draw backwards
            c = np.cumsum(p)
            z[t] = min(int(np.searchsorted(c, u[i, t] * c[-1], side="right")), 2)
            p = alpha[t - 1] * m.a[:, z[t]] if t else p
        assert drawn[i].tolist() == z.tolist()


def test_least_costs_between_states():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 8, 20):
        cost, price = rng.random((n, 3)), rng.random((3, 3))
        whole = np.where(np.eye(3, dtype=bool), 0.0, np.inf)
        for t in range(n):
            whole = (whole[:, :, None] + price[None]).min(1) + cost[t]
        assert np.allclose(scan.cheapest(cost, price), whole)


def test_starts_side_by_side_are_those_alone():
    x, _ = chain.sample(model(3), 240, np.random.default_rng(2))
    for student in (False, True):
        alone = [chain.fit(x, 3, s, rounds=40, student=student) for s in (1, 2, 3)]
        for (m, total, rounds), (m2, total2, rounds2) in zip(alone, chain.fit_starts(x, 3, [1, 2, 3], rounds=40, student=student)):
            assert rounds == rounds2 and total == pytest.approx(total2) and np.allclose(m.mu, m2.mu) and np.allclose(m.a, m2.a)
    for (m, total, _), s in zip(semi.fit_semi_starts(x, 3, 12, [1, 2], rounds=20), (1, 2)):
        own, own_total, _ = semi.fit_semi(x, 3, 12, s, rounds=20)
        assert total == pytest.approx(own_total) and np.allclose(m.mu, own.mu) and np.allclose(m.dur, own.dur)


def test_semi_markov_batches_against_logs():
    """A batch of different laws, one of which has a row that leaves the range of plain numbers."""
    rng = np.random.default_rng(4)
    laws = [semi.from_chain(model(s), 9) for s in range(3)]
    x = rng.normal(size=(60, 2)) * 2
    logs = [np.stack(v) for v in zip(*map(semi._weights, laws))]
    log_b = np.stack([chain.log_emissions(m, x) for m in laws])
    log_b[1, 20:26] -= np.array([0.0, 900.0, 1800.0])
    for i, found in enumerate(semi.batch_expectations(log_b, *logs)):
        for one, two in zip(found, semi._expectations_in_logs(log_b[i], *(v[i] for v in logs))):
            assert np.allclose(one, two, atol=1e-8)


def test_chains_draw_from_the_posterior():
    """Shares of the paths of a short series against the weights of all paths, and a chain does not depend on its neighbours."""
    import itertools

    m, x = model(1, 2), np.random.default_rng(8).normal(size=(4, 2))
    log_b, pi, a = batch([m], x)
    paths = list(itertools.product(range(2), repeat=4))
    logs = np.array([np.log(m.pi[p[0]]) + sum(np.log(m.a[i, j]) for i, j in itertools.pairwise(p)) + sum(log_b[0, t, z] for t, z in enumerate(p)) for p in paths])
    weight = np.exp(logs - logs.max())
    many = 20_000
    drawn = scan.sample_paths(np.repeat(log_b, many, 0), np.repeat(pi, many, 0), np.repeat(a, many, 0), np.random.default_rng(3).random((many, 4)))
    share = np.bincount(drawn @ [8, 4, 2, 1], minlength=16) / many
    assert np.abs(share - weight / weight.sum()).max() < 0.015
    y, _ = chain.sample(model(5), 90, np.random.default_rng(2))
    starts = [chain.fit(y, 3, s, rounds=5)[0] for s in (1, 2)]
    both = bayes.gibbs_chains(y, 3, starts, [7, 8], rounds=30)
    for start, seed, own in zip(starts, (7, 8), both):
        alone = bayes.gibbs(y, 3, start, seed, rounds=30)
        assert len(own) == 8 and all(np.allclose(p.mu, q.mu) for p, q in zip(own, alone))


@pytest.fixture(scope="module")
def long_series(spark):
    """One series with most of the rows, a short one, one of a single row and one without a model."""
    rows, kept = [], {}
    for name, n, seed in (("a", 700, 1), ("b", 37, 2), ("c", 1, 3), ("d", 20, 4)):
        kept[name], _ = chain.sample(model(9), n, np.random.default_rng(seed))
        rows += [(name, i, *map(float, v)) for i, v in enumerate(kept[name])]
    return spark.createDataFrame(rows, "series string, row long, x double, y double").repartition(3), kept


def saved(spark, m, names):
    lists = {c: None if (v := getattr(m, c)) is None else np.ravel(v).tolist() for c in ("pi", "a", "mu", "var", "nu", "dur")}
    rows = [(s, 3, *lists.values(), 0.0, 0, None) for s in names] + [("d", None, *[None] * 6, None, None, "too short")]
    return spark.createDataFrame(rows, f"series string, {grouped._MODEL}")


@pytest.mark.parametrize("student", [False, True])
def test_blocks_in_tasks_are_one_group(spark, long_series, monkeypatch, student):
    """Beliefs and paths of blocks of 32 rows are those of whole series; no group has more rows than a block."""
    rows, kept = long_series
    m = model(9, student=student)
    models = saved(spark, m, "abc")
    monkeypatch.setattr(blocked, "BLOCK", 32)
    assert blocked.packed(rows, NAMES).agg({"rows": "max"}).first()[0] == 32
    found = {(r.series, r.row): r for r in grouped.beliefs(rows, models, NAMES).collect()}
    path = {(r.series, r.row): r.state for r in grouped.decoded(rows, models, NAMES).collect()}
    assert len(found) == len(path) == 738
    for name in "abc":
        now, ahead = chain.predictions(m, kept[name])
        best = chain.viterbi(m, kept[name])
        for t in range(len(now)):
            r = found[name, t]
            assert np.allclose(r.now, now[t]) and np.allclose(r.ahead, ahead[t]) and r.state == now[t].argmax()
            assert path[name, t] == best[t]


def test_jump_states_by_blocks(spark, long_series, monkeypatch):
    rows, kept = long_series
    monkeypatch.setattr(blocked, "BLOCK", 16)
    centers = np.array([[-1.0, 0.0], [0.5, 0.5], [2.0, -1.0]])
    found = {(r.series, r.row): r.state for r in blocked.arrived(rows, NAMES, centers, 3.0).collect()}
    for name, x in kept.items():
        assert [found[name, t] for t in range(len(x))] == jump.online(jump.losses(x, centers), 3.0).tolist()


@pytest.mark.parametrize("student", [False, True])
def test_long_fits_add_up_blocks(spark, long_series, monkeypatch, student):
    """A round over blocks is a round over the whole series; the likelihood never falls; too short a series says so."""
    rows, kept = long_series
    monkeypatch.setattr(blocked, "BLOCK", 64)
    start = model(2, student=student)
    blocks = blocked.settled(blocked.packed(rows, NAMES))
    given = saved(spark, start, "ab").where("series <> 'd'").selectExpr("series", "states", "pi", "a", "mu", "var", "nu", "double('-inf') score", "double('inf') gain", "0 rounds", "skipped")
    after = {r.series: r for r in blocked.one_round(blocks, given, 2).collect()}
    for name in "ab":
        new, total = chain.em_step(start, kept[name], fixed_nu=True)
        r = after[name]
        assert r.score == pytest.approx(total) and np.allclose(r.pi, new.pi) and np.allclose(r.a, new.a.ravel())
        assert np.allclose(r.mu, new.mu.ravel()) and (student or np.allclose(r["var"], new.var.ravel()))
    before, models = -np.inf, given
    for _ in range(4):
        models = blocked.settled(blocked.one_round(blocks, models, 2))
        score = models.where("series = 'a'").first().score
        assert score >= before - 1e-9
        before = score
    fitted = {r.series: r for r in blocked.fit_long(rows, NAMES, rounds=3, student=student).collect()}
    assert fitted["c"].skipped and fitted["a"].skipped is None and fitted["a"].rounds == 3


def test_long_and_short_series_are_fitted_together(spark, long_series, monkeypatch):
    rows, kept = long_series
    monkeypatch.setattr(grouped, "LONG", 100)
    monkeypatch.setattr(blocked, "BLOCK", 256)
    monkeypatch.setattr(blocked, "ROUNDS", 2)
    found = {r.series: r for r in grouped.fit_models(rows, NAMES, "hmm", restarts=2).collect()}
    assert set(found) == set("abcd") and found["c"].skipped and found["d"].skipped
    alone = max(chain.fit_starts(kept["b"], 3, [42, 42 + 7919]), key=lambda f: f[1])
    assert found["b"].score == pytest.approx(alone[1])
    assert found["a"].score > -np.inf and found["a"].rounds == 2 and len(found["a"].mu) == 6


def test_times_are_numbered_over_blocks(spark):
    """Numbers run on from block to block, whatever lies between; equal times have one."""
    from tidebar.operators.align import numbered_times

    times = [-7, -3, 0, 0, 4, 9, 10, 31, 99]
    rows = spark.createDataFrame([(s, t) for s in "ab" for t in times], "series string, time long")
    found = sorted(tuple(r) for r in numbered_times(rows, 10).collect())
    assert found == [(t, i, 8) for i, t in enumerate(sorted(set(times)))]
    assert numbered_times(rows.where("time > 100"), 10).collect() == []
