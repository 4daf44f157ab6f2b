"""Kernels against enumeration of all paths or segmentations, and their invariants."""

import itertools

import numpy as np
import pytest

from tidebar.functions.special import digamma, lgamma, logsumexp, normal_cdf, normal_inv
from tidebar.models import bayes, chain, jump, semi
from tidebar.models.chain import Model

TOY = Model(np.array([0.5, 0.3, 0.2]), np.array([[0.7, 0.2, 0.1], [0.3, 0.4, 0.3], [0.1, 0.3, 0.6]]), np.array([[-1.0], [0.0], [1.5]]), np.array([[0.5], [1.0], [0.25]]))
HEAVY = Model(TOY.pi, TOY.a, TOY.mu, TOY.var, np.array([3.0, 5.0, 9.0]))
LASTING = Model(
    TOY.pi, np.array([[0, 0.6, 0.4], [0.7, 0, 0.3], [0.5, 0.5, 0]]), TOY.mu, TOY.var, None, np.array([[0.1, 0.2, 0.6, 0.1], [0.5, 0.3, 0.1, 0.1], [0.2, 0.2, 0.2, 0.4]])
)


def sample(n, seed=0):
    return np.random.default_rng(seed).normal(0, 1.2, (n, 1))


def brute(m, x):
    log_b = chain.log_emissions(m, x)
    paths = list(itertools.product(range(3), repeat=len(x)))
    logs = [np.log(m.pi[p[0]]) + sum(np.log(m.a[i, j]) for i, j in itertools.pairwise(p)) + sum(log_b[t, z] for t, z in enumerate(p)) for p in paths]
    return paths, np.array(logs)


@pytest.mark.parametrize("m", [TOY, HEAVY])
def test_forward_backward_viterbi_against_all_paths(m):
    x = sample(6)
    paths, logs = brute(m, x)
    log_b = chain.log_emissions(m, x)
    alpha, total = chain.forward(log_b, m.pi, m.a)
    assert total == pytest.approx(logsumexp(logs, 0))
    weight = np.exp(logs - logs.max())
    weight /= weight.sum()
    gamma = chain.smoothed(alpha, chain.backward(log_b, m.a))
    for t in range(6):
        for k in range(3):
            assert gamma[t, k] == pytest.approx(sum(w for p, w in zip(paths, weight) if p[t] == k))
    moves = chain.transitions(log_b, alpha, chain.backward(log_b, m.a), m.a)
    expected = np.zeros((3, 3))
    for p, w in zip(paths, weight):
        for i, j in itertools.pairwise(p):
            expected[i, j] += w
    assert np.allclose(moves, expected)
    assert tuple(chain.viterbi(m, x)) == paths[int(logs.argmax())]


def test_filtering_does_not_look_ahead():
    x = sample(40)
    y = x.copy()
    y[25:] = 9
    for m, own in ((TOY, chain), (LASTING, semi)):
        for a, b in zip(own.predictions(m, x), own.predictions(m, y)):
            assert np.allclose(a[:25], b[:25])
            assert np.allclose(a.sum(1), 1)


def segmentations(n, k=3, most=4):
    def grow(t, last):
        if t == n:
            yield []
            return
        for z in range(k):
            if z != last:
                for d in range(1, min(most, n - t) + 1):
                    for rest in grow(t + d, z):
                        yield [(z, t, d), *rest]

    return list(grow(0, None))


def test_semi_markov_against_all_segmentations():
    x, m = sample(6, 1), LASTING
    log_b = chain.log_emissions(m, x)
    every = segmentations(6)
    logs = np.array(
        [
            np.log(m.pi[s[0][0]]) + sum(np.log(m.a[a[0], b[0]]) for a, b in itertools.pairwise(s)) + sum(np.log(m.dur[z, d - 1]) + log_b[t : t + d, z].sum() for z, t, d in s)
            for s in every
        ]
    )
    gamma, moves, lasting, first, total = semi.expectations(log_b, *semi._weights(m))
    assert total == pytest.approx(logsumexp(logs, 0))
    w = np.exp(logs - total)
    state, dur, move = np.zeros((6, 3)), np.zeros((3, 4)), np.zeros((3, 3))
    for s, p in zip(every, w):
        for z, t, d in s:
            state[t : t + d, z] += p
            dur[z, d - 1] += p
        for a, b in itertools.pairwise(s):
            move[a[0], b[0]] += p
    assert np.allclose(gamma, state) and np.allclose(lasting, dur) and np.allclose(moves, move)
    assert np.allclose(gamma.sum(1), 1)
    best = every[int(logs.argmax())]
    assert list(semi.viterbi(m, x)) == [z for z, _, d in best for _ in range(d)]


def test_expectation_maximisation_never_loses():
    x = np.concatenate([sample(80, 2) - 2, sample(80, 3) + 2])
    for student in (False, True):
        m, totals = chain.first_guess(x, 2, np.random.default_rng(1), 1e-8, student), []
        for _ in range(15):
            m, total = chain.em_step(m, x, prior=0.0)
            totals.append(total)
        assert all(b >= a - 1e-6 for a, b in itertools.pairwise(totals))
    m, totals = semi.from_chain(chain.first_guess(x, 2, np.random.default_rng(1), 1e-8), 20), []
    for _ in range(10):
        m, total = semi.em_step(m, x, duration_prior=0.0, prior=0.0)
        totals.append(total)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(totals))


def test_parameters_are_recovered():
    m = Model(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[-1.0], [1.0]]), np.array([[0.25], [0.25]]))
    x, z = chain.sample(m, 1500, np.random.default_rng(5))
    found = chain.fit(x, 2)[0]
    assert np.allclose(found.mu, m.mu, atol=0.1) and np.allclose(found.a, m.a, atol=0.05)
    assert (chain.viterbi(found, x) == z).mean() > 0.95
    assert np.allclose(chain.stationary(m.a), [2 / 3, 1 / 3])
    assert np.allclose(chain.expected_durations(m), [20, 10])


def test_degrees_of_freedom_are_recovered():
    m = Model(np.array([1.0]), np.array([[1.0]]), np.array([[0.0]]), np.array([[1.0]]), np.array([4.0]))
    x, _ = chain.sample(m, 4000, np.random.default_rng(8))
    assert chain.fit(x, 1, student=True)[0].nu[0] == pytest.approx(4, rel=0.35)


def test_duration_knows_the_end_of_a_regime():
    """Regimes of eight bars: at the last one a change is near certain, which a geometric law cannot say."""
    dur = np.full((2, 16), 1e-6)
    dur[:, 7] = 1
    m = Model(np.array([0.5, 0.5]), np.array([[0.0, 1], [1, 0]]), np.array([[-1.5], [1.5]]), np.array([[0.3], [0.3]]), None, dur / dur.sum(1, keepdims=True))
    z = np.repeat([0, 1] * 10, 8)
    x = m.mu[z] + np.sqrt(0.3) * np.random.default_rng(3).standard_normal((160, 1))
    now, ahead = semi.predictions(m, x)
    last = np.arange(7 + 8 * 4, 160, 8)
    assert np.mean([ahead[t, 1 - z[t]] for t in last]) > 0.95
    assert np.mean([ahead[t - 4, z[t]] for t in last]) > 0.95


def test_jump_path_against_all_paths():
    x, centers = sample(7, 4), np.array([[-1.0], [0.3], [1.2]])
    loss = jump.losses(x, centers)
    best = min(jump.objective(loss, np.array(p), 0.8) for p in itertools.product(range(3), repeat=7))
    assert jump.objective(loss, jump.cheapest_path(loss, 0.8), 0.8) == pytest.approx(best)
    for t in range(1, 8):
        assert jump.online(loss, 0.8)[t - 1] == jump.cheapest_path(loss[:t], 0.8)[-1]
    assert (np.diff(jump.cheapest_path(loss, 1e6)) == 0).all()
    assert list(jump.run_lengths(np.array([0, 0, 1, 0, 0, 0]), 3)) == [2.5, 1, 1]


def test_variational_bound_rises_and_agrees_with_sampling():
    m = Model(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[-1.0], [1.0]]), np.array([[0.2], [0.2]]))
    x, _ = chain.sample(m, 400, np.random.default_rng(2))
    start = chain.fit(x, 2)[0]
    q, bounds, weight = bayes.fit_vb(x, 2, start)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(bounds))
    assert weight.sum() == pytest.approx(400)
    draws = bayes.gibbs(x, 2, start, rounds=200, thin=1)
    assert np.allclose(np.mean([d.mu for d in draws], 0), q.m, atol=0.06)
    lasting = semi.fit_semi(x, 2, 25)[0]
    _, bounds, _ = bayes.fit_vb(x, 2, lasting)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(bounds))


def test_special_functions():
    assert digamma(1.0) == pytest.approx(-0.5772156649015329) and digamma(0.1) == pytest.approx(-10.42375494041108)
    assert lgamma(5.0) == pytest.approx(np.log(24))
    assert normal_cdf(1.96) == pytest.approx(0.9750021) and normal_inv(0.975) == pytest.approx(1.959964)
    assert normal_inv(0) == -np.inf
