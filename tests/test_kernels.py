"""numpy kernels against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardinal.operators import kernels as K
from cardinal.operators.metrics import scores
from cardinal.plans.algorithms import BY_NAME


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 7), st.integers(2, 4), st.booleans())
def test_assignment_is_optimal(seed, n, k, tied):
    rng = np.random.default_rng(seed)
    cost = rng.integers(0, 4, (n, k)).astype(float) if tied else rng.random((n, k))
    sizes = rng.multinomial(n, [1 / k] * k)
    best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.product(range(k), repeat=n) if (np.bincount(p, minlength=k) == sizes).all())
    label = K.assign_exact(cost, sizes)
    assert (np.bincount(label, minlength=k) == sizes).all()
    assert cost[np.arange(n), label].sum() == pytest.approx(best)
    assert K.certificate(cost, label)


def test_a_worse_assignment_has_no_certificate():
    assert not K.certificate(np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([1, 0]))


def test_sizes_must_add_up():
    with pytest.raises(ValueError):
        K.assign_exact(np.zeros((3, 2)), np.array([1, 1]))


def test_repair():
    x = np.array([[0.0], [1.0], [2.0], [9.0]])
    centroids = np.array([[0.0], [9.0], [3.0]])
    assert K.repair(np.array([0, 0, 0, 1]), x, centroids, np.array([1, 1, 2])).tolist() == [2, 2, 0, 1]
    assert K.repair(np.array([0, 1, 2, 2]), x, centroids, np.array([1, 1, 2])).tolist() == [0, 1, 2, 2]


def test_silhouette_by_hand():
    d = np.array([[0, 1, 4], [1, 0, 5], [4, 5, 0.0]])
    assert K.silhouette_mean(d, np.array([0, 0, 1]), 2) == pytest.approx((3 / 4 + 4 / 5 + 0) / 3)
    assert K.silhouette_mean(d, np.array([0, 0, 0]), 2) == float("-inf")


def test_cosine_conventions():
    a = np.array([[1.0, 0.0], [0.0, 0.0]])
    assert K.cosine_matrix(a[:1], -a[:1])[0, 0] == 2 and K.cosine_matrix(a[:1], -a[:1], signed=False)[0, 0] == 0


@pytest.mark.parametrize("signed", [True, False])
def test_sums_of_distances_equal_the_matrix(signed):
    x = np.random.default_rng(3).normal(size=(50, 4))
    x[7] = 0
    label = np.arange(50) % 3
    sums, matrix = K.CosineSums(x, signed, block=350), K.cosine_matrix(x, signed=signed)
    assert len(sums) == 50 and sums @ np.eye(3)[label] == pytest.approx(matrix @ np.eye(3)[label])
    assert K.silhouette_mean(sums, label, 3) == pytest.approx(K.silhouette_mean(matrix, label, 3))


def test_scores_by_hand():
    y = np.array([0, 0, 1, 1])
    assert scores(y, 1 - y) == pytest.approx((1, 1, 1))
    ari, ami, nmi = scores(np.array([0, 0, 0, 1, 1, 1]), np.array([0, 0, 1, 1, 2, 2]))
    assert ari == pytest.approx(0.24242424242424243)
    assert nmi == pytest.approx(0.4206198357143052)  # 0.6667 log 2 over log 3
    assert ami < nmi


@pytest.mark.parametrize("name", sorted(set(BY_NAME) - {"ACO", "BAT", "PSO"}))
def test_algorithms_meet_the_sizes(name):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (n, 3)) for c, n in ((0, 12), (5, 7), (-4, 5))])
    sizes = np.array([12, 7, 5])
    label = BY_NAME[name](x, sizes)
    assert (np.bincount(label, minlength=3) == sizes).all()
    assert (label == BY_NAME[name](x, sizes)).all()


def test_kmeans_by_hand():
    x = np.random.default_rng(2).normal(size=(5000, 6))
    rng = np.random.default_rng(4)
    best, least = None, np.inf
    for _ in range(3):
        c, label = x[rng.choice(len(x), 4, replace=False)], None
        for _ in range(12):
            new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            if label is not None and (new == label).all():
                break
            label, c = new, np.stack([x[new == j].mean(0) for j in range(4)])
        cost = ((x - c[label]) ** 2).sum()
        if cost < least:
            best, least = label, cost
    assert (K.kmeans(x, 4, np.random.default_rng(4), 3, 12) == best).all()
    same = np.ones((20, 2))
    assert (K.kmeans(same, 3, np.random.default_rng(1)) == 0).all()


def test_searches_meet_the_sizes():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1, (n, 3)) for c, n in ((0, 12), (5, 7))])
    sizes = np.array([12, 7])
    for label in (BY_NAME["ACO"](x, sizes, ants=3, rounds=2), BY_NAME["BAT"](x, sizes, bats=3, rounds=2), BY_NAME["PSO"](x, sizes, particles=4, rounds=3)):
        assert (np.bincount(label, minlength=2) == sizes).all()


def test_one_round_is_the_first_of_many():
    x = np.random.default_rng(1).normal(size=(30, 4))
    sizes = np.array([10, 20])
    assert (BY_NAME["SCK1"](x, sizes) == BY_NAME["KM-MILP"](x, sizes, rounds=1)).all()
