"""The size-constrained clustering algorithms on one dataset: features x, required sizes, seed -> labels from 0.

All but the positional one look at the features. Rows stand in the order of row_id.
"""

from __future__ import annotations

import numpy as np

from cardinal.operators import kernels as K


def csclp(x: np.ndarray, sizes: np.ndarray, seed: int = 123, signed: bool = True) -> np.ndarray:
    """Medoids (Euclidean) keep their own clusters; the other rows are assigned at the least cosine cost, one place less for each cluster."""
    m = K.medoids(np.sqrt(K.squared_matrix(x, x)), len(sizes))
    rest = np.setdiff1d(np.arange(len(x)), m)
    label = np.empty(len(x), np.int64)
    label[m] = np.arange(len(sizes))
    label[rest] = K.assign_exact(K.cosine_matrix(x[rest], x[m], signed), sizes - 1)
    return label


def km_milp(x: np.ndarray, sizes: np.ndarray, seed: int = 123, rounds: int = 10, init: np.ndarray | None = None, signed: bool = True) -> np.ndarray:
    """Exact assignment to centroids and new means in turn, from random rows, until no coordinate moves by 1e-4."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), len(sizes), replace=False) if init is None else init]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = K.assign_exact(K.cosine_matrix(x, c, signed), sizes)
        new = K.means(x, label, len(sizes), c)
        if np.abs(new - c).max() < 1e-4:
            break
        c = new
    return label


def sck1(x: np.ndarray, sizes: np.ndarray, seed: int = 123, init: np.ndarray | None = None, signed: bool = True) -> np.ndarray:
    """The first round of km_milp()."""
    return km_milp(x, sizes, seed, 1, init, signed)


def kmedoids(x: np.ndarray, sizes: np.ndarray, seed: int = 123, signed: bool = True) -> np.ndarray:
    """Rows in the order of their distance to the nearest medoid fill the clusters; which medoid is near plays no part."""
    d = K.cosine_matrix(x, signed=signed)
    m = K.medoids(np.sqrt(K.squared_matrix(x, x)), len(sizes))
    return K.decode(d[:, m].min(1), sizes)


def hcakc(x: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """Consecutive blocks of rows: a positional baseline, not a clustering."""
    return np.repeat(np.arange(len(sizes)), sizes)


def pso(x: np.ndarray, sizes: np.ndarray, seed: int = 1, particles: int = 40, rounds: int = 20, signed: bool = True) -> np.ndarray:
    """Random keys in [0, 1]^n, decoded by rank; the swarm lowers the sum of distances within clusters."""
    if not np.isfinite(x).all():
        raise ValueError("features must be finite numbers")
    rng, d, k = np.random.default_rng(seed), K.cosine_matrix(x, signed=signed), len(sizes)
    w, c = 1 / (2 * np.log(2)), 0.5 + np.log(2)
    at, speed = rng.random((particles, len(x))), rng.random((particles, len(x))) - 0.5
    cost = lambda p: K.within(d, K.decode(p, sizes), k)
    own, own_cost = at.copy(), np.array([cost(p) for p in at])
    for _ in range(rounds):
        lead = own[own_cost.argmin()]
        speed = w * speed + c * rng.random(at.shape) * (own - at) + c * rng.random(at.shape) * (lead - at)
        at = at + speed
        out = (at < 0) | (at > 1)
        at, speed = np.clip(at, 0, 1), np.where(out, 0, speed)
        now = np.array([cost(p) for p in at])
        better = now < own_cost
        own[better], own_cost[better] = at[better], now[better]
    return K.decode(own[own_cost.argmin()], sizes)


def start(x: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, starts: int = 5, rounds: int = 30) -> np.ndarray:
    """k-means, then repair of the sizes."""
    label = K.kmeans(x, len(sizes), rng, starts, rounds)
    return K.repair(label, x, K.means(x, label, len(sizes), x.mean(0)), sizes)


def score(d: np.ndarray | K.CosineSums, label: np.ndarray, sizes: np.ndarray, penalty: float) -> float:
    return K.silhouette_mean(d, label, len(sizes)) - penalty * np.abs(np.bincount(label, minlength=len(sizes)) - sizes).sum()


def bat(x: np.ndarray, sizes: np.ndarray, seed: int = 1521, bats: int = 30, rounds: int = 20, loudness: float = 0.5, pulse: float = 0.5, alpha: float = 0.9, gamma: float = 0.9, signed: bool = True) -> np.ndarray:
    """Bats start feasible; the first one's labels are the first best. A move is kept if it scores better and the bat is loud enough; the distances are computed once."""
    rng, d, k = np.random.default_rng(seed), K.cosine_matrix(x, signed=signed), len(sizes)
    flock = [[start(x, sizes, rng), loudness, pulse] for _ in range(bats)]
    best, top = flock[0][0], score(d, flock[0][0], sizes, 10)
    for t in range(1, rounds + 1):
        for b in flock:
            move = (b[0] - best) * rng.uniform(0, 2)
            new = np.clip(np.rint(b[0] + move), 0, k - 1).astype(np.int64)
            if rng.random() > b[2]:
                new = rng.integers(0, k, len(x))
            for j in range(k):
                while (own := np.flatnonzero(new == j)).size > sizes[j]:
                    new[rng.choice(own, own.size - sizes[j], replace=False)] = rng.integers(0, k, own.size - sizes[j])
            value = score(d, new, sizes, 10)
            if value > top and rng.random() < b[1]:
                b[0], b[1], b[2] = new, alpha * b[1], pulse * (1 - np.exp(-gamma * t))
                best, top = new, value
    return best


def aco_restart(x: np.ndarray, d: np.ndarray | K.CosineSums, sizes: np.ndarray, seed: int, starts: int = 5, rounds: int = 30) -> tuple[float, np.ndarray]:
    """One ant: k-means, random repair, a tenth of the rows relabelled, then repair to the exact sizes; (score, labels). Ants know nothing of each other."""
    rng, k = np.random.default_rng(seed), len(sizes)
    label = K.kmeans(x, k, rng, starts, rounds)
    change = rng.random(len(x)) < 0.1
    label = np.where(change, rng.integers(0, k, len(x)), label)
    label = K.repair(label, x, K.means(x, label, k, x.mean(0)), sizes)
    return score(d, label, sizes, 100), label


def aco(x: np.ndarray, sizes: np.ndarray, seed: int = 1, ants: int = 50, rounds: int = 20, signed: bool = True) -> np.ndarray:
    d = K.CosineSums(x, signed)
    return max((aco_restart(x, d, sizes, seed + i) for i in range(ants * rounds)), key=lambda r: r[0])[1]


#: The menu numbers.
ALGORITHMS = {1: ("BAT", bat), 2: ("CSCLP", csclp), 3: ("KMEDOIDS", kmedoids), 4: ("ACO", aco), 5: ("PSO", pso), 6: ("HCAKC", hcakc), 7: ("KM-MILP", km_milp), 8: ("SCK1", sck1)}
BY_NAME = dict(ALGORITHMS.values())
