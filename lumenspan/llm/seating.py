"""Gibbs draws for Chinese-restaurant seatings with a discount, for many dishes at once.

A restaurant's predictive probabilities need only the number of tables of each dish. Given an auxiliary Gamma variable g of the
restaurant, of shape (strength / discount + its tables), the dishes are independent, and n customers of a dish whose parent
probability is h sit at t tables with probability proportional to S(n, t) * (discount * g * h)^t, S being the generalised Stirling
numbers S(n + 1, t) = S(n, t - 1) + (n - t * discount) * S(n, t). So one Gibbs sweep draws g, then every dish's tables as a whole:

* up to `EXACT` customers by the recursion;
* more of them by an equivalent form of the same law: a Poisson number of tables with Sibuya sizes, given that these add up to n.
  The first customer's table takes what the others leave, so t - 1 is Poisson, weighted by what is left; one of `TRIES` draws is
  taken with probability proportional to its weight. Where tables are so many that the sizes' sum is concentrated instead, t is
  normal about the mode of the law, with its curvature.

Draws depend on the dishes' seeds alone, not on how dishes are dealt over tasks.
"""

from __future__ import annotations

import functools
import math

import numpy as np

#: Customers of a dish up to which the recursion is used.
EXACT = 512
TRIES = 64
#: From here on the size of the largest table doesn't govern the law any more, or what it leaves alters the law no more.
REGULAR, PLENTY = 8.0, 5000.0


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A hash of two hashes."""
    with np.errstate(over="ignore"):
        x = np.asarray(a, np.uint64) ^ (np.asarray(b, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(seeds: np.ndarray, k: int = 0) -> np.ndarray:
    """Numbers in (0, 1), one for each seed."""
    return ((mix(seeds, k + 1) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def gamma(shape: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Gamma variables of shapes of one or more, by Marsaglia and Tsang's rejection."""
    d = np.asarray(shape, np.float64) - 1 / 3
    c, out = 1 / np.sqrt(9 * d), np.zeros(len(d))
    left, k = np.arange(len(d)), 0
    while len(left):
        s = seeds[left]
        x = np.sqrt(-2 * np.log(uniform(s, k))) * np.cos(2 * np.pi * uniform(s, k + 1))
        v = (1 + c[left] * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (v > 0) & (np.log(uniform(s, k + 2)) < x * x / 2 + d[left] * (1 - v + np.log(v)))
        out[left[good]] = d[left[good]] * v[good]
        left, k = left[~good], k + 3
    return out


@functools.lru_cache(maxsize=4)
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S(n, t) for n, t up to `most`; minus infinity where there is none."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    for n in range(most):
        stay = np.full(most + 1, -np.inf)
        stay[: n + 1] = np.log(np.maximum(n - t[: n + 1] * discount, 1e-300)) if n else -np.inf
        out[n + 1] = out[n] + stay
        out[n + 1, 1:] = np.logaddexp(out[n + 1, 1:], out[n, :-1])
    return out


def _exactly(n: int, weight: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes of n customers each, by inversion."""
    t = np.arange(1, n + 1)
    law = log_stirling(discount)[n, 1 : n + 1] + np.log(weight)[:, None] * t
    law = np.cumsum(np.exp(law - law.max(axis=1, keepdims=True)), axis=1)
    return np.minimum((law < (u * law[:, -1])[:, None]).sum(axis=1) + 1, n)


@functools.lru_cache(maxsize=4)
def _left_weights(discount: float, most: int = 4096) -> np.ndarray:
    """Gamma(k - discount) / Gamma(k) for k = 1, 2, ...; zero for k = 0."""
    k = np.arange(1, most)
    return np.concatenate([[0.0], math.gamma(1 - discount) * np.concatenate([[1.0], np.cumprod((k - discount) / k)])])


def left_weight(left: np.ndarray, discount: float) -> np.ndarray:
    """How likely a table is to hold the `left` customers, the first one among them, up to a constant; zero for none."""
    table = _left_weights(discount)
    x = np.maximum(left, len(table))
    far = x**-discount * (1 + discount * (discount + 1) / (2 * x))
    return np.where(left < len(table), table[np.clip(left, 0, len(table) - 1).astype(np.int64)], far)


def _mode(n: np.ndarray, weight: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mode and spread of the law of tables, and by how many tables its largest one fails to govern it."""
    lo, hi = np.full(len(n), -700.0), np.full(len(n), -1e-12)  # log y with weight * (1 - y) = n * y^(1 - discount)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = n * np.exp((1 - discount) * mid) < weight * -np.expm1(mid)
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    y = np.exp(lo)
    top = -np.expm1(discount * lo)  # 1 - y^discount
    t = weight * top / discount
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        b = (1 - discount) + y / -np.expm1(lo)
        a = discount * np.exp(discount * lo) / top
        spread = np.sqrt(t * np.clip(1 - a / b, 0, 1))
    return t, np.nan_to_num(spread), t * y**discount


def _many(n: int, weight: float, discount: float, seed: int) -> int:
    """Tables of one dish of very many customers, where one table holds most of them."""
    rng = np.random.default_rng(seed)
    others = rng.poisson(weight / discount, TRIES)
    sizes = rng.geometric(np.maximum(rng.beta(discount, 1 - discount, int(others.sum())), 1e-12)).astype(np.float64)
    ends = np.concatenate([[0.0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(others)])]
    chance = np.cumsum(left_weight(np.maximum(n - np.diff(ends), 0), discount))
    return 1 + int(others[np.searchsorted(chance, rng.random() * chance[-1], side="right")]) if chance[-1] > 0 else 0


def sample_tables(customers: np.ndarray, weight: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """The number of tables of each dish, drawn anew. customers: of each dish; weight: discount * g * (the parent's probability)."""
    tables = (customers > 0).astype(np.int64)  # a single customer has one table
    u = uniform(seeds)
    order = np.argsort(customers, kind="stable")
    first, last = np.searchsorted(customers[order], [2, EXACT + 1])
    small = order[first:last]
    n, start = np.unique(customers[small], return_index=True)
    for size, lo, hi in zip(n.tolist(), start, [*start[1:], len(small)][: len(n)], strict=True):
        step = max(1, (1 << 20) // size)
        for at in range(lo, hi, step):
            some = small[at : min(hi, at + step)]
            tables[some] = _exactly(size, weight[some], discount, u[some])
    large = order[last:]
    if len(large):
        n, w = customers[large].astype(np.float64), weight[large]
        mode, spread, regular = _mode(n, w, discount)
        z = np.sqrt(-2 * np.log(u[large])) * np.cos(2 * np.pi * uniform(seeds[large], 1))
        drawn = np.clip(np.rint(mode + spread * z), 1, n).astype(np.int64)
        for k in np.flatnonzero((regular < REGULAR) & (w < PLENTY)):
            drawn[k] = _many(int(n[k]), float(w[k]), discount, int(seeds[large[k]])) or drawn[k]
        tables[large] = drawn
    return tables
