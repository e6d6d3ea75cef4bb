"""Robust statistics: Spark columns for what a group by can say, numpy for the seeded bootstrap."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: From MAD and from the interquartile range to a standard deviation, and the spread at which stability is zero.
MAD_TO_SIGMA, IQR_TO_SIGMA, SPREAD_CAP = 1.4826, 1.349, 25.0
DRAWS, ALPHA = 2000, 0.05
#: Numbers that a bootstrap draws at once.
AT_ONCE = 1 << 20
LOW_N_TASK, LOW_N_RUN = 5, 30
QUERY_CLUSTER, PAIRED = "query-cluster-v1", "paired-query-cluster-v1"


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def ratio(n: Column, d: Column) -> Column:
    """n / d, zero where d is."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


#: Means are sums of decimals, so that the order of rows doesn't show in their last digits.
EXACT = "decimal(18,9)"


def exact_mean(x: Column) -> Column:
    """The mean of values of nine digits, itself to nine digits; null where there are none."""
    return F.round(F.try_divide(F.sum(x.cast(EXACT)).cast("double"), F.count(x)), 9)


def exact_mean_sql(x: str, also: str = "") -> str:
    """The same in the oracles' SQL; also: a FILTER clause."""
    return f"round((sum(({x})::DECIMAL(18,9)) {also})::DOUBLE / nullif(count({x}) {also}, 0), 9)"


def median(x: str) -> Column:
    return F.percentile(x, 0.5)


def iqr(x: str) -> Column:
    """Type-7 quartiles."""
    return F.percentile(x, 0.75) - F.percentile(x, 0.25)


def stability_v2(mad: Column) -> Column:
    return clamp(1 - MAD_TO_SIGMA * mad / SPREAD_CAP)


def stability_v3(mad: Column, spread: Column) -> Column:
    """The wider of the two estimates of spread counts."""
    return clamp(1 - F.greatest(MAD_TO_SIGMA * mad, spread / IQR_TO_SIGMA) / SPREAD_CAP)


def seed_of(*parts: Column) -> Column:
    """SHA-256 of the identity of an aggregate."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def seed_for(parts: Sequence[str]) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def fnv1a_units(text: str) -> int:
    """32-bit FNV-1a over the bytes of the UTF-16 units, low byte first."""
    h = 0x811C9DC5
    for b in text.encode("utf-16-le", "surrogatepass"):
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


#: Below this many draws a plain loop is as fast; above it, so many lanes step side by side.
LANES = 4096


def _step(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = a ^ (a << np.uint64(23))
    return b, x ^ b ^ (x >> np.uint64(18)) ^ (b >> np.uint64(5))


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.stack([a, b], axis=1).astype(">u8")
    return np.unpackbits(both.view(np.uint8).reshape(len(a), 16), axis=1).astype(np.float32)


def _words(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.packbits(bits.astype(np.uint8), axis=1).reshape(-1).view(">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


@functools.lru_cache(maxsize=256)
def _steps(n: int) -> np.ndarray:
    """n steps of the generator as a matrix over two elements: rows of bits times it."""
    if n == 0:
        return np.eye(128, dtype=np.float32)
    if n == 1:
        return _bits(*_step(*_words(np.eye(128))))
    half = _steps(n // 2)
    whole = half @ half % 2
    return whole @ _steps(1) % 2 if n % 2 else whole


class XorShift128Plus:
    """Vigna's xorshift128+ (23, 18, 5), seeded from four hashes of a text, with 16 draws thrown away. Steps are linear in the
    state's bits, so long runs are cut into lanes, whose first states are found by jumps, and numpy steps all of them at once."""

    def __init__(self, seed: str) -> None:
        w = [fnv1a_units(f"{seed}#{i}") for i in range(4)]
        self.a, self.b = w[0] << 32 | w[1], w[2] << 32 | w[3]
        if not self.a | self.b:
            self.a = 1
        self.skip(16)

    def _state(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.a], np.uint64), np.array([self.b], np.uint64)

    def skip(self, n: int) -> None:
        a, b = _words(_bits(*self._state()) @ _steps(n) % 2)
        self.a, self.b = int(a[0]), int(b[0])

    def doubles(self, n: int) -> np.ndarray:
        """n numbers in [0, 1)."""
        lanes = 1
        while lanes < LANES and lanes * lanes < n:
            lanes *= 2
        steps = -(-n // lanes)
        bits = _bits(*self._state())
        while len(bits) < lanes:
            bits = np.concatenate([bits, bits @ _steps(steps * len(bits)) % 2])
        a, b = _words(bits)
        out = np.empty((steps, lanes), np.float64)
        for t in range(steps):
            out[t] = (a + b) >> np.uint64(11)
            a, b = _step(a, b)
        self.skip(n)
        return out.T.reshape(-1)[:n] / 9007199254740992.0


def ordered_sum(x: np.ndarray) -> np.ndarray:
    """Sums of rows from the smallest value up, so that the order of rows doesn't show in the last digits."""
    return np.add.accumulate(np.sort(x, axis=-1), axis=-1)[..., -1]


def bootstrap(values: Sequence[float], seed: str, statistic: str = "median", draws: int = DRAWS, alpha: float = ALPHA) -> tuple[float, float] | None:
    """Percentile interval over resampled values, which stand in the order of their keys; None for fewer than two."""
    if draws < 1 or not 0 < alpha < 1 or statistic not in ("mean", "median"):
        raise ValueError("draws >= 1, 0 < alpha < 1 and statistic mean or median are asked for")
    if len(values) < 2:
        return None
    lo, hi = np.quantile(estimates(values, seed, statistic, 0, draws), [alpha / 2, 1 - alpha / 2])
    return float(lo), float(hi)


def estimates(values: Sequence[float], seed: str, statistic: str, first: int, draws: int) -> np.ndarray:
    """The statistic of so many resamples, from the first on: any part of the sequence, in memory for few resamples at a time."""
    v, rng = np.asarray(values, np.float64), XorShift128Plus(seed)
    n, out = len(v), []
    rng.skip(first * n)
    block = max(1, min(draws, AT_ONCE // n))
    for at in range(0, draws, block):
        rows = min(block, draws - at)
        drawn = v[np.floor(rng.doubles(rows * n) * n).astype(np.int64)].reshape(rows, n)
        out.append(ordered_sum(drawn) / n if statistic == "mean" else np.median(drawn, axis=1))
    return np.concatenate(out)


def bootstrap_pooled(values: Sequence[float], seed: str, draws: int = DRAWS, alpha: float = ALPHA) -> tuple[float, float]:
    """The older estimate over pooled samples: a single value is its own interval, none is an error."""
    if not len(values):
        raise ValueError("empty sample")
    return bootstrap(values, seed, "median", draws, alpha) or (float(values[0]), float(values[0]))
