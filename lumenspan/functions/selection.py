"""Exact quartiles, medians and median deviations of groups of any size.

A sketch of each group, built by partial aggregation, says between which two values a rank must lie; so does it, by the distance to the
median, for the median of deviations. One more pass counts what lies outside of these brackets and keeps, as values with their counts, what lies
inside - a few cells of the sketch's grid for each group. From these the exact values are picked. No task sees a group's values, no
value is shuffled but by partial counts, and deviations need no pass of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of the grid, and how many of the sketch's errors fit in one. A group keeps some 20 cells' worth of its values.
CELLS, PER_CELL = 1024, 10
QUARTILES = (0.25, 0.5, 0.75)
#: By how many cells a bracket is wider than the ranks it is for.
SLACK = 2
INF = float("inf")
BRACKETS = [f"{end}{i}" for i in range(len(QUARTILES)) for end in ("low", "high")] + ["near", "far"]


def ranks(n: int, q: float) -> tuple[int, int, float]:
    """The two ranks that a type-7 quantile lies between, and how far it is from the first."""
    h = (n - 1) * q
    low = int(np.floor(h))
    return low, min(low + 1, n - 1), h - low


def bracket(grid: np.ndarray, n: int, first: int, last: int) -> tuple[float, float]:
    """Values that ranks first .. last are surely between, both included."""
    cells = len(grid) - 1
    i, j = int(first / n * cells) - SLACK, int(np.ceil((last + 1) / n * cells)) + SLACK
    return float(grid[i]) if i >= 0 else -INF, float(grid[j]) if j <= cells else INF


def deviation_bracket(grid: np.ndarray, n: int, low: float, high: float, first: int, last: int) -> tuple[float, float]:
    """The same for distances to a median that is somewhere in low .. high."""
    if np.isinf([low, high]).any():
        return 0.0, INF
    cells = len(grid) - 1
    radii = np.unique(np.concatenate([np.abs(grid - low), np.abs(grid - high)]))
    # at most, and at least, so many cells within a radius
    most = np.searchsorted(grid, high + radii, "right") - np.searchsorted(grid, low - radii, "left") + 1 + SLACK
    least = np.searchsorted(grid, low + radii, "left") - np.searchsorted(grid, high - radii, "right") - 1 - SLACK
    few, many = np.flatnonzero(most * n / cells <= first), np.flatnonzero(least * n / cells >= last + 1)
    return float(radii[few[-1]]) if len(few) else 0.0, float(radii[many[0]]) if len(many) else INF


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in BRACKETS]))
def _brackets(n: pd.Series, grid: pd.Series) -> pd.DataFrame:
    rows = []
    for count, g in zip(n, grid, strict=True):
        g, row = np.sort(np.asarray(g, float)), []
        for q in QUARTILES:
            row += bracket(g, count, *ranks(count, q)[:2])
        row += deviation_bracket(g, count, row[2], row[3], *ranks(count, 0.5)[:2])
        rows.append(row)
    return pd.DataFrame(rows, columns=BRACKETS)


def _pick(values: np.ndarray, counts: np.ndarray, before: int, n: int, q: float) -> float:
    """A quantile from sorted values with counts, of which so many others are smaller."""
    first, second, part = ranks(n, q)
    upto = before + np.cumsum(counts)
    if not before <= first or not len(upto) or second >= upto[-1]:
        raise ValueError("a rank is outside of its bracket: the sketch is less exact than it says")
    a, b = (values[np.searchsorted(upto, k, "right")] for k in (first, second))
    return float(a + part * (b - a))


def _picked(rows: pd.DataFrame) -> tuple[float, ...]:
    """q1, median, q3, mad of one group from its brackets, kept values and counts of all others."""
    n, b = int(rows["c"].sum()), rows.iloc[0]
    kept = rows[rows["x"].notna()].sort_values("x")
    x, c = kept["x"].to_numpy(float), kept["c"].to_numpy(np.int64)
    rest, code, out = rows[rows["x"].isna()], rows[rows["x"].isna()]["code"].to_numpy(np.int64), []
    others = rest["c"].to_numpy(np.int64)
    for i, q in enumerate(QUARTILES):
        below = int(others[(code >> i) & 1 == 1].sum())
        out.append(_pick(x, c, below, n, q) if not len(others) or np.isinf(b[f"low{i}"]) else _pick(x[x >= b[f"low{i}"]], c[x >= b[f"low{i}"]], below + int(c[x < b[f"low{i}"]].sum()), n, q))
    distance = np.abs(x - out[1])
    order = np.argsort(distance, kind="stable")
    out.append(_pick(distance[order], c[order], int(others[(code >> len(QUARTILES)) & 1 == 1].sum()), n, 0.5))
    return tuple(out)


def robust(values: DataFrame, keys: list[str], value: str = "value", cells: int = CELLS) -> DataFrame:
    """keys, n, q1, median, q3, mad of the non-null values of each group; quantiles are of type 7."""
    rows = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    grid = [k / cells for k in range(cells + 1)]
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", grid, cells * PER_CELL).alias("grid"))
    found = sketch.select(*[F.col(k).alias(f"{k}__of") for k in keys], _brackets("n", "grid").alias("b")).select(*[f"{k}__of" for k in keys], "b.*")
    same = [F.col(k).eqNullSafe(F.col(f"{k}__of")) for k in keys]
    met = rows.join(found, same) if keys else rows.crossJoin(found)  # a row of brackets for each group
    x, mid = F.col("x"), len(QUARTILES) // 2
    inside = [x.between(F.col(f"low{i}"), F.col(f"high{i}")) for i in range(len(QUARTILES))]
    low, high, near, far = (F.col(c) for c in (f"low{mid}", f"high{mid}", "near", "far"))
    inside += [x.between(low - far, high - near), x.between(low + near, high + far)]
    inner = (x > high - near) & (x < low + near)
    keep = inside[0]
    for other in inside[1:]:
        keep = keep | other
    bits: Column = F.lit(0)
    for i, holds in enumerate([*[x < F.col(f"low{i}") for i in range(len(QUARTILES))], inner]):
        bits = bits + F.when(holds, 1 << i).otherwise(0)
    told = met.select(*keys, *BRACKETS, F.when(keep, x).alias("x"), F.when(keep, 0).otherwise(bits).alias("code"))
    told = told.groupBy(*keys, *BRACKETS, "x", "code").agg(F.count(F.lit(1)).alias("c"))
    out = T.StructType([values.schema[k] for k in keys] + [T.StructField("n", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("q1", "median", "q3", "mad")])

    def pick(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, int(rows["c"].sum()), *_picked(rows))], columns=out.names)

    return told.groupBy(*keys).applyInPandas(pick, out)


def type_7(ordered: Column, q: float) -> Column:
    """A quantile of a sorted array, by linear interpolation."""
    h = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(h).cast("int")
    below = F.get(ordered, low)
    return below + (h - low) * (F.coalesce(F.get(ordered, low + 1), below) - below)


def robust_columns(value: str) -> tuple[Column, Column]:
    """For groups that are known to be small: an aggregate, and from it a struct of q1, median, q3, mad."""
    ordered = F.col("ordered")
    median = type_7(ordered, 0.5)
    away = F.array_sort(F.transform(ordered, lambda x: F.abs(x - median)))
    return F.array_sort(F.collect_list(value)).alias("ordered"), F.struct(
        type_7(ordered, 0.25).alias("q1"), median.alias("median"), type_7(ordered, 0.75).alias("q3"), type_7(away, 0.5).alias("mad")
    )
