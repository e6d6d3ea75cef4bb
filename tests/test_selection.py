"""Rank selection against sorted values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.functions import selection
from lumenspan.functions.selection import robust, robust_columns


def by_hand(x):
    x = np.asarray(x, float)
    q1, m, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    return len(x), q1, m, q3, np.median(np.abs(x - m))


def groups():
    rng = np.random.default_rng(2)
    out = {f"n{n}": rng.normal(size=n).tolist() for n in (1, 2, 3, 4, 5, 17, 40, 41, 1000)}
    out |= {"even": rng.uniform(size=30_000).tolist(), "odd": rng.lognormal(sigma=3, size=20_001).tolist(), "cents": np.round(rng.uniform(0, 5, 25_000), 2).tolist()}
    out |= {"equal": [7.0] * 9000, "two": [1.0] * 5000 + [2.0] * 5000, "mostly": [0.0] * 15_000 + rng.normal(size=4000).tolist(), "spikes": np.repeat([1.0, 1e9, -1e9], [7000, 3000, 2001]).tolist()}
    out[None] = rng.exponential(size=12_345).tolist()
    return out


@pytest.mark.parametrize("cells", [64, 1024])
def test_equals_sorted_values(spark, cells):
    data = groups()
    frame = spark.createDataFrame([(k, float(v)) for k, xs in data.items() for v in xs] + [("n3", None), ("none", None)], "g string, value double").repartition(6)
    got = {r.g: tuple(r)[1:] for r in robust(frame, ["g"], cells=cells).collect()}
    assert got.keys() == data.keys()
    for k, xs in data.items():
        assert got[k] == pytest.approx(by_hand(xs), rel=1e-12, abs=1e-12), k
    small, of = robust_columns("value")
    plain = {r.g: tuple(r.s) for r in frame.where("value IS NOT NULL").groupBy("g").agg(small).select("g", of.alias("s")).collect()}
    for k, xs in data.items():
        assert plain[k] == pytest.approx(by_hand(xs)[1:], rel=1e-12, abs=1e-12), k
    assert robust(frame.where("false"), ["g"]).count() == 0


def test_no_task_sees_a_hot_group(spark):
    """Of two million values of one group, all different, some hundredths are kept."""
    n = F.col("id").cast("double")
    values = spark.range(0, 2_000_000, 1, 8).select(F.lit("hot").alias("g"), (F.sin(n * 12.9898) * 43758.5453 % 1.0).alias("value"))
    row = robust(values, ["g"]).first()
    want = by_hand([r.value for r in values.select("value").toLocalIterator(prefetchPartitions=True)])
    assert tuple(row)[1:] == pytest.approx(want, rel=1e-12)
    plan = robust(values, ["g"])._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_list" not in plan
    grid = np.quantile(values.toPandas().value, np.linspace(0, 1, selection.CELLS + 1), method="inverted_cdf")
    low, high = selection.bracket(grid, 2_000_000, 999_999, 1_000_000)
    near, far = selection.deviation_bracket(grid, 2_000_000, low, high, 999_999, 1_000_000)
    assert 0 < high - low < 0.02 and low < want[2] < high and 0 < far - near < 0.04 and near < want[4] < far
