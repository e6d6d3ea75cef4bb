"""Token buckets over whole histories of calls, however many of them one bucket has.

A bucket is full at its first call, gains tokens with time up to its capacity, and a call takes one if there is one. Time and tokens are
integers here (microseconds, and the fraction of a token that one of them brings), so parts of a history can be computed apart
and put together exactly.

The history of a bucket with very many calls is cut into slices of time of about equally many calls. A first pass folds all slices at once,
for every balance that they may begin with: balances that have led to equally many admitted calls differ by what they differed at first,
and those that have been full once don't differ at all, so a few intervals describe a slice, whatever its length. The slices of
a bucket, a row each, are then put in line, and a second pass folds all calls from balances that are known. Both passes are folds over
sorted Arrow batches that keep one state; neither holds a slice in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspan.sources.stage import written

CAPACITY, REFILL = 3.0, 1.0 / 20_000
#: Buckets with more calls are cut, into as many slices as fit between so many cuts.
SLICE, CUTS = 200_000, 255

#: What becomes of the balances low .. high at a slice's beginning: themselves plus shift, or shift alone if they have all been full.
Piece = tuple[int, int, bool, int]


class Scale:
    """Capacity and refill as integers: units a token, units of a full bucket, units a microsecond."""

    def __init__(self, capacity: float, refill_per_s: float) -> None:
        per_us = Fraction(refill_per_s).limit_denominator(10**9) / 10**6
        self.token, self.per_us = per_us.denominator, per_us.numerator
        self.full = int(Fraction(capacity).limit_denominator(10**6) * self.token)

    def grown(self, balance: int, us: int) -> int:
        return min(self.full, balance + max(0, us) * self.per_us)

    def called(self, pieces: list[Piece], us: int) -> list[Piece]:
        """The pieces after some time and one call."""
        gain, out = max(0, us) * self.per_us, []
        for low, high, moving, shift in pieces:
            shift = shift + gain if moving else self.grown(shift, us)
            # where a balance is full, and where there is a token to take
            full, enough = (self.full - shift, self.token - shift) if moving else (high + 1, low if shift >= self.token else high + 1)
            parts = [(low, min(high, enough - 1), moving, shift), (max(low, enough), min(high, full - 1) if moving else high, moving, shift - self.token)]
            if moving and full <= high:
                parts.append((max(low, full), high, False, self.full - self.token if self.full >= self.token else self.full))
                parts[0] = (low, min(parts[0][1], full - 1), moving, shift)
            for p in parts:
                if p[0] > p[1]:
                    continue
                if out and out[-1][2:] == p[2:]:
                    p = (out.pop()[0], *p[1:])
                out.append(p)
        return out

    def after(self, pieces: list[Piece], balance: int) -> int:
        return next(shift + balance * moving for low, high, moving, shift in pieces if low <= balance <= high)


def _cut(calls: DataFrame, slice_calls: int) -> DataFrame:
    """calls with slice: 0, 1, ... in order of time in buckets with many calls, null in others."""
    counts = calls.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > slice_calls)
    hot = written(counts.select("bucket"), "hot-buckets")
    if hot.isEmpty():
        return calls.withColumn("slice", F.lit(None).cast("int"))
    at = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    each = calls.join(hot, "bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("ts", at, 20_000).alias("cuts"))
    # as many of the cuts as the bucket needs, evenly spread
    step = F.greatest(F.lit(1), F.floor(F.lit(CUTS + 1.0) * slice_calls / F.col("n")).cast("int"))
    some = F.array_distinct(F.filter("cuts", lambda c, i: (i + 1) % step == 0))
    cuts = written(each.select("bucket", some.alias("cuts")), "cuts")  # so that both passes cut alike
    return calls.join(cuts, "bucket", "left").withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("ts")))).withColumn("slice", F.when(F.col("cuts").isNotNull(), F.col("slice"))).drop("cuts")


def _in_order(calls: DataFrame) -> DataFrame:
    return calls.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "ts", "call_id")


def _began_with(calls: DataFrame, scale: Scale) -> DataFrame:
    """bucket, slice, balance, since: what each slice of a cut bucket begins with, and the time of the call before it."""
    kind = calls.schema["bucket"]
    out = T.StructType([kind, T.StructField("slice", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("pieces", T.ArrayType(T.ArrayType(T.LongType())))])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, first, last, pieces = None, 0, 0, []
        done: list[tuple] = []
        for batch in batches:
            for bucket, part, ts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (bucket, part) != who:
                    if who is not None:
                        done.append((*who, first, last, [[int(x) for x in p] for p in pieces]))
                    who, first, last, pieces = (bucket, part), ts, ts, [(0, scale.full, True, 0)]
                pieces, last = scale.called(pieces, ts - last), ts
            if done:
                yield pa.RecordBatch.from_pylist(done_rows(done), schema=arrow)
                done = []
        if who is not None:
            yield pa.RecordBatch.from_pylist(done_rows([(*who, first, last, [[int(x) for x in p] for p in pieces])]), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    done_rows = lambda rows: [dict(zip(out.names, r, strict=True)) for r in rows]
    slices = _in_order(calls.where("slice IS NOT NULL").select("bucket", "slice", "ts", "call_id")).mapInArrow(summed, out)

    def in_line(rows: pd.DataFrame) -> pd.DataFrame:
        """A row for each of a bucket's slices, CUTS + 1 at most."""
        rows, balance, since, begun = rows.sort_values("slice"), scale.full, None, []
        for r in rows.itertuples():
            begun.append((r.bucket, r.slice, balance, r.first if since is None else since))
            # the time between the slices comes first; the pieces are those of balances at the first call
            balance = scale.after([(int(p[0]), int(p[1]), bool(p[2]), int(p[3])) for p in r.pieces], scale.grown(balance, r.first - begun[-1][3]))
            since = r.last
        return pd.DataFrame(begun, columns=["bucket", "slice", "balance", "since"])

    line = T.StructType([kind, T.StructField("slice", T.IntegerType()), T.StructField("balance", T.LongType()), T.StructField("since", T.LongType())])
    return written(slices.groupBy("bucket").applyInPandas(in_line, line), "slices")


def token_bucket_of(calls: DataFrame, capacity: float = CAPACITY, refill_per_s: float = REFILL, known: DataFrame | None = None, slice_calls: int = SLICE) -> DataFrame:
    """calls: bucket, call_id, ts. bucket, call_id, admitted, tokens after: the calls of a bucket take tokens in order of time. known
    (bucket): the buckets that exist, if not all do; calls of others are never admitted and have no tokens."""
    scale = Scale(capacity, refill_per_s)
    shaped = calls.where("bucket IS NOT NULL").select("bucket", "call_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.lit(True).alias("there"))
    if known is not None:
        exists = known.select("bucket").distinct().withColumn("there", F.lit(True))
        shaped = shaped.drop("there").join(exists, "bucket", "left").select("bucket", "call_id", "ts", F.coalesce("there", F.lit(False)).alias("there"))
    cut = _cut(shaped, slice_calls)
    out = T.StructType([shaped.schema["bucket"], T.StructField("call_id", T.LongType()), T.StructField("admitted", T.BooleanType()), T.StructField("tokens", T.DoubleType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, balance, last = None, scale.full, 0
        for batch in batches:
            ok, left = [], []
            for bucket, part, ts, there, begun, since in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6)), strict=True):
                if (bucket, part) != who:
                    who, balance, last = (bucket, part), scale.full if begun is None else begun, ts if since is None else since
                balance, last = scale.grown(balance, ts - last), ts
                taken = there and balance >= scale.token
                balance -= scale.token * taken
                ok.append(taken)
                left.append(balance / scale.token if there else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(ok, pa.bool_()), pa.array(left, pa.float64())], names=out.names)

    begun = _began_with(cut, scale) if "slice" in cut.columns and not cut.where("slice IS NOT NULL").isEmpty() else None
    none = F.lit(None).cast("long")
    told = cut.join(begun, ["bucket", "slice"], "left") if begun is not None else cut.withColumns({"balance": none, "since": none})
    return _in_order(told.select("bucket", "slice", "ts", "call_id", "there", "balance", "since")).mapInArrow(fold, out)
