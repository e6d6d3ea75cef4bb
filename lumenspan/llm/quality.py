"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few numbers - lengths, shares of kinds of characters, repetition of words and lines, each over the whole text and over
its worst line - and each number a bin between quantiles of the training rows. Boosting goes round the features: in turn every one gets a
small step along a shallow tree (four leaves at most) fitted to the current gradients, and the steps of a feature add up to its lookup
table. Then the pairs of features with most left to explain get tables of two bins in the same way. A score is the logistic of a sum
of looked-up numbers, so scoring is an addition for each table over arrays of bins.

Training is bounded: at most `most` labelled rows of the training folds, those with the smallest hashes of their doc_ids, taken to the
driver as features, never as texts; a table of some thousand numbers goes back to the tasks. All else is a pass over the documents
in Arrow batches, each text read whole and on its own.

Null text counts as empty, which is a text like any other. A null doc_id has no label and is held out by no fold; rows that repeat a doc_id
are scored each on its own, and give one row to learn from, the one with the smallest features; of labels that repeat a doc_id the
largest counts, and null labels are none. With labels of a single kind all documents get the same score, with none one half. An empty table
gives an empty result. Other columns pass through, whatever their names; quality_score is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations, islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table

FOLDS, HELD_OUT, LIMIT = 4, 2, 0.7
#: Labelled rows to learn from at most.
MOST = 20_000
SEED = 12
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.15, 1.0
#: A leaf holds so many rows at least, as a share of all.
LEAF = 0.002
#: Shorter lines are no worst lines.
LINE_WORDS = 6

KINDS = ("upper", "lower", "digit", "symbol", "shout", "stop", "space", "newline", "other")
#: The kind of each byte; those beyond ASCII are parts of letters as a rule.
KIND = np.full(256, KINDS.index("other"), np.int64)
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#$%&*|", b"!?", b".,;:", b" \t\r\x0b\x0c", b"\n")):
    KIND[list(_chars)] = _k
NAMES = (
    "log_words", "log_bytes", "word_length", "distinct_words", "top_word", "next_equal", "longest_run", "short_words", "upper", "digit", "symbol", "shout",
    "stop", "other", "distinct_lines", "log_line_words", "worst_upper", "worst_symbol", "worst_shout", "worst_next_equal", "least_stop", "wordless_lines",
)


def _runs(words: list[str]) -> tuple[int, int]:
    """How many words equal the one before, and the longest run of one word."""
    same = np.fromiter(map(eq, words, islice(words, 1, None)), bool, max(0, len(words) - 1))
    if not same.any():
        return 0, min(1, len(words))
    breaks = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    return int(same.sum()), int(np.diff(breaks).max())


def features(text: str | None) -> np.ndarray:
    """The numbers in NAMES; zeros for a text without words."""
    out = np.zeros(len(NAMES))
    lines = (text or "").split("\n")
    by_line = [line.split() for line in lines]
    words = [w for ws in by_line for w in ws]
    if not words:
        return out
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    k, line = KIND[data], np.cumsum(data == 10)
    counts = np.bincount(line * len(KINDS) + k, minlength=len(lines) * len(KINDS)).reshape(len(lines), len(KINDS))
    of = dict(zip(KINDS, counts.T, strict=True))
    total = {name: int(c.sum()) for name, c in of.items()}
    n, sizes = len(words), np.array([len(ws) for ws in by_line])
    seen = Counter(words)
    repeated, run = _runs(words)
    visible = max(1, len(data) - total["space"] - total["newline"])
    letters = max(1, total["upper"] + total["lower"])
    out[:16] = (
        np.log1p(n), np.log1p(len(data)), visible / n, len(seen) / n, max(seen.values()) / n, repeated / n, np.log1p(run), sum(len(w) <= 3 for w in words) / n,
        total["upper"] / letters, total["digit"] / visible, total["symbol"] / visible, total["shout"] / visible, total["stop"] / n, total["other"] / visible,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)),
    )
    long = np.flatnonzero(sizes >= LINE_WORDS)
    if len(long):
        size = sizes[long]
        out[16] = (of["upper"][long] / np.maximum(1, of["upper"][long] + of["lower"][long])).max()
        out[17] = (of["symbol"][long] / size).max()
        out[18] = (of["shout"][long] / size).max()
        out[19] = max(sum(map(eq, by_line[i], islice(by_line[i], 1, None))) / len(by_line[i]) for i in long)
        out[20] = (of["stop"][long] / size).min()
    out[21] = (sizes == 0).mean()
    return out


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Between the quantiles of a feature, at most bins - 1 of them."""
    values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    return values[values < x.max()]


def _newton(g: np.ndarray | float, h: np.ndarray | float) -> np.ndarray | float:
    return -g / (h + RIDGE)


def _gain(g: np.ndarray | float, h: np.ndarray | float) -> np.ndarray | float:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float) -> int:
    """After which bin to cut, 0 if nowhere."""
    gl, hl, nl = (np.cumsum(x)[:-1] for x in (g, h, n))
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < least) | (n.sum() - nl < least)] = 0
    return int(gain.argmax()) + 1 if len(gain) and gain.max() > 1e-9 else 0


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """A step for each bin from a tree of depth two over the bins' gradients."""
    out, root = np.zeros(len(g)), _best_cut(g, h, n, least)
    for a, b in ((0, root), (root, len(g))):
        cut = a + _best_cut(g[a:b], h[a:b], n[a:b], least) if b > a else a
        for lo, hi in ((a, cut), (cut, b)):
            if hi > lo:
                out[lo:hi] = _newton(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _quadrants(g: np.ndarray) -> list[np.ndarray]:
    """Sums over the four parts of a table for every cross of cuts."""
    low = g.cumsum(0).cumsum(1)
    left, top = low[:-1, -1:], low[-1:, :-1]
    a = low[:-1, :-1]
    return [a, left - a, top - a, low[-1, -1] - left - top + a]


def best_cross(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float) -> tuple[float, int, int]:
    """Gain and place of the best cross of two cuts."""
    if min(g.shape) < 2:
        return 0.0, 0, 0
    parts = list(zip(_quadrants(g), _quadrants(h), _quadrants(n), strict=True))
    gain = sum(np.where(m >= least, _gain(a, b), 0) for a, b, m in parts) - _gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[i, j]), int(i) + 1, int(j) + 1


@dataclass
class Additive:
    """Cut points and tables. A feature without cuts has one bin and no say."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (cut, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += values[np.searchsorted(cut, x[:, k])]
        for i, j, values in self.pairs:
            out += values[np.searchsorted(self.coarse[i], x[:, i]), np.searchsorted(self.coarse[j], x[:, j])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.margin(x))


def _logistic(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of the single tables, then of those of the pairs that the gradients call for."""
    model, n = Additive(), len(y)
    if n:
        rate = (y.sum() + 0.5) / (n + 1)
        model.base = float(np.log(rate / (1 - rate)))
    if not n or y.min() == y.max():
        return model
    least, m = max(2.0, LEAF * n), np.full(n, model.base)
    model.cuts = [cut_points(x[:, k], BINS) for k in range(x.shape[1])]
    model.coarse = [cut_points(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, k]) for k, c in enumerate(model.cuts)]

    def boost(places: list[np.ndarray], tables: list[np.ndarray], tree, rounds: int) -> None:
        """In turn, each table takes a step along a tree over the gradients of its bins."""
        full = [np.bincount(p, minlength=t.size).reshape(t.shape).astype(float) for p, t in zip(places, tables, strict=True)]
        for _ in range(rounds):
            for p, t, c in zip(places, tables, full, strict=True):
                prob = _logistic(m)
                g, h = (np.bincount(p, w, t.size).reshape(t.shape) for w in (prob - y, prob * (1 - prob)))
                step = RATE * tree(g, h, c, least)
                t += step
                m[:] += step.reshape(-1)[p]

    used = [k for k, c in enumerate(model.cuts) if len(c)]
    boost([np.searchsorted(model.cuts[k], x[:, k]) for k in used], [model.tables[k] for k in used], shallow_tree, ROUNDS)
    coarse, prob, found = [np.searchsorted(c, x[:, k]) for k, c in enumerate(model.coarse)], _logistic(m), []
    for i, j in combinations([k for k in used if len(model.coarse[k])], 2):
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        place = coarse[i] * shape[1] + coarse[j]
        held = [np.bincount(place, w, shape[0] * shape[1]).reshape(shape) for w in (prob - y, prob * (1 - prob), np.ones(n))]
        found.append((best_cross(*held, least)[0], i, j, place, shape))
    found = sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:PAIRS]
    model.pairs = [(i, j, np.zeros(shape)) for _, i, j, _, shape in found]
    boost([f[3] for f in found], [t for _, _, t in model.pairs], cross_step, PAIR_ROUNDS)
    return model


def cross_step(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """A step for each pair of bins from the best cross: a tree of depth two, one cut on each feature."""
    gain, i, j = best_cross(g, h, n, least)
    out = np.zeros(g.shape)
    if gain > 1e-9:
        for part in ((slice(None, i), slice(None, j)), (slice(None, i), slice(j, None)), (slice(i, None), slice(None, j)), (slice(i, None), slice(j, None))):
            if n[part].sum() >= least:
                out[part] = _newton(g[part].sum(), h[part].sum())
    return out


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(text: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in text])


def sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `most` documents of the training folds. Hashes below a bound that about `most` of them pass are put
    in order, so that no task holds many more."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    told = told.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("key", F.xxhash64(F.lit(SEED), "doc_id"))
    share = min(1.0, 1.1 * most / max(1, told.count()))
    told = told.where(F.col("key").cast("double") <= F.lit(-(2.0**63) + share * 2.0**64)).orderBy("key", "doc_id").limit(most)
    told = materialise(told, "quality-labels")
    some = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(told), "doc_id")  # `most` rows
    # a doc_id that many rows share gives one of them
    rows = some.select("doc_id", "quality", _features("text").alias("x")).groupBy("doc_id").agg(F.min("x").alias("x"), F.first("quality").alias("quality"))
    rows = sorted(rows.collect())
    return np.array([r.x for r in rows]).reshape(len(rows), len(NAMES)), np.array([float(r.quality == 1) for r in rows])


def score_quality(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """docs with quality_score, from 0 to 1; learned from the texts of labelled (docs itself if not given) and labels (doc_id, quality)."""
    model = docs.sparkSession.sparkContext.broadcast(train(*sample(docs if labelled is None else labelled, labels, text, doc_id, most)))  # some thousand numbers

    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in text]).reshape(len(text), len(NAMES))
        return pd.Series(model.value.score(x))

    kept = [F.col(f"`{c}`") for c in docs.columns if c != "quality_score"]
    return docs.select(*kept, scored(F.col(f"`{text}`")).alias("quality_score"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = F.col("quality_score")
    return score_quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), score.alias("score"), (score >= LIMIT).cast("int").alias("predicted")
    )
