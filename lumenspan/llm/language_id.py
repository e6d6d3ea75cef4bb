"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text, lower-cased, white space and all, in both directions, labels every byte, and a document's
probabilities are the mean of the labels' over all its bytes. Texts are read in windows of `CORE` bytes that begin at characters,
with `MARGIN` bytes of the text around them at both sides: each byte is labelled once, by a network that has read at least so many
bytes before and after it (or all there are), across words. Gates and states use x / (1 + |x|), numpy's cheapest smooth step.

It is trained in numpy by backpropagation through time, on the driver, from pieces of at most `PER_LANGUAGE` labelled documents of each
language of the training folds: `PIECES` evenly spread pieces of `PIECE_CHARS` characters of each (these bounds are the
parameters). Only text is an input. Prediction reads every text whole, inside tasks.

Null text and text without a letter give `und` with score 0. A null or blank lang is not learned from; if no row is labelled, every
text is `und`. Languages of any number are learned. A null doc_id counts as the empty string in the split. Rows that repeat a
doc_id are predicted on their own; rows that repeat doc_id and text are learned from once. An empty table gives an empty result.
Further columns pass through `predict`; those named lang_pred and lang_score are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import starts
from .common import table

FOLDS, HELD_OUT = 5, 0
PER_LANGUAGE, PIECES, PIECE_CHARS = 300, 8, 256
HIDDEN, EMBED, CORE, MARGIN = 16, 16, 192, 32
STEPS, BATCH, LENGTH, RATE, SEED = 200, 128, 64, 0.01, 5
#: Windows that are read at once, and characters of the texts that are cut into windows at once.
WIDTH, GROUP_CHARS = 1024, 1_000_000
UNKNOWN = "und"
#: Letters, and numbers that are no decimal digits.
LIKELY = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LIKELY.finditer(text))


def in_fold(doc_id: Column, fold: int) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "utf-8")) % FOLDS == fold


def _step(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def _slope(y: np.ndarray) -> np.ndarray:
    return (1 - np.abs(y)) ** 2


class BiGru:
    """Two gated recurrent layers, one in each direction, and a label at every byte. Byte 0 is padding: it leaves the state alone."""

    def __init__(self, classes: int, rng: np.random.Generator) -> None:
        h, e = HIDDEN, EMBED
        scale = lambda *s: (rng.standard_normal(s) * np.sqrt(1 / s[0])).astype(np.float32)
        self.p = {"emb": (rng.standard_normal((256, e)) * 0.3).astype(np.float32), "out": scale(2 * h, classes), "bias": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": scale(e, 3 * h), f"u{d}": scale(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}

    def _gates(self, d: str) -> list[np.ndarray]:
        """What each byte adds to update, reset and new state."""
        table = self.p["emb"] @ self.p[f"w{d}"] + self.p[f"b{d}"]
        table[0, :HIDDEN] = -1e9
        return [np.ascontiguousarray(x) for x in np.split(table, 3, axis=1)]

    def forward(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities (steps, n, classes) for bytes x (steps, n)."""
        logits = np.empty((*x.shape, len(self.p["bias"])), self.p["out"].dtype)
        logits[:] = self.p["bias"]
        for d, out in zip("fb", np.split(self.p["out"], 2), strict=True):
            gates, u = self._gates(d), [np.ascontiguousarray(m) for m in np.split(self.p[f"u{d}"], 3, axis=1)]
            state, trace = np.zeros((x.shape[1], HIDDEN), out.dtype), []
            for t in range(len(x)) if d == "f" else reversed(range(len(x))):
                z, r, new = (g.take(x[t], axis=0) for g in gates)
                z += state @ u[0]
                r += state @ u[1]
                q = state @ u[2]
                for gate in (z, r):
                    _step(gate)
                    gate += 1
                    gate *= 0.5
                new += r * q
                _step(new)
                move = new - state
                if keep is not None:
                    trace.append((t, state, z, r, q, new))
                move *= z
                move += state
                state = move
                logits[t] += state @ out
                if keep is not None:
                    trace[-1] += (state,)
            if keep is not None:
                keep[d] = trace
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits, out=logits)
        prob /= prob.sum(axis=2, keepdims=True)
        return prob

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over bytes, and its gradients by backpropagation through time."""
        keep: dict = {}
        prob, h = self.forward(x, keep), HIDDEN
        there = (x > 0)[..., None]
        n, width = there.sum(), x.shape[1]
        loss = -float((np.log(prob[:, np.arange(width), y] + 1e-9) * there[..., 0]).sum() / n)
        prob[:, np.arange(width), y] -= 1
        prob *= there / n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bias"] = prob.sum(axis=(0, 1))
        for k, d in enumerate("fb"):
            u, out = self.p[f"u{d}"], self.p["out"][k * h : (k + 1) * h]
            back = np.zeros((width, h), out.dtype)
            table = np.zeros((256, 3 * h), out.dtype)
            for t, state, z, r, q, new, after in reversed(keep[d]):
                g["out"][k * h : (k + 1) * h] += after.T @ prob[t]
                total = back + prob[t] @ out.T
                dnew = total * z * _slope(new)
                dz = total * (new - state) * _slope(2 * z - 1) / 2
                dr = dnew * q * _slope(2 * r - 1) / 2
                into = np.concatenate([dz, dr, dnew * r], axis=1)
                g[f"u{d}"] += state.T @ into
                back = total * (1 - z) + into @ u.T
                np.add.at(table, x[t], np.concatenate([dz, dr, dnew], axis=1))
            table[0] = 0
            g[f"w{d}"], g[f"b{d}"] = self.p["emb"].T @ table, table.sum(axis=0)
            g["emb"] += table @ self.p[f"w{d}"].T
        return loss, g


def padded(windows: list[bytes]) -> np.ndarray:
    """(steps, n): each window's bytes from the top, zeros below."""
    steps = max(map(len, windows))
    return np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in windows), np.uint8).reshape(len(windows), steps).T


def train(rows: list[tuple[str, str]], seed: int = SEED, steps: int | None = None) -> tuple[list[str], dict[str, np.ndarray]]:
    """(text, language) rows to languages and weights. Adam; every language is drawn equally often."""
    steps = STEPS if steps is None else steps
    rng, by = np.random.default_rng(seed), {}
    for text, lang in rows:
        by.setdefault(lang, []).append(bytes_of(text))
    by = {lang: texts for lang in sorted(by) if (texts := [t for t in by[lang] if t])}
    languages, net = list(by), BiGru(len(by), rng)
    if len(languages) < 2:
        return languages, net.p
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), BATCH)
        some = [by[languages[k]][int(rng.integers(len(by[languages[k]])))] for k in y]
        begin = [int(rng.integers(max(1, len(t) - LENGTH + 1))) for t in some]
        _, g = net.gradients(padded([t[b : b + LENGTH] for t, b in zip(some, begin, strict=True)]), y)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, grad in g.items():
            m[k] += 0.1 * (grad - m[k])
            v[k] += 0.01 * (grad * grad - v[k])
            net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return languages, net.p


def bytes_of(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").replace(b"\0", b"\x01")


def windows(text: np.ndarray) -> np.ndarray:
    """Where the windows' cores begin in a text's bytes: at characters, `CORE` bytes apart or up to three less."""
    cut = np.arange(0, len(text), CORE)
    for _ in range(3):  # a character has three further bytes at most
        cut -= (text[cut] & 0xC0) == 0x80
    return np.maximum(cut, 0)


def read(net: BiGru, texts: list[bytes], classes: int) -> np.ndarray:
    """Sums of the labels' probabilities over each text's bytes."""
    out = np.zeros((len(texts), classes))
    sizes = np.array([len(t) for t in texts])
    first = starts(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    cuts = [windows(data[a : a + n]) for a, n in zip(first, sizes, strict=True)]
    of = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
    if not len(of):
        return out
    core = np.concatenate(cuts)
    last = np.append(core[1:], 0)
    ends = np.append(of[1:] != of[:-1], True)
    last[ends] = sizes[of[ends]]
    lo, hi = np.maximum(core - MARGIN, 0), np.minimum(last + MARGIN, sizes[of])
    order = np.argsort(hi - lo, kind="stable")  # windows of like lengths together
    for at in range(0, len(order), WIDTH):
        some = order[at : at + WIDTH]
        row = np.arange(int((hi - lo)[some].max()))[:, None]
        inside = row < (hi - lo)[some]
        x = np.where(inside, data[np.where(inside, first[of[some]] + lo[some] + row, 0)], 0)
        prob = net.forward(x)
        prob *= ((row >= (core - lo)[some]) & (row < (last - lo)[some]))[..., None]
        np.add.at(out, of[some], prob.sum(axis=0, dtype=np.float64))
    return out


def pieces(text: Column) -> Column:
    """Evenly spread pieces of a text, as one text; short texts are left whole."""
    room = F.char_length(text) - PIECE_CHARS
    spread = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: text.substr((F.floor(room * i / (PIECES - 1)) + 1).cast("int"), F.lit(PIECE_CHARS)))
    return F.when(room <= PIECE_CHARS * (PIECES - 1), text).otherwise(F.array_join(spread, " "))


def sample(docs: DataFrame, text: str, lang: str, doc_id: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """Pieces of at most per_language labelled rows of each language from the training folds, those with the smallest hashes. Hashes
    below a bound that about per_language of them pass are collected: never more than some hundred rows a language."""
    fields = [F.col(f"`{c}`").cast("string") for c in (doc_id, text, lang)]
    rows = docs.where(~in_fold(F.col(f"`{doc_id}`"), HELD_OUT)).select(*[x.alias(n) for x, n in zip(fields, ("id", "text", "lang"), strict=True)])
    rows = rows.where(F.col("text").isNotNull() & (F.trim("lang") != "")).select("lang", F.xxhash64(F.lit(SEED), "id", "text").alias("key"), pieces(F.col("text")).alias("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n"))
    share = F.least(F.lit(1.0), F.lit(1.2 * per_language + 60) / F.col("n"))
    bound = counts.select("lang", (F.lit(-(2.0**63)) + share * 2.0**64).alias("last"))
    near = rows.join(F.broadcast(bound), "lang").where(F.col("key").cast("double") <= F.col("last"))  # a row for each language
    found = sorted((r["lang"], r["key"], r["text"]) for r in near.groupBy("lang", "key").agg(F.min("text").alias("text")).collect())
    taken: dict[str, int] = {}
    out = []
    for name, _, t in found:
        taken[name] = taken.get(name, 0) + 1
        if taken[name] <= per_language:
            out.append((t, name))
    return out


def predict(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """docs with lang_pred and lang_score; learned from labelled (docs itself if not given)."""
    spark = docs.sparkSession
    languages, weights = train(sample(labelled if labelled is not None else docs, text, lang, doc_id))
    model = spark.sparkContext.broadcast((languages, weights))  # some 20 kB
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score")] + [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    docs = docs.select(*[F.col(f"`{f.name}`") for f in schema.fields[:-2]])
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights = model.value
        net = BiGru(max(1, len(languages)), np.random.default_rng(0))
        net.p = weights
        for batch in batches:
            best: list[str] = []
            score: list[float] = []
            for texts in _groups(batch.column(where)):
                sums = read(net, [bytes_of(t) for t in texts], len(languages)) if languages else np.zeros((len(texts), 1))
                total = sums.sum(axis=1)
                share = sums / np.where(total > 0, total, 1)[:, None]
                for k, t in enumerate(texts):
                    plain = not languages or not t or not has_letter(t)
                    best.append(UNKNOWN if plain else languages[int(share[k].argmax())])
                    score.append(0.0 if plain else min(1.0, float(share[k].max())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _groups(texts: pa.Array) -> Iterator[list[str | None]]:
    run, size = [], 0
    for x in texts:
        run.append(x.as_py())
        size += len(run[-1] or "")
        if size >= GROUP_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang"))
    return out.select("doc_id", in_fold(F.col("doc_id"), HELD_OUT).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
