"""Language-model scoring with a hierarchical Pitman-Yor model.

Each word has a context restaurant for what follows it; all of them share one parent restaurant, whose customers are the tables of
the contexts and whose base is uniform over the words met in training and one more. A round of the Gibbs sampler draws the seatings
of all contexts given the parent, sends the tables to the parent, and draws the parent's seating in its turn. Predictive
probabilities are averaged over all rounds but the first.

Nothing of the model is broadcast or gathered. The text is read twice: once to find what is frequent, once to deal word pairs.

1. Groups of about `GROUP_CHARS` characters send their distinct word pairs, with training counts and documents, to the buckets of the
   contexts. A bucket keeps its restaurants and the documents of each pair in a table bucketed by its number, which later steps
   read in place.
2. Buckets send the words' training counts and tables to the buckets of the words, which answer with the sums over all contexts and
   the parent's tables: once for the first seating (a table for each dish), then once a round. Draws depend on the pairs'
   hashes alone, so a step repeats the rounds before it from their answers in place of keeping a state.
3. With the last answers each bucket scores its pairs and adds the scores up by document; they meet once more by group.

So the size of a task doesn't depend on the session, and the results not on the number of tasks or their order.

Words over 1 / `HOT` of all tokens, fewer than `HOT`, are dealt over `SALTS` buckets as contexts; the tables of their other shares come
with the answers. Pairs over 1 / `HOT` of all tokens, fewer than `HOT`, leave their documents in the group's own row,
and their probabilities - a row each - are broadcast to these.

A null text is empty: the end token alone. A null doc_id counts as the empty string in the split. Rows that repeat a doc_id are
scored on their own. An empty table gives an empty result. Further columns of the input aren't looked at.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import least, pack, spread, starts, unpack
from .common import materialise, release, table, work_dir
from .seating import gamma, mix, sample_tables

FOLDS, HELD_OUT = 5, 1
GROUP_CHARS = 8_000_000
#: Tokens of a bucket; there are as many partitions as buckets.
BUCKET_TOKENS = 2_000_000
HOT, SALTS = 2000, 16
CONTEXT_DISCOUNT, PARENT_DISCOUNT, STRENGTH = 0.8, 0.7, 1.0
ROUNDS, BURN_IN, SEED = 3, 1, 11
#: White space can't be part of a word, so these stand for the end and the beginning of a text.
END, BEGIN = b"\n", b"\r"
#: The bucket of rows that hold hot pairs' probabilities.
HOT_PAIRS = 2**31 - 1


def held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


@dataclass
class Corpus:
    """Tokens of a group of texts: words, contexts and documents as numbers, and the hashes of the words."""

    ids: list
    vocabulary: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    contexts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.contexts = np.empty_like(self.words)
        self.contexts[1:] = self.words[:-1]
        self.contexts[starts(self.lengths)] = 1


def _corpus(ids: list, texts: list[bytes]) -> Corpus:
    from xxhash import xxh64_intdigest

    index = {END: 0, BEGIN: 1}
    tokens, lengths = [], []
    for t in texts:
        words = t.lower().split()  # of bytes: A-Z and ASCII white space only
        tokens += [index.setdefault(w, len(index)) for w in words]
        tokens.append(0)
        lengths.append(len(words) + 1)
    vocabulary = np.array([xxh64_intdigest(w) for w in index], np.uint64)
    return Corpus(ids, vocabulary, np.array(tokens, np.int32), np.array(lengths))


def _corpora(batches: Iterator[pa.RecordBatch], group_chars: int) -> Iterator[Corpus]:
    """Rows (doc_id, text) in groups."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py())
            chars += len(texts[-1])
            if chars >= group_chars:
                yield _corpus(ids, texts)
                ids, texts, chars = [], [], 0
    if ids:
        yield _corpus(ids, texts)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, starts and ends of the runs of equal keys."""
    if not len(sorted_keys):
        return sorted_keys, np.array([], np.int64), np.array([], np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[start], start, np.append(start[1:], len(sorted_keys))


@dataclass
class Frequent:
    """What is dealt over several tasks: numbers of buckets, hashes of hot words and of hot pairs."""

    buckets: int
    words: np.ndarray
    pairs: np.ndarray

    def bucket(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        salt = np.where(np.isin(contexts, self.words), mix(words, 7) % np.uint64(SALTS), np.uint64(0))
        return self.of_word(mix(contexts, salt))

    def of_word(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes, 3) % np.uint64(self.buckets)).astype(np.int64)


def frequent(slim: DataFrame, group_chars: int = GROUP_CHARS, hot_share: int = HOT) -> Frequent:
    """Of all tokens. What is over 1 / hot_share of them is so in some group, and a group has fewer than hot_share such words or pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _corpora(batches, group_chars):
            n = np.bincount(c.words, minlength=len(c.vocabulary))
            often = np.flatnonzero(n * hot_share > len(c.words))
            place = np.full(len(n), -1)
            place[often] = np.arange(len(often))
            place[1], size = len(often), len(often) + 1  # a text's beginning may be half of a hot pair
            a, b = place[c.contexts], place[c.words]
            both = np.bincount((a * size + b)[(a >= 0) & (b >= 0)], minlength=size * size)
            hot = np.flatnonzero(both * hot_share > len(c.words))
            name = np.append(c.vocabulary[often], c.vocabulary[1])
            begins = len(c.lengths) * hot_share > len(c.words)
            words, counts = name[: len(often) + begins], np.append(n[often], len(c.lengths))[: len(often) + begins]
            kinds = np.repeat(["word", "pair", "all"], [len(words), len(hot), 1])
            hashes = np.concatenate([words, mix(name[hot // size], name[hot % size]), np.zeros(1, np.uint64)])
            total = np.concatenate([counts, both[hot], [len(c.words)]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(hashes.view(np.int64)), pa.array(total)], names=["kind", "hash", "n"]
            )

    found = slim.mapInArrow(count, "kind string, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n"))
    # fewer than 2 * hot_share rows once they are added up
    found = materialise(found, "frequent")
    total = found.where("kind = 'all'").agg(F.sum("n")).first()[0] or 0
    rows = found.where((F.col("kind") != "all") & (F.col("n") * hot_share > total)).collect()
    words, pairs = (np.array(sorted(r["hash"] % 2**64 for r in rows if r["kind"] == k), np.uint64) for k in ("word", "pair"))
    return Frequent(max(16, -(-total // BUCKET_TOKENS)), words, pairs)


def _dealt(c: Corpus, how: Frequent) -> Iterator[tuple[int, bytes]]:
    """First (-1, the group's own row), then (bucket, word pairs of a group)."""
    n, held = len(c.vocabulary), np.array([held_out(x) for x in c.ids])
    docs = np.repeat(np.arange(len(c.lengths), dtype=np.int32), c.lengths)
    key = c.contexts.astype(np.int64) * n + c.words
    order = np.argsort(key, kind="stable")
    key, docs = key[order], docs[order]
    # a pair's documents, each with its number of times; texts are in order, so equal ones are neighbours
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (docs[1:] != docs[:-1])])
    at = np.flatnonzero(new)
    times, key, docs = np.diff(np.append(at, len(new))).astype(np.int32), key[at], docs[at]
    del order, new
    pair, start, end = _runs(key)
    trained = np.add.reduceat(np.where(held[docs], 0, times), start)
    context, word = pair // n, pair % n
    hot = np.isin(mix(c.vocabulary[context], c.vocabulary[word]), how.pairs)
    mine = np.flatnonzero(hot)
    many = (end - start)[mine]
    own = spread(start[mine], many)
    hashes = mix(c.vocabulary[context[mine]], c.vocabulary[word[mine]])
    yield -1, pack(least(c.lengths), hashes, least(many), least(docs[own]), least(times[own]))
    bucket = how.bucket(c.vocabulary[context], c.vocabulary[word])
    order = np.argsort(bucket, kind="stable")
    for b, lo, hi in zip(*_runs(bucket[order]), strict=True):
        mine = order[lo:hi]
        cs, c_pairs = np.unique(context[mine], return_counts=True)  # pairs are sorted by context
        ws, w_at = np.unique(word[mine], return_inverse=True)
        many = np.where(hot[mine], 0, (end - start)[mine])
        occurs = spread(start[mine], many)
        yield int(b), pack(
            c.vocabulary[cs], least(c_pairs), c.vocabulary[ws], least(w_at), least(trained[mine]),
            least(many), least(docs[occurs]), least(times[occurs]),
        )


def _restaurants(parts: list[int], payloads: list[bytes]) -> tuple[bytes, bytes]:
    """The distinct pairs of a bucket with their training counts, by context; and the documents of each group's pairs."""
    blocks = [unpack(p) for p in payloads]
    contexts, context = np.unique(np.concatenate([np.repeat(b[0], b[1]) for b in blocks]), return_inverse=True)
    words, word = np.unique(np.concatenate([b[2][b[3]] for b in blocks]), return_inverse=True)
    pairs, pair = np.unique(context * len(words) + word, return_inverse=True)
    trained = np.bincount(pair, weights=np.concatenate([b[4] for b in blocks])).astype(np.int64)
    per_context = np.bincount(pairs // len(words), minlength=len(contexts))
    seats = pack(contexts, least(per_context), words, least(pairs % len(words)), least(trained))
    sizes = np.array([len(b[3]) for b in blocks])
    occurs = pack(
        np.array(parts, np.int64), least(sizes), least(np.array([len(b[6]) for b in blocks])), least(pair),
        *(least(np.concatenate([b[k].astype(np.int64) for b in blocks])) for k in (5, 6, 7)),
    )
    return seats, occurs


@dataclass
class Answer:
    """What the words' buckets said of a bucket's words in one round, and the sums over all words."""

    tables: np.ndarray
    seats: np.ndarray
    counts: np.ndarray | None
    totals: dict[str, float]
    #: hashes of hot words, with their customers and tables as contexts
    hot: tuple[np.ndarray, np.ndarray, np.ndarray]

    def parent(self) -> np.ndarray:
        t = self.totals
        base = (STRENGTH + PARENT_DISCOUNT * t["seats"]) / (t["v"] + 1)
        return (np.maximum(self.tables - PARENT_DISCOUNT * self.seats, 0) + base) / (STRENGTH + t["tables"])


class Restaurants:
    """A bucket's contexts and pairs."""

    def __init__(self, seats: bytes, how: Frequent) -> None:
        self.contexts, per, self.words, word, trained = unpack(seats)
        self.customers, self.word = trained.astype(np.int64), word.astype(np.int64)
        self.context = np.repeat(np.arange(len(self.contexts)), per)
        self.hashes = mix(self.contexts[self.context], self.words[self.word])
        self.is_hot = np.isin(self.contexts, how.words)
        self.tables = (self.customers > 0).astype(np.int64)
        self.diners = self._sum(self.customers)
        to = how.of_word(self.words)
        self.order = np.lexsort((self.words, to))
        self.asked = list(zip(*_runs(to[self.order]), strict=True))

    def _sum(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=x, minlength=len(self.contexts))

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """(bucket of words, their hashes, training counts and tables)"""
        sums = [np.bincount(self.word, weights=x, minlength=len(self.words)).astype(np.int64) for x in (self.customers, self.tables)]
        for b, lo, hi in self.asked:
            some = self.order[lo:hi]
            yield int(b), pack(self.words[some], *(least(x[some]) for x in sums))

    def hot_shares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = np.flatnonzero(self.is_hot)
        return self.contexts[some], self.diners[some], self._sum(self.tables)[some]

    def answered(self, payloads: dict[int, bytes], totals: dict[str, float], hot: tuple) -> Answer:
        got = [np.zeros(len(self.words)) for _ in range(3)]
        for b, lo, hi in self.asked:
            for to, x in zip(got, unpack(payloads[int(b)]), strict=True):
                to[self.order[lo:hi]] = x
        return Answer(got[0], got[1], got[2], totals, hot)

    def _everywhere(self, here: np.ndarray, answer: Answer, which: int) -> np.ndarray:
        """Customers (1) or tables (2) of whole restaurants, of which hot ones have shares in other buckets."""
        out = self._sum(here)
        out[self.is_hot] = answer.hot[which][np.searchsorted(answer.hot[0], self.contexts[self.is_hot])]
        return out

    def rounds(self, answers: list[Answer], rate: bool = False) -> Iterator[np.ndarray]:
        """A sweep for each answer. To rate, a sweep for each but the last, and all pairs' predictive probabilities after each: the next
        answer holds the tables that it left."""
        diners = self._everywhere(self.customers, answers[0], 1)
        for k, answer in enumerate(answers[: len(answers) - rate]):
            parent, turn = answer.parent()[self.word], SEED + k * 1000
            shape = STRENGTH / CONTEXT_DISCOUNT + self._everywhere(self.tables, answer, 2)
            weight = CONTEXT_DISCOUNT * gamma(shape, mix(self.contexts, turn))[self.context] * parent
            self.tables = sample_tables(self.customers, weight, CONTEXT_DISCOUNT, mix(self.hashes, turn + 1))
            if rate:
                new = STRENGTH + CONTEXT_DISCOUNT * self._everywhere(self.tables, answers[k + 1], 2)
                mine = np.maximum(self.customers - CONTEXT_DISCOUNT * self.tables, 0)
                yield (mine + new[self.context] * parent) / (STRENGTH + diners[self.context])


def _answers(parts: list[int], payloads: list[bytes], turn: int, before: dict[str, float] | None) -> Iterator[tuple[int, bytes, dict]]:
    """For each asking bucket its words' tables over all contexts, the parent's tables and training counts; the sums with the first."""
    blocks = [unpack(p) for p in payloads]
    words, inverse = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
    counts, tables = (np.bincount(inverse, weights=np.concatenate([b[k] for b in blocks]), minlength=len(words)).astype(np.int64) for k in (1, 2))
    if before is None:  # the first seating
        seats = (tables > 0).astype(np.int64)
    else:
        g = gamma(np.array([STRENGTH / PARENT_DISCOUNT + before["seats"]]), np.array([SEED + turn], np.uint64))[0]
        weight = np.full(len(words), PARENT_DISCOUNT * g / (before["v"] + 1))
        seats = sample_tables(tables, weight, PARENT_DISCOUNT, mix(words, SEED + turn))
    sums = {"n": int(counts.sum()), "v": int((counts > 0).sum()), "tables": int(tables.sum()), "seats": int(seats.sum())}
    for k, (part, at) in enumerate(zip(parts, starts(np.array([len(b[0]) for b in blocks])), strict=True)):
        mine = inverse[at : at + len(blocks[k][0])]
        yield part, pack(*(least(x[mine]) for x in (tables, seats, counts))), sums if k == 0 else dict.fromkeys(sums, 0)


def _scores(seats: Restaurants, occurs: bytes, p: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each group its documents' sums over the pairs of this bucket: log10 p, known tokens, log10 of counts."""
    parts, sizes, docs_n, pair, many, docs, times = (x.astype(np.int64) for x in unpack(occurs))
    logs, known, plain = np.log10(p), counts > 0, np.log10(counts + 0.5)
    of = np.repeat(pair, many)
    word = seats.word[of]
    first = starts(docs_n)
    for k, part in enumerate(parts.tolist()):
        mine = slice(first[k], first[k] + docs_n[k])
        if docs_n[k]:
            at, here = np.unique(docs[mine], return_inverse=True)
            sums = [np.bincount(here, weights=x * times[mine]) for x in (logs[of[mine]], known[word[mine]], plain[word[mine]])]
            # the model's sums to six digits: the rest packs to nothing; the base's to twelve, as it is the same for any way to compute it
            short = np.rint(sums[0] * 2**20) / 2**20
            yield part, pack(least(np.diff(at, prepend=0)), short, least(sums[1].astype(np.int64)), np.rint(sums[2] * 2**40) / 2**40)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows by bucket; they come sorted by it."""
    bucket, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["bucket"] != bucket:
                yield bucket, rows
                rows = []
            bucket = row["bucket"]
            rows.append(row)
    if rows:
        yield bucket, rows


_ASKED = "bucket int, part int, payload binary, hot binary"
_ANSWERED = "bucket int, turn int, part int, payload binary, hot binary, n long, v long, tables long, seats long"


def _asking(seats: Restaurants, bucket: int) -> pa.Table:
    rows = [{"bucket": b, "part": bucket, "payload": x, "hot": None} for b, x in seats.questions()]
    rows[0]["hot"] = pack(*seats.hot_shares())
    return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("payload", pa.binary()), ("hot", pa.binary())]))


def _hot_totals(answers: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of hot words (fewer than HOT), with all their customers and tables as contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                h, customers, tables = unpack(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(customers), pa.array(tables)], names=["h", "c", "t"])

    rows = answers.where("hot IS NOT NULL").select("hot").mapInArrow(run, "h long, c double, t double").groupBy("h").agg(F.sum("c"), F.sum("t")).collect()
    rows = sorted((r[0] % 2**64, r[1], r[2]) for r in rows)
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def _answer(asked: DataFrame, width: int, turn: int, before: dict[str, float] | None) -> DataFrame:
    """What the words' buckets answer in one round. The hot contexts' shares pass through, to be added up from the written answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            rows.sort(key=lambda r: r["part"])
            said = _answers([r["part"] for r in rows], [r["payload"] for r in rows], turn, before)
            for r, (part, payload, sums) in zip(rows, said, strict=True):
                row = {"bucket": [part], "turn": [turn], "part": [bucket], "payload": [payload], "hot": [r["hot"]], **{k: [x] for k, x in sums.items()}}
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row.values(), kinds, strict=True)], names=list(row))

    asked = asked.repartition(width, "bucket").sortWithinPartitions("bucket")
    return materialise(asked.mapInArrow(run, _ANSWERED), "word-answers")


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by its column bucket: joins by it read it in place."""
    name = f"lumenspan_{uuid.uuid4().hex}"
    how = df.write.format("parquet").bucketBy(buckets, "bucket")
    how.option("path", f"{work_dir(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group_chars: int = GROUP_CHARS, hot_share: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, for each row of docs."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "utf-8").alias("text"))
    kind = slim.schema["doc_id"].dataType
    how = frequent(slim, group_chars, hot_share)
    width = how.buckets
    groups = T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)),
        T.StructField("seats", T.BinaryType()), T.StructField("occurs", T.BinaryType()),
    ])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, id_type = TaskContext.get().partitionId() << 32, None

        def through() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        for c in _corpora(through(), group_chars):
            for b, payload in _dealt(c, how):
                ids = pa.array([c.ids if b < 0 else None], pa.list_(id_type))
                to = pa.array([b if b >= 0 else -1 - part % how.buckets], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array([part]), ids, pa.array([payload], pa.binary()), pa.nulls(1, pa.binary())], names=groups.names)
            part += 1

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def through() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("doc_ids").type
                yield batch

        for bucket, rows in _by_bucket(through()):
            rows.sort(key=lambda r: r["part"])
            if bucket < 0:
                done = [(r["part"], r["doc_ids"], r["seats"], None) for r in rows]
            else:
                done = [(0, None, *_restaurants([r["part"] for r in rows], [r["seats"] for r in rows]))]
            for part, ids, seats, occurs in done:
                columns = [pa.array([bucket], pa.int32()), pa.array([part], pa.int64()), pa.array([ids], id_type), pa.array([seats], pa.binary()), pa.array([occurs], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=groups.names)

    dealt = slim.mapInArrow(deal, groups).repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(seat, groups)
    tables = _bucketed(dealt, width)
    release(spark)
    restaurants = tables.where("bucket >= 0").select("bucket", "seats", "occurs")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, seats in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _asking(Restaurants(seats.as_py(), how), bucket).to_batches()

    totals: list[dict[str, float]] = []
    hot: list[tuple] = []
    answers = None

    def meeting(columns: list[str], then: Callable[[int, Restaurants, list[Answer], pa.Table], pa.Table], schema: str) -> DataFrame:
        """Restaurants with the answers that their bucket got so far."""
        known, totals_now, hot_now = how, list(totals), list(hot)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            seats, got = Restaurants(left.column("seats")[0].as_py(), known), [{} for _ in totals_now]
            for turn, part, payload in zip(*(right.column(c).to_pylist() for c in ("turn", "part", "payload")), strict=True):
                got[turn][part] = payload
            said = [seats.answered(*x) for x in zip(got, totals_now, hot_now, strict=True)]
            return then(left.column("bucket")[0].as_py(), seats, said, left)

        right = answers.select("bucket", "turn", "part", "payload")
        return restaurants.select(*columns).groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(run, schema)

    def ask(bucket: int, seats: Restaurants, said: list[Answer], _: pa.Table) -> pa.Table:
        for _ in seats.rounds(said):
            pass  # what counts are the tables
        return _asking(seats, bucket)

    def rate(bucket: int, seats: Restaurants, said: list[Answer], left: pa.Table) -> pa.Table:
        kept = list(seats.rounds(said, rate=True))[BURN_IN:]
        p = sum(kept) / len(kept)
        counts = said[0].counts
        rows = [(bucket, part, x) for part, x in _scores(seats, left.column("occurs")[0].as_py(), p, counts)]
        some = np.flatnonzero(np.isin(seats.hashes, how.pairs))
        if len(some):
            words = counts[seats.word[some]]
            rows.append((HOT_PAIRS, 0, pack(seats.hashes[some], np.log10(p[some]), words > 0, np.log10(words + 0.5))))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "part", "payload"])

    for turn in range(ROUNDS + 1):
        asked = restaurants.select("bucket", "seats").mapInArrow(first, _ASKED) if turn == 0 else meeting(["bucket", "seats"], ask, _ASKED)
        said = _answer(asked, width, turn, totals[-1] if totals else None)
        totals.append({k: float(x or 0) for k, x in said.agg(*[F.sum(c).alias(c) for c in ("n", "v", "tables", "seats")]).first().asDict().items()})
        hot.append(_hot_totals(said))
        answers = said if answers is None else answers.unionByName(said)
        release(spark)
    rated = materialise(meeting(["bucket", "seats", "occurs"], rate, "bucket int, part long, payload binary"), "pair-scores")
    release(spark)
    pairs = [unpack(r["payload"]) for r in rated.where(F.col("bucket") == HOT_PAIRS).select("payload").collect()]
    hot_pairs = [np.concatenate(x) for x in zip(*pairs, strict=True)] if pairs else [np.zeros(0, np.uint64)] + [np.zeros(0)] * 3
    hot_pairs = [x[np.argsort(hot_pairs[0])] for x in hot_pairs]
    train_tokens = int(totals[0]["n"])
    scale = math.log10(totals[0]["n"] + 0.5 * (totals[0]["v"] + 1))
    held = held_out
    out = T.StructType([
        T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
        *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")],
    ])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, ids, lengths, sums = None, None, None, None

        def done() -> pa.RecordBatch:
            logs, known, plain = sums
            n = lengths.astype(np.int64)
            columns = [pa.array(ids, id_type.value_type), pa.array([held(x) for x in ids], pa.bool_()), pa.array(n), pa.array(known.astype(np.int64))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(n), train_tokens, np.int64)), pa.array(plain - n * scale), pa.array(logs)], names=out.names)

        for batch in batches:  # sorted by part and bucket: a group's own row comes first
            id_type = batch.schema.field("doc_ids").type
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    if ids is not None:
                        yield done()
                    ids = row["doc_ids"]
                    lengths, hashes, many, at, times = unpack(row["payload"])
                    place = np.repeat(np.searchsorted(hot_pairs[0], hashes), many)
                    sums = [np.bincount(at, weights=x[place] * times, minlength=len(lengths)).astype(np.float64) for x in hot_pairs[1:]]
                else:
                    gaps, *some = unpack(row["payload"])
                    at = np.cumsum(gaps.astype(np.int64))
                    for to, x in zip(sums, some, strict=True):
                        to[at] += x
        if ids is not None:
            yield done()

    own = tables.where("bucket < 0").select("bucket", "part", "doc_ids", F.col("seats").alias("payload"))
    rows = own.unionByName(rated.where(F.col("bucket") != HOT_PAIRS), allowMissingColumns=True)
    return rows.repartition(width, "part").sortWithinPartitions("part", "bucket").mapInArrow(total, out)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
