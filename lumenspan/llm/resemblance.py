"""Groups of texts by resemblance: SimHash links and MinHash bands find candidates, the exact Jaccard similarity of their shingles decides.

Texts whose sets of different shingles are equal are one node from then on. A node has `BANDS` keys of `ROWS` minima each; two texts that
share 0.8 of their shingles have a key in common with probability 1 - (1 - 0.8^7)^50 = 0.99999, whatever the size of the input. Nodes
that share a key are linked to the smallest of them, first within an Arrow batch, so that a key that very many nodes share reaches the
next task as one row a batch. Op 1's links join them: SimHash fingerprints within three bits, by its index. The components of all these links
are candidates only: the texts of each are brought together once and all pairs that aren't joined yet are compared.

A component of more than `GROUP_ROWS` nodes is dealt over tasks: chunks with some hubs that all of them get, then all rows outside of the
largest group found, in chunks, against all chunks. So every pair is compared or joined already, and a family of copies costs in
proportion to its size; only many texts that are candidates and no copies cost more.

Null, empty and blank texts have no shingles, and are one group. A null doc_id comes after all others; rows that repeat a doc_id are judged each by
its own text, and repeated rows are copies of each other, one of which stays. Of ties the row that was written first stays. An empty
table gives an empty result. Other columns pass through, whatever their names, but for `__row`, which is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import spread, starts
from .common import discard, materialise, release, shuffle_width, tagged
from .graph import components

SHINGLE, SEED = 5, 42
#: Texts are near copies if they share this part of their different shingles, as a fraction.
SHARED, OF = 4, 5
BANDS, ROWS = 50, 7
GROUP_ROWS, HUBS = 1000, 16
PER_TASK = 500_000
#: Shingles that are compared at once, which bounds the memory.
CHUNK = 1 << 22
_TURNS = np.random.default_rng(SEED).integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the different shingles; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_digest

    w = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    hashes = [xxh64_digest(b" ".join(t), SEED) for t in zip(*(w[i:] for i in range(SHINGLE)), strict=False)] or [xxh64_digest(b" ".join(w), SEED)]
    return np.unique(np.frombuffer(b"".join(hashes), np.uint64))


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 512):
            np.minimum(least, (h[None, at : at + 512] * _TURNS).min(axis=1), out=least)
        key = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key with its smallest id; and the different links of the other ids to it."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    to = ids[first][np.cumsum(first) - 1]
    u, v = ids[ids != to], to[ids != to]
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.zeros(0, bool)
    return keys[first], ids[first], u[new], v[new]


def candidates(nodes: DataFrame) -> DataFrame:
    """u, v: links between nodes (id, keys) that join all nodes which share a key. nodes: a written table."""
    width = shuffle_width(nodes.sparkSession, BANDS * nodes.count(), PER_TASK)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
                key, ids, u, v = _stars(keys, np.repeat(batch.column(0).to_numpy(), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((key, u), (ids, u), (np.full(len(ids), -1), v))], names=["key", "id", "to"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(c).to_numpy() for c in range(3)] for b in batches if b.num_rows]
        if got:
            keys, ids, to = (np.concatenate(x) for x in zip(*got, strict=True))
            here = to < 0
            _, _, u, v = _stars(keys[here], ids[here]) if here.any() else (None, None, ids[here], ids[here])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[~here], u])), pa.array(np.concatenate([to[~here], v]))], names=["u", "v"])

    dealt = nodes.select("id", "keys").mapInArrow(deal, "key long, id long, to long")
    return dealt.repartition(width, "key").mapInArrow(meet, "u long, v long")


def simhash_candidates(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v: links between nodes (digest, id) that texts of fingerprints within three bits make. prints: digest, fp of each text."""
    from . import simhash

    of = materialise(prints.select("digest", "fp").distinct().join(nodes.select("digest", "id"), "digest").select("fp", "id"), "fingerprint-nodes")
    first = materialise(of.groupBy("fp").agg(F.min("id").alias("v")), "fingerprints")
    same = of.join(first, "fp").where("id <> v").select(F.col("id").alias("u"), "v")
    linked = simhash.links(first.select("fp")).withColumnsRenamed({"u": "a", "v": "b"})
    far = linked.join(first.select(F.col("fp").alias("a"), F.col("v").alias("u")), "a").join(first.select(F.col("fp").alias("b"), "v"), "b")
    out = materialise(same.unionByName(far.where("u <> v").select("u", "v")), "simhash-links")
    for table in (of, first):
        discard(table)
    return out


def near_pairs(sets: list[np.ndarray], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of sets that share SHARED / OF of their values: enough pairs to join all such sets of different groups."""
    n = np.array([len(s) for s in sets])
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    at, label, mark = starts(n), np.unique(groups, return_inverse=True)[1], np.zeros(len(values), bool)
    left, right = [], []
    for x in range(len(sets) - 1):
        after = np.arange(x + 1, len(sets))
        others = after[(label[after] != label[x]) & (OF * np.minimum(n[after], n[x]) >= SHARED * np.maximum(n[after], n[x])) & (n[after] > 0)]
        if not len(others):
            continue
        mine = token[at[x] : at[x] + n[x]]
        mark[mine] = True
        part = np.cumsum(n[others]) // CHUNK
        for some in np.split(others, np.flatnonzero(np.diff(part)) + 1):
            shared = np.add.reduceat(mark[token[spread(at[some], n[some])]], starts(n[some]), dtype=np.int64)
            near = some[OF * shared >= SHARED * (n[x] + n[some] - shared)]
            if len(near):
                left.append(near)
                right.append(np.full(len(near), x))
                label[np.isin(label, label[near])] = label[x]
        mark[mine] = False
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(rows: DataFrame, width: int) -> DataFrame:
    """u, v: links among the rows (task, id, known, text) of each task; rows of the same known group are joined already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            i, j = near_pairs(sets, np.array(known))
            row = np.array(ids)
            return pa.RecordBatch.from_arrays([pa.array(row[i], pa.int64()), pa.array(row[j], pa.int64())], names=["u", "v"])

        task, ids, known, sets = None, [], [], []
        for batch in batches:
            for now, i, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != task:
                    if len(ids) > 1:
                        yield links()
                    task, ids, known, sets = now, [], [], []
                ids.append(i)
                known.append(k)
                sets.append(shingles(text or b""))
        if len(ids) > 1:
            yield links()

    return rows.select("task", "id", "known", "text").repartition(width, "task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def _chunks(n: Column, limit: int) -> Column:
    return F.ceil(n / F.lit(limit)).cast("int")


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def confirmed(texts: DataFrame, linked: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """u, v with v the smallest node of u's group, for every u but that. texts: id, text; linked: u, v likewise of the candidates."""
    members = materialise(linked.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(linked.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()), "candidates")
    discard(linked)
    release(texts.sparkSession)  # the keys have crossed the network; the texts of candidates are next
    width = shuffle_width(texts.sparkSession, members.count(), 20_000)
    sizes = members.groupBy("root").agg(_chunks(F.count(F.lit(1)), limit).alias("chunks"))
    large = materialise(sizes.where("chunks > 1"), "large-groups")
    split = not large.isEmpty()
    placed = members.join(large, "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    # hubs are drawn by hash, about HUBS of each large group
    hub = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("id", F.lit(SEED)), F.greatest(F.lit(1), F.col("chunks") * limit / HUBS).cast("long")) == 0)
    where = F.explode(F.when(hub, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk)))
    first = placed.select("id", "root", F.col("id").alias("known"), where.alias("chunk"))
    # merged at any size: what a plan does at one it does at all
    found = materialise(_compare(texts.join(first.hint("merge"), "id").withColumn("task", F.xxhash64("root", "chunk")), width), "near-links")
    joined = components(found)
    if not split:
        for table in (members, large, found):
            discard(table)
        return joined
    grouped = placed.where("chunks > 1").join(joined, F.col("id") == F.col("u"), "left").select("id", "root", "chunks", F.coalesce("v", "id").alias("known"))
    grouped = materialise(grouped, "large-rows")
    main = grouped.groupBy("root", "known").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max_by("known", "n").alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    main = main.where("n > most").select("root", "main", _chunks(F.col("n") - F.col("most"), limit).alias("parts"))
    grouped = grouped.join(main, "root")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.col("parts")).cast("int")
    everyone = grouped.select("id", "root", "known", chunk.alias("chunk"), _upto(F.col("parts")).alias("part"))
    outside = grouped.where("known <> main").select("id", "root", "known", _upto(F.col("chunks")).alias("chunk"), part.alias("part"))
    pairs = everyone.unionByName(outside).distinct()
    more = _compare(texts.join(pairs, "id").withColumn("task", F.xxhash64("root", "chunk", "part")), width)
    more = materialise(more, "near-links")
    out = components(found.unionByName(more))
    for table in (members, large, found, joined, grouped, more):
        discard(table)
    return out


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Of tagged docs, both written: (doc_id, row, digest, keys, fp) of each row, and (digest, root, first) of each different text, with first the row of a digest
    that has the smallest doc_id (nulls last, then the smallest row)."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("__row").alias("row"), F.encode(F.col(f"`{text}`").cast("string"), "utf-8").alias("text"))
    schema = T.StructType([
        slim.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.BinaryType()), T.StructField("fp", T.LongType()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .simhash import fingerprint

        for batch in batches:
            digests, keys, codes = [], [], []
            for t in batch.column(2):
                h = shingles(text := t.as_py() or b"")
                codes.append(fingerprint(text))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                keys.append(band_keys(h).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(keys, pa.binary()), pa.array(codes, pa.int64())], names=schema.names)

    prints = materialise(slim.mapInArrow(read, schema), "min-hashes")
    nodes = prints.groupBy("digest", "keys").agg(F.min("row").alias("id"), F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("first"))
    nodes = materialise(nodes, "min-hash-nodes")
    by_simhash = simhash_candidates(prints, nodes)
    joined = confirmed(slim.select(F.col("row").alias("id"), "text"), components(candidates(nodes).unionByName(by_simhash)), limit)
    discard(by_simhash)
    named = nodes.join(joined, nodes["id"] == joined["u"], "left").select("digest", F.coalesce("v", "id").alias("root"), "first")
    named = materialise(named, "near-names")
    for table in (nodes, joined):
        discard(table)
    return prints, named


def similar_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = GROUP_ROWS) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of the group; without any, a hash): groups of texts that links of near copies join."""
    slim = tagged(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    rows, named = groups(slim, limit=limit)
    smallest = named.groupBy("root").agg(F.coalesce(F.min("first.doc_id"), F.xxhash64("root")).alias("component_id"))
    return rows.select("doc_id", "digest").join(named.select("digest", "root"), "digest").join(smallest, "root").select("doc_id", "component_id")


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = GROUP_ROWS) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (nulls last, then the first row)."""
    rows = tagged(docs)
    prints, named = groups(rows, text, doc_id, limit)
    discard(prints)
    stay = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    stay = materialise(stay, "near-keepers")
    discard(named)
    release(docs.sparkSession)
    return rows.join(stay.hint("merge"), "__row", "left_semi").drop("__row")
