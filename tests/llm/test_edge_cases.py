"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenspan.llm import decontamination, exact_dedup, language_id, license_scan, line_dedup, lm_scoring, packing, sharding, simhash, token_counts

SPACE = re.compile(r"[\x20\x09-\x0D]")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "The cat sat on the mat.\nshared line", "en"), (2, "the cat sat on the mat.\nshared line", "en"), (3, "The cat sat  on the mat.\nshared line", "en"),
    (4, None, "en"), (5, "", None), (6, " \n\t ", "de"), (7, LONG, "en"), (8, LONG, "fr"), (None, "no id here", "en"), (None, None, None),
    (9, "12345 678", None), (9, "12345 678", None), (10, "Été à la plage, ÉTÉ", "fr"), (11, "x", "en"), (12, "Released under the MIT Licence.\n\nother", "en"),
]
CLASH = ["fp", "digest", "row", "shard", "part", "key", "hash", "n", "length", "component_id", "lang_pred_", "q"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def texts(t):
    return [(d, x or "") for d, x, _ in ROWS] if t is None else t


def test_exact_dedup(docs, none):
    got = exact_dedup.duplicates(docs, counters=2).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for d, t in texts(None):
        groups[hashlib.sha256(SPACE.sub("", t).encode()).digest()].append((-len(t), d is None, d))
    for r in got:
        g = groups[bytes(r.digest)]
        assert (r.group_size, r.keep_id) == (len(g), min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2])
    assert Counter(bytes(r.digest) for r in got if r.kept) == Counter({k: 1 for k in groups})
    assert exact_dedup.duplicates(none).count() == exact_dedup.deduplicated(none).count() == 0
    assert exact_dedup.deduplicated(docs.where("doc_id < 4")).select("doc_id").first()[0] == 3
    kept = exact_dedup.deduplicated(docs, counters=2)
    assert kept.count() == len(groups) and kept.columns == docs.columns  # also of rows that share a doc_id


def test_misra_gries_keeps_what_is_frequent(spark):
    rows = [(bytes([i % 3 if i % 2 else 100 + i % 90]),) for i in range(600)]
    df = spark.createDataFrame(rows, "digest binary").repartition(7)
    got = {bytes(r.digest) for r in exact_dedup.heavy_candidates(df, 10).collect()}
    assert {bytes([k]) for k in range(3)} <= got and len(got) <= 10


def test_line_dedup(docs, none):
    got = line_dedup.drop_frequent_lines(docs, min_docs=2).collect()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    # rows that share a doc_id are one document; a row without one is its own
    count = Counter(k for _, k in {(d if d is not None else ("own", t), key(x)) for d, t in texts(None) for x in t.split("\n")} if k)
    want = Counter()
    for d, t in texts(None):
        lines = t.split("\n")
        kept = [x for x in lines if count[key(x)] < 2]
        want[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert Counter((r.doc_id, r.n_lines__ld, r.n_dropped__ld, r.text) for r in got) == want
    assert got[0].digest == 7 and line_dedup.drop_frequent_lines(none).count() == 0


def test_line_dedup_counts_documents(spark):
    """Rows of one doc_id are one document; rows without are their own; many dropped lines; identical rows."""
    many = "\n".join(f"common {i % 150}" for i in range(400))
    rows = [(1, "a\nx"), (1, "a\ny"), (2, "b\nX "), (None, "b\nz"), (None, "c\nz"), (3, many), (4, many + "\nown"), (5, "y\nc"), (5, "y\nc")]
    got = line_dedup.drop_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(3)), min_docs=2).collect()
    # a: one document; b, c, x, y, z and the common lines: two
    want = [(1, "a", 1), (1, "a", 1), (2, "", 2), (None, "", 2), (None, "", 2), (3, "", 400), (4, "own", 400), (5, "", 2), (5, "", 2)]
    assert Counter((r.doc_id, r.text, r.n_dropped__ld) for r in got) == Counter(want) and got[0].gone == 3


def shard_by_hand(spark, ids, shards, seed=sharding.SEED):
    """Rendezvous hashing of all ids, by the hash function alone."""
    pairs = [(i, s) for i in ids for s in range(shards)]
    frame = spark.createDataFrame(pairs, "doc_id long, s int").select("doc_id", "s", F.xxhash64(F.lit(seed), F.col("s"), F.col("doc_id")).alias("w"))
    best = {}
    for r in frame.collect():
        best[r.doc_id] = max(best.get(r.doc_id, (-(2**64), -1)), (r.w, r.s))
    return {i: s for i, (_, s) in best.items()}


@pytest.mark.parametrize("bucket_bytes", [64, 1 << 20])
def test_sharding(docs, none, tmp_path, bucket_bytes):
    how = {"shards": 3, "bucket_bytes": bucket_bytes}
    got = sharding.shuffled_shards(docs, F.lit(64), **how).collect()
    assert len(got) == len(ROWS) and Counter(r.text for r in got) == Counter(t for _, t, _ in ROWS) and got[0].digest == 7
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    three, four = (shard_by_hand(docs.sparkSession, {d for d, _, _ in ROWS}, n) for n in (3, 4))
    assert {(r.doc_id, r.shard, r.grown_shard) for r in got} == {(d, three[d], four[d]) for d, _, _ in ROWS}
    assert all(four[d] in (three[d], 3) for d in three)
    assert sharding.shuffled_shards(none, F.lit(64)).count() == 0
    sharding.write_shards(docs, str(tmp_path / "shards"), **how)
    assert docs.sparkSession.read.parquet(str(tmp_path / "shards")).count() == len(ROWS)


def test_sharding_query_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    now, grown = (shard_by_hand(spark, text, n) for n in (40, 41))
    got = sharding.op10_sharding(spark, sf).collect()
    want = {(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", now[d], grown[d]) for d, t in text.items()}
    assert {(r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got} == want and len(got) == len(text)


def test_sharding_query_moves_whole_records(spark, monkeypatch):
    """The query's digests are those of records that were written to the shards, all columns and texts of them."""
    sf, seen = "/root/testdata/sf0.001", []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda docs, path, *a, **how: (seen.append(path), write(docs, path, *a, **how)))
    got = sharding.op10_sharding(spark, sf).collect()
    written = spark.read.parquet(seen[0])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(seen) == 1 and Counter(written.select(docs.columns).collect()) == Counter(docs.collect())
    assert {(r.shard, r.slot, r.doc_id) for r in written.collect()} == {(r.shard, r.slot, r.doc_id) for r in got}


def test_one_doc_id_fills_many_buckets(spark):
    """A third of the rows share a doc_id, some of them wholly equal: no bucket holds more than a few of them."""
    rows = [(7, f"text {i}" if i % 2 else "same") for i in range(300)] + [(i, "x") for i in range(1000, 1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = sharding._dealt(df, F.lit(64), "doc_id", 3, 1, 64 * 20)
    assert max(r["count"] for r in dealt.groupBy("shard", "bucket", "part").count().collect()) <= 60
    got = sharding.shuffled_shards(df, F.lit(64), shards=3, seed=1, bucket_bytes=64 * 20).collect()
    assert len({(r.shard, r.slot) for r in got}) == len(rows) == len(got) and len({r.shard for r in got if r.doc_id == 7}) == 1


def test_sharding_is_the_same_again(docs):
    spark, seen = docs.sparkSession, []
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("2", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append({(r.doc_id, r.text): r.slot for r in sharding.shuffled_shards(docs.where("doc_id < 9").repartition(int(n)), F.lit(64), shards=2).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert seen[0] == seen[1]


def fingerprint_by_hand(text, n=3):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("limit", [200_000, 1])
def test_simhash(docs, none, limit):
    got = simhash.near_groups(docs, group_limit=limit).collect()
    assert len(got) == len(ROWS)
    print_of = {d: fingerprint_by_hand(t) for d, t in texts(None)}
    nodes = [(d, fingerprint_by_hand(t)) for d, t in texts(None)]
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter(nodes)
    name = {f: f for _, f in nodes}
    for _ in nodes:
        for a in name:
            for b in name:
                if bin(a ^ b).count("1") <= 3:
                    name[a] = min(name[a], name[b])
    for r in got:
        assert r.component_id == min((d for d, f in nodes if name[f] == name[r.fp % 2**64] and d is not None), default=None)
    assert print_of[4] == 0 and simhash.near_groups(none).count() == 0


def test_similar_groups(spark, docs, none):
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    edited = [*words[:100], "changed", *words[101:300], "again", *words[301:]]
    other = [f"z{i * 31 % 1000}" for i in range(400)]
    df = spark.createDataFrame([(5, " ".join(words)), (3, " ".join(edited)), (8, " ".join(other)), (9, " ".join(words))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == {5: 3, 3: 3, 9: 3, 8: 8}
    assert simhash.similar_groups(docs).count() == len(ROWS) and simhash.similar_groups(none).count() == 0


def test_language_id(docs, none, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 20)
    got = language_id.predict(docs).collect()
    assert len(got) == len(ROWS) and got[0].digest == 7
    for r in got:
        letters = bool(r.text and re.search(r"[^\W\d_]", r.text))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.lang_score <= 1
    assert language_id.predict(none).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_packing(docs, none):
    got = packing.pack(docs, capacity=64, with_ids=True).collect()
    encode = packing.encoder(packing.TOKENIZER)
    want = Counter((d, len(encode([t])[0]) // 4 + 1) for d, t in texts(None))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32 and r.start == 64 * r.piece
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in want.items())
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    whole = packing.sequences(packing.pack(docs, capacity=64, with_ids=True)).collect()
    assert len(whole) == len(by) and all(len(r.ids) <= 64 for r in whole)
    assert packing.pack(none).count() == 0


def test_token_counts(docs, none):
    h = token_counts.length_histogram(docs)
    encode = packing.encoder(packing.TOKENIZER)
    n = [len(encode([t])[0]) // 4 for _, t in texts(None)]
    got = {r.n_tokens: r for r in token_counts.token_counts(h).collect()}
    assert set(got) == set(n)
    for k, r in got.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_tokens, r.total_tokens) == (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n), sum(n))
        assert r.quantile == pytest.approx(sum(x <= k for x in n) / len(n))
    every = [*range(40), max(n) - 1, max(n), max(n) + 1, 10**6]
    cut = {r.context_limit: (r.total_tokens, r.truncated_tokens, r.cut_docs) for r in token_counts.truncated_totals(h, every).collect()}
    assert cut == {k: (sum(n), sum(min(x, k) for x in n), sum(x > k for x in n)) for k in every}
    shares = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    told = {r["share"]: r.n_tokens for r in token_counts.length_quantiles(h, shares).collect()}
    assert told == {q: min(x for x in n if sum(y <= x for y in n) >= q * len(n)) for q in shares}
    ranges = sorted((r.limits_from, r.n_tokens) for r in got.values())
    assert ranges[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert token_counts.token_counts(token_counts.length_histogram(none)).count() == 0 and token_counts.truncated_totals(h, []).count() == 0


def test_license_scan(docs, none):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect() if r.doc_id is not None}
    assert len(got) == 12 and got[12].notices == "MIT" and got[12].n_notices == 2 and got[12].license is None and got[4].license is None
    full = license_scan.LICENSES[5][1]
    told = docs.sparkSession.createDataFrame([(1, "Copyright (c) 2020 Me\n" + full.upper().replace('"', "“")), (2, full + " more")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in license_scan.license_scan(told).collect()} == {1: "MIT", 2: None}
    assert license_scan.license_scan(none).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_decontamination(spark, docs, none):
    w = ITEM.split()
    edited = " ".join(x if i % 6 else "new" + x for i, x in enumerate(w))
    phrase = "some words then " + " ".join(w[3:7]) + " and more of other things entirely"
    rows = [(1, f"lead in {ITEM.upper()} and out"), (2, f"lead {edited} out"), (3, phrase), (4, None), (5, ""), (1, f"again {ITEM}"), (None, ITEM), (6, LONG + " " + ITEM + " " + LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("grams", F.lit(1)).withColumn("start", F.lit(2))
    items = spark.createDataFrame([(70, ITEM), (71, None), (72, ""), (73, "unseen short")], "item_id long, text string")
    for block in (decontamination.BLOCK, 4):
        got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(df, items, block=block).collect()}
        assert set(got) == {(1, 70), (2, 70), (6, 70), (None, 70)}
    assert got[6, 70].similarity == 1 and got[6, 70].copied == ITEM and got[6, 70].word_start == 30_000
    assert sorted(r.doc_id for r in decontamination.decontaminated(df, items).collect()) == [3, 4, 5]
    assert decontamination.contaminated(docs, items.where("false")).count() == decontamination.contaminated(none, items).count() == 0


def alignment_by_hand(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_smith_waterman():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(1, 14)) for _ in range(2))
        score, lo, hi = decontamination.smith_waterman(a, b)
        assert score == alignment_by_hand(a.tolist(), b.tolist()) == (alignment_by_hand(a.tolist(), b[lo:hi].tolist()) if hi > lo else 0)


def test_lm_scoring(docs, none):
    import math

    got = lm_scoring.score(docs, group_chars=200, hot_share=50).collect()
    assert len(got) == len(ROWS)
    split = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)] + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    train = Counter(w for d, t in texts(None) if not held(d) for w in split(t))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for d, t in texts(None):
        w = split(t)
        want[d, held(d), len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got) and lm_scoring.score(none).count() == 0
