"""Index, packing, seating and network against brute force, and accuracy on held-out rows."""

import itertools

import numpy as np
import pytest

from lumenspan.llm import language_id, packing, registry
from lumenspan.llm.blocks import pack, unpack
from lumenspan.llm.graph import components
from lumenspan.llm.gray_index import Forest, GrayIndex, gray_rank

SF = "/root/testdata/sf0.001"


def test_gray_rank():
    codes = np.arange(64, dtype=np.uint64)
    assert np.array_equal(gray_rank(codes ^ codes >> np.uint64(1)), codes)


@pytest.mark.parametrize("trial", range(12))
def test_index_finds_every_link(trial):
    rng = np.random.default_rng(trial)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    codes = base[rng.integers(0, 12, 300)]
    for i in range(len(codes)):
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            codes[i] ^= np.uint64(1) << np.uint64(b)
    codes = np.unique(codes)
    keys = rng.integers(0, 1 + trial % 3, len(codes))
    want = Forest(len(codes))
    i, j = np.nonzero((np.bitwise_count(codes[:, None] ^ codes) <= 3) & (keys[:, None] == keys))
    want.join(i, j)
    same = lambda x: [list(x).index(y) for y in x]
    index = GrayIndex(keys, codes)
    near = lambda i, j: np.bitwise_count(codes[i] ^ codes[j]) <= 3
    assert same(index.linked(3)) == same(index.linked(5, near)) == same(want.roots(np.arange(len(codes))))


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    reach = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            reach[a] = reach[b] = min(reach[a], reach[b])
    got = {r.u: r.v for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert {x: got.get(x, x) for x in reach} == reach


def test_plan_fills_sequences():
    rng = np.random.default_rng(2)
    for capacity in (8, 64, 2048):
        counts = {int(x): int(rng.integers(1, 400)) for x in rng.integers(1, capacity + 1, 60)}
        rows = packing.plan(counts, capacity)
        used, fill, ranks = {}, {}, {}
        for length, lo, hi, first, offset in rows:
            used[length] = used.get(length, 0) + hi - lo
            ranks.setdefault(length, []).append((lo, hi))
            for s in range(first, first + hi - lo):
                fill.setdefault(s, []).append((offset, length))
        assert used == counts
        for spans in ranks.values():
            assert all(a[1] == b[0] for a, b in itertools.pairwise(sorted(spans)))
        for parts in fill.values():
            assert sum(x for _, x in parts) <= capacity and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(sorted(parts)))
    many = packing.plan(dict.fromkeys(range(1, 65), 50), 64)
    assert len({f + i for _, lo, hi, f, _ in many for i in range(hi - lo)}) == -(-50 * sum(range(1, 65)) // 64)


def test_blocks_round_trip():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.float32), np.array([1.5, -2.5])]
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))


def test_network_gradients():
    rng = np.random.default_rng(1)
    net = language_id.BiGru(3, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = language_id.padded([b"abc", b"hello", b"x"]), np.array([0, 2, 1])
    _, g = net.gradients(x, y)
    for k, p in net.p.items():
        flat, i = p.ravel(), int(np.abs(g[k]).argmax())
        keep, e = flat[i], 1e-4
        flat[i] = keep + e
        up, _ = net.gradients(x, y)
        flat[i] = keep - e
        down, _ = net.gradients(x, y)
        flat[i] = keep
        assert g[k].ravel()[i] == pytest.approx((up - down) / 2 / e, rel=1e-3)


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in registry.QUERIES["op2_language_id"](spark, sf).collect() if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in got]) > 0.98


def test_model_beats_its_base_on_held_out_text(spark):
    got = [r for r in registry.QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) * 0.97


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_oracle(spark, name):
    import oracle

    oracle.check(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
