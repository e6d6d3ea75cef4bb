"""The chunk encoder against the plain tokenizer, on the tables' texts and on hostile strings; op4 and op7 as whole queries."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenspan.llm import packing, token_counts, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))


def ids(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(spark, plain):
    rng = random.Random(6)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    alphabet = [*"abcXYZéÉßİıſ 09.,'’-_\t\n\r\x0b\x0c\x00\x1c\x85\xa0 ​́文字ﬁ😀½ⅷ", "don't", "l'été", "...", "</w>", "A.B", "co-op", "ﬀ"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(4000)] + [None, "", "x" * 5000]
    encode = tokens.ChunkEncoder(tokens.TOKENIZER, memo=500)  # the memo starts afresh many times
    for at in range(0, len(texts), 300):
        some = texts[at : at + 300]
        for t, got in zip(some, encode(some), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids(plain, t), repr(t)[:200]


def test_packing_query_holds_every_token(spark, plain):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces, places = defaultdict(dict), defaultdict(list)
    for r in packing.op4_best_fit_packing(spark, SF).collect():
        pieces[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(text)
    for d, t in text.items():
        whole, at = [*ids(plain, t), 0], 0
        for k in range(len(pieces[d])):
            r = pieces[d][k]
            some = whole[at : at + r.length]
            assert r.start == at and len(some) == r.length and r.ids_crc32 == zlib.crc32(np.array(some, "<u4").tobytes())
            assert r.length == 2048 or k == len(pieces[d]) - 1
            at += r.length
        assert at == len(whole)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(length for parts in places.values() for _, length in parts)
    assert len(places) <= 1.02 * -(-total // 2048) + 1


def test_token_counts_query(spark, plain):
    n = Counter(len(ids(plain, r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    docs, total = sum(n.values()), sum(k * c for k, c in n.items())
    for r in token_counts.op7_token_counts(spark, SF).collect():
        assert n[r.n_tokens] == r.n_docs and (r.total_docs, r.total_tokens) == (docs, total)
        assert r.docs_at_least == sum(c for k, c in n.items() if k >= r.n_tokens) and r.tokens_at_least == sum(k * c for k, c in n.items() if k >= r.n_tokens)
        assert r.truncated_tokens == sum(min(k, r.n_tokens) * c for k, c in n.items())
