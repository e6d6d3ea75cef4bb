"""Encoding of whole texts with a public tokenizer, inside tasks.

The vocabulary file is a parameter. A tokenizer that drops white space and keeps letters and other signs apart, as the default one does,
encodes a text as the concatenation of its space-separated chunks, and a chunk of letters and punctuation as that of the two; so
chunks and words are encoded once and remembered, in memos of bounded size. Texts go to other tokenizers whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TOKENIZER = "word_bpe_49k.json"
#: Chunks and words that a Python worker remembers before it starts afresh, about 200 bytes for a chunk and half of it for a word.
MEMO = 800_000
#: Documents are encoded in groups of about so many characters.
GROUP_CHARS = 2_000_000


class ChunkEncoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    #: A chunk of letters of Latin-1, then of ASCII punctuation without the apostrophe, is a run of tokens for each of the two.
    LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
    SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
    WORD_END = "</w>"

    def __init__(self, name: str, memo: int = MEMO) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not os.path.isabs(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        how = json.loads(self.tokenizer.to_str())
        #: white space is dropped, letters and other signs are kept apart, and a word's last token is marked
        self.splits = how["model"].get("end_of_word_suffix") == self.WORD_END and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(how["pre_tokenizer"])
        if self.splits:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(self.WORD_END)]] = True
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}
        self.size = memo

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters alone, encoded as one text and parted at the marked tokens."""
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stop = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            data, start = ids.tobytes(), 0
            for w, end in zip(some, stop.tolist(), strict=True):
                self.words[w] = data[start:end]
                start = end

    def _learn(self, chunks: set[str]) -> None:
        if len(self.words) > self.size:
            self.words = {"": b""}
        known, plain, rest = self.words, [], []
        for c in chunks:
            word = c.rstrip(self.SIGNS)
            if word.isalpha() and (word.isascii() or self.LATIN.fullmatch(word)):
                low = word if word.islower() else word.lower()  # the same object as the chunk, mostly: both memos hold it
                plain.append((c, low, c[len(word) :]))
            else:
                rest.append(c)
        self._learn_words(list({w for _, w, _ in plain if w not in known}))
        rest += {t for _, _, t in plain if t not in known}
        known.update(zip(rest, self._whole(rest), strict=True))
        self.chunks.update((c, known[c]) for c in rest)
        self.chunks.update((c, known[w] + known[t] if t else known[w]) for c, w, t in plain)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.splits:
            return self._whole([t or "" for t in texts])
        # only these characters are cut at: every other white space is left to the tokenizer
        chunks = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.chunks) > self.size:
            self.chunks = {"": b""}
        self._learn(set().union(*chunks).difference(self.chunks))
        known = self.chunks.__getitem__
        return [b"".join(map(known, part)) for part in chunks]


@functools.lru_cache(maxsize=1)
def encoder(name: str) -> ChunkEncoder:
    """One for each Python worker and vocabulary."""
    return ChunkEncoder(name)


def groups(texts: pa.Array, limit: int = GROUP_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(position of the first, texts) in runs of about `limit` characters."""
    start, run, total = 0, [], 0
    for x in texts:
        t = x.as_py()
        run.append(t)
        total += len(t or "")
        if total >= limit:
            yield start, run
            start, run, total = start + len(run), [], 0
    if run:
        yield start, run
