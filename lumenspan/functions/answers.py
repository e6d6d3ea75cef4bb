"""Entity mentions in answers, with offsets in UTF-16 units of the original text.

Names, aliases and domains are found as whole words of the folded text (no case, no accents), and names of five letters or more also one
edit away. Version v3 settles spans across all entities, v2 within each. Which span wins depends on those settled before it, so this
is one Arrow batch function over answers; everything after it is columns again.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order and confidence of the kinds of match, and the sizes that extraction goes by.
KINDS = {"EXACT": (0, 1.0), "ALIAS": (1, 0.9), "DOMAIN": (2, 0.8), "APPROXIMATE": (3, 0.4)}
RADIUS, MIN_SENTENCE, MIN_FUZZY = 100, 10, 5
#: Tokens without a near name that a task remembers. Those with one are few: a name has some thousand neighbours.
FAR_MEMO = 200_000
#: Compiled needles that a task remembers.
FORMS = 1 << 15
WORD = r"[\p{L}\p{N}]+"
VERSIONS = ("v2", "v3")
MENTION = "entity_id string, kind string, mention_type string, occurrence_index int, char_offset int, sentence_index int, normalized_position double, in_first_sentence boolean, order_rank int, occurrences_total int, context string, confidence double, char_end int"
ASCII_WORD = re.compile("[a-z0-9]+")
GAP = re.compile(r"\s+")
SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    who: int

    def meets(self, other: Span) -> bool:
        return self.start < other.end and other.start < self.end


class Apart:
    """Spans by start, to be asked whether one meets any of them. What is added later overlaps none that is there."""

    def __init__(self, spans: Iterable[Span] = ()) -> None:
        ordered = sorted((s.start, s.end) for s in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(itertools.accumulate((b for _, b in ordered), max))  # the furthest of it and all before

    def meet(self, s: Span) -> bool:
        at = bisect_left(self.starts, s.end)
        return at > 0 and self.ends[at - 1] > s.start

    def add(self, s: Span) -> None:
        at = bisect_left(self.starts, s.start)
        self.starts.insert(at, s.start)
        self.ends.insert(at, s.end)


class _Plain(dict):
    """Characters to what they are without accents and case; filled as they are met."""

    def __missing__(self, code: int) -> str:
        self[code] = plain = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.category(x).startswith("M")).lower()
        return plain


_PLAIN = _Plain()


def fold(text: str) -> tuple[str, Sequence[int]]:
    """The folded text, and for each of its characters the character of the text that it comes from."""
    if text.isascii():
        return text.lower(), range(len(text) + 1)
    if all(len(_PLAIN[ord(c)]) == 1 for c in set(text)):
        return text.translate(_PLAIN), range(len(text) + 1)
    parts = [_PLAIN[ord(c)] for c in text]
    origin = [i for i, p in enumerate(parts) for _ in p]
    return "".join(parts), [*origin, len(text)]


def one_edit(a: str, b: str) -> bool:
    """Equal but for one letter put in, left out or changed."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


@functools.lru_cache(maxsize=FORMS)
def bare_host(domain: str) -> str:
    domain = re.sub(r"^[a-z][a-z0-9+.-]*://", "", domain.strip().lower())
    return re.sub(r"[/?#].*$", "", re.sub(r"^www\.", "", domain), flags=re.S).rstrip(".")


@functools.lru_cache(maxsize=FORMS)
def form(needle: str):  # a compiled pattern
    """The needle as whole words of a folded text."""
    import regex

    return regex.compile(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(needle)}(?![\p{{L}}\p{{N}}])")


@functools.lru_cache(maxsize=1)
def word_form():
    import regex

    return regex.compile(WORD)


@functools.lru_cache(maxsize=FORMS)
def needle_of(text: str) -> str:
    return fold(text.strip())[0]


@functools.lru_cache(maxsize=FORMS)
def one_word(needle: str) -> bool:
    return word_form().fullmatch(needle) is not None


class Matcher:
    """The needles of a catalogue of entities. near: for tokens that are known to be one edit away from names the places of these in the
    catalogue; all others are far from all names. If it isn't given, tokens are compared with the names as they are met."""

    def __init__(self, entities: list[dict], near: dict[str, tuple[int, ...]] | None = None) -> None:
        self.entities, self.word = entities, word_form()
        # needles of one word are looked up by the text's tokens, all others are searched for
        self.spelled: dict[str, list[tuple[str, int]]] = {}
        self.needles, self.fuzzy = [], []
        # tokens met so far: whose names are one edit away, or nobody's
        self.near: dict[str, tuple[int, ...]] = near or {}
        self.far: set[str] = set()
        for who, e in enumerate(entities):
            asked = [("EXACT", e["name"]), *(("ALIAS", a) for a in e["aliases"] or []), ("DOMAIN", bare_host(e["domain"] or ""))]
            for kind, text in asked:
                if needle := needle_of(text):
                    if one_word(needle):
                        self.spelled.setdefault(needle, []).append((kind, who))
                    else:
                        self.needles.append((kind, who, needle))
            if near is None and len(name := needle_of(e["name"])) >= MIN_FUZZY:
                self.fuzzy.append((who, name))

    def _meet(self, tokens: set[str]) -> None:
        if len(self.far) > FAR_MEMO:
            self.far.clear()
        for token in tokens - self.far:
            if token not in self.near:
                if who := tuple(who for who, name in self.fuzzy if one_edit(token, name)):
                    self.near[token] = who
                else:
                    self.far.add(token)

    def spans(self, text: str) -> list[Span]:
        folded, origin = fold(text)
        found = [Span(kind, origin[m.start()], origin[m.end()], who) for kind, who, needle in self.needles if needle in folded for m in form(needle).finditer(folded)]
        if self.spelled or self.fuzzy or self.near:
            word = ASCII_WORD if folded.isascii() else self.word
            tokens = set(word.findall(folded))
            if self.fuzzy:
                self._meet(tokens)
            spelled, near = self.spelled, self.near
            if not (spelled.keys().isdisjoint(tokens) and near.keys().isdisjoint(tokens)):  # most texts have no such token
                for m in word.finditer(folded):
                    token = m[0]
                    if token in spelled or token in near:
                        start, end = origin[m.start()], origin[m.end()]
                        found += [Span(kind, start, end, who) for kind, who in spelled.get(token, ())]
                        found += [Span("APPROXIMATE", start, end, who) for who in near.get(token, ())]
        return found

    def settled(self, found: list[Span], version: str) -> list[Span]:
        if version == "v3":
            spelled = Apart((s for s in found if s.kind != "APPROXIMATE"))
            found = [s for s in found if s.kind != "APPROXIMATE" or not spelled.meet(s)]
            found.sort(key=lambda s: (KINDS[s.kind][0], s.start - s.end, str(self.entities[s.who]["id"]), s.start))
        else:
            found.sort(key=lambda s: (s.who, KINDS[s.kind][0], s.start))
        kept: list[Span] = []
        held: dict[int, Apart] = {}
        for s in found:
            others = held.setdefault(0 if version == "v3" else s.who, Apart())
            if not others.meet(s):
                kept.append(s)
                others.add(s)
        return kept

    def mentions(self, text: str | None, version: str) -> list[tuple]:
        """Rows in the order of MENTION's fields."""
        text = text or ""
        kept = sorted(self.settled(self.spans(text), version), key=lambda s: (s.start, s.who))
        if not kept:
            return []
        by: dict[int, list[Span]] = {}
        for s in kept:
            by.setdefault(s.who, []).append(s)
        rank = {who: r for r, who in enumerate(by)}
        starts, at = sentence_starts(text), offsets(text)
        total, rows = at[len(text)], []
        for who, spans in by.items():
            e = self.entities[who]
            for k, s in enumerate(spans):
                sentence = bisect_right(starts, s.start) - 1
                rows.append((
                    e["id"], e["kind"], s.kind, k, at[s.start], sentence, at[s.start] / total if total else 0.0, sentence == 0,
                    rank[who], len(spans), context(text, s.start, s.end, at), KINDS[s.kind][1], at[s.end],
                ))
        return sorted(rows, key=lambda r: (r[4], r[8], str(r[0])))


def offsets(text: str) -> Sequence[int]:
    """For each character, and the end, how many UTF-16 units come before it."""
    if text.isascii() or max(text) <= "\uffff":
        return range(len(text) + 1)
    return [0, *itertools.accumulate(2 if c > "\uffff" else 1 for c in text)]


def sentence_starts(text: str) -> list[int]:
    starts = [0]
    for m in SENTENCE.finditer(text):
        if m.end() >= len(text):
            break
        # a sentence of so many characters has as many units, and short ones are counted
        if m.start() - starts[-1] >= MIN_SENTENCE or units(text[starts[-1] : m.start()]) >= MIN_SENTENCE:
            starts.append(m.end())
    return starts


def context(text: str, start: int, end: int, at: Sequence[int] | None = None) -> str:
    """The text around a span, RADIUS UTF-16 units on both sides; a character that would be cut in half is left out."""
    at = offsets(text) if at is None else at
    lo, hi = bisect_left(at, at[start] - RADIUS), bisect_right(at, at[end] + RADIUS) - 1
    return ("…" if lo else "") + GAP.sub(" ", text[lo:hi]).strip() + ("…" if hi < len(text) else "")


MENTIONS = f"array<struct<{', '.join(':'.join(c.split(' ')) for c in MENTION.split(', '))}>>"


def as_arrow(rows: list[list[tuple]]) -> pa.Array:
    """Lists of rows in the order of MENTION's fields."""
    kind = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    names, kinds = zip(*[(n, kind[k]) for n, k in (c.split(" ") for c in MENTION.split(", "))], strict=True)
    flat = list(zip(*itertools.chain.from_iterable(rows), strict=True)) or [()] * len(names)
    fields = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds, strict=True)], names=list(names))
    return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32()), fields)


def extracted(answers: DataFrame, entities: list[dict], text: str = "text", version: str = "v3") -> DataFrame:
    """answers with mentions array<struct<...>>; entities: id, kind, name, aliases, domain - a few, and part of the task."""
    known(version)

    @F.arrow_udf(MENTIONS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(entities)
        for batch in batches:
            yield as_arrow([matcher.mentions(x.as_py(), version) for x in batch])

    return answers.withColumn("mentions", find(F.col(text)))


def found_among(text: Column, candidates: Column, version: str = "v3") -> Column:
    """Mentions of an answer's own candidates: array<struct<id, kind, name, aliases, domain, near>>, near the tokens one edit away from the name."""
    known(version)

    @F.arrow_udf(MENTIONS)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, asked in batches:
            rows = []
            for t, entities in zip(texts, asked, strict=True):
                entities, near = entities.as_py() or [], {}
                for who, e in enumerate(entities):
                    for token in e["near"] or []:
                        near[token] = (*near.get(token, ()), who)
                rows.append(Matcher(entities, near).mentions(t.as_py(), version) if entities else [])
            yield as_arrow(rows)

    return find(text, candidates)


def known(version: str) -> None:
    if version not in VERSIONS:
        raise ValueError(f"unknown extraction version {version}")


@F.arrow_udf(T.StringType())
def _folded(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else fold(x)[0] for x in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def needle_column(text: pa.Array) -> pa.Array:
    """What a name or an alias is searched as."""
    return pa.array([None if x is None else needle_of(x) for x in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def host_needle_column(domain: pa.Array) -> pa.Array:
    return pa.array([None if x is None else needle_of(bare_host(x)) for x in domain.to_pylist()], pa.string())


def folded_column(text: Column) -> Column:
    """Text without case and accents; only texts beyond ASCII leave the JVM."""
    beyond = F.octet_length(text) != F.char_length(text)
    return F.coalesce(_folded(F.when(beyond, text)), F.lower(text))
