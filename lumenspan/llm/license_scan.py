"""License scans by canonical digest lookup.

A text is brought into a canonical form - A-Z lower-cased, copyright lines and lines "all rights reserved" dropped, punctuation and
white space one space, equivalent spellings made one - and its SHA-256 digest is hash-joined with the digests of known licences and
notices. Whole documents are looked up, and so are their lines and their blank-line-separated paragraphs, as notices stand within
other text. The catalogue is a parameter of fixed size, far below a megabyte, and is broadcast; documents aren't shuffled, only the
few units that matched.

Null text is empty; an empty canonical form matches nothing. Units that repeat count once for each place. Rows that share a doc_id, null or
not, have each the findings of its own text. An empty table gives an empty result. Further columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table
from .license_texts import DIGESTS, LICENSES, TITLES

#: Signs that become spaces, spellings that become one, and the patterns of the canonical form in the order of their
#: use; RE2, Java and Python read them alike. A copyright line begins with the word or sign and goes on with the other, a year or a
#: placeholder of one: lines of prose that happen to begin with "copyright", or with the third point of a list, stay.
SIGNS = "‘’“”–—"
PLAIN: list[tuple[str, str]] = [
    ("https ", "http "), ("acknowledgement", "acknowledgment"), ("authoris", "authoriz"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("offence", "offense"), ("organis", "organiz"), ("programme ", "program "), ("recognis", "recogniz"),
    ("sub licens", "sublicens"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
]
OWNED = r"(^|\n)[ \t*#/;.-]*(copyright[ \t]*((\(c\)|©)|[<{\[(]?(19|20)[0-9y][0-9y]|[<{\[]y(ear|yyy))|(\(c\)|©)[ \t]*(copyright|[<{\[]?(19|20)[0-9][0-9]))[^\n]*"
RESERVED = r"(^|\n)[ \t*#/;.-]*all rights reserved\.?[ \t]*(\n|$)"
RULES: list[tuple[str, str]] = [(rf"[{SIGNS}]", " "), (OWNED, "\n"), (RESERVED, "\n"), ("©", "(c)"), (r"[\x00-/:-@\[-`{-\x7F]+", " "), *PLAIN]


def canonical_text(text: str) -> str:
    """The canonical form of a catalogue entry, on the driver."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    for pattern, to in RULES:
        text = re.sub(pattern, to, text)
    return text.strip(" ")


def titled(entries: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Entries under each of their titles and without one."""
    out = []
    for name, text in entries:
        titles = TITLES.get(name, [])
        body = next((text[len(t) :].lstrip() for t in titles if text.startswith(t + "\n")), text)
        out += [(name, text)] + ([(name, body), *((name, f"{t}\n\n{body}") for t in titles)] if "\n" in text else [])
    return list(dict.fromkeys(out))


def canonical(text: Column) -> Column:
    """RULES as columns: one pass for what maps character by character, plain searches for what is no pattern, and patterns only where
    they can match."""
    text = F.translate(text, UPPER + SIGNS, LOWER + " " * len(SIGNS))
    owned = text.contains("copyright") | text.contains("(c)") | text.contains("©") | text.contains("all rights reserved")
    text = F.when(owned, F.regexp_replace(F.regexp_replace(text, *RULES[1]), *RULES[2])).otherwise(text)
    text = F.regexp_replace(F.replace(text, F.lit("©"), F.lit("(c)")), *RULES[4])
    for plain, to in PLAIN:
        text = F.replace(text, F.lit(plain), F.lit(to))
    return F.btrim(text, F.lit(" "))


def _words(entries: list[tuple[str, str]]) -> list[str]:
    """A word of each entry, untouched by the rules, that a match must have too."""
    changed = re.compile("|".join(re.escape(x.strip()) for _, x in PLAIN))
    words = {max((w for w in re.findall("[a-z]+", canonical_text(t)) if not changed.search(w)), key=len, default="") for _, t in entries}
    words |= {w for _, _, w in DIGESTS} if entries is LICENSES else set()
    return sorted(w for w in words if not any(o != w and o in w for o in words))


def may_match(text: Column, entries: list[tuple[str, str]]) -> Column:
    """False only for texts that can't be an entry: no entry's word is in them."""
    low = F.lower(text)
    return reduce(or_, [low.contains(w) for w in _words(entries)])


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def catalogue(entries: list[tuple[str, str]] = LICENSES) -> list[tuple[str, str]]:
    """(digest, licence), each digest once: of the entries under all their titles, and the known digests of long texts."""
    found = {d: name for name, d, _ in DIGESTS} if entries is LICENSES else {}
    found |= {hashlib.sha256(form.encode()).hexdigest(): name for name, text in titled(entries) if (form := canonical_text(text))}
    return sorted(found.items())


def license_units(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", entries: list[tuple[str, str]] = LICENSES) -> DataFrame:
    """doc_id, unit (text, paragraph or line), at, digest, license: each unit of a document that is a known licence or notice."""
    known = F.broadcast(docs.sparkSession.createDataFrame(catalogue(entries), "digest string, license string"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    unit = lambda name, parts: F.transform(parts, lambda x, i: F.struct(F.lit(name).alias("unit"), i.alias("at"), x.alias("part")))
    paragraphs, lines = F.split(whole, r"\n[ \t]*\n"), F.split(whole, "\n")
    # a text of one line or paragraph is looked up once
    units = F.concat(unit("text", F.array(whole)), F.when(F.size(paragraphs) > 1, unit("paragraph", paragraphs)).otherwise(unit("paragraph", F.array().cast("array<string>"))), F.when(F.size(lines) > 1, unit("line", lines)).otherwise(unit("line", F.array().cast("array<string>"))))
    likely = docs.where(may_match(whole, entries))
    each = likely.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(units).alias("u")).where(may_match(F.col("u.part"), entries)).select("doc_id", "u.unit", "u.at", digest(F.col("u.part")).alias("digest"))
    return each.join(known, "digest").select("doc_id", "unit", "at", "digest", "license")


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", entries: list[tuple[str, str]] = LICENSES) -> DataFrame:
    """One row for each row of docs: doc_id, text_digest, license (of the whole text, or null), notices (sorted licences of its
    lines and paragraphs, comma-separated), n_notices (lines and paragraphs that are one)."""
    known = F.broadcast(docs.sparkSession.createDataFrame(catalogue(entries), "text_digest string, license string"))
    # rows are told apart by doc_id and text together: equal ones find the same
    whole, own = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{doc_id}`")
    key = F.struct(F.xxhash64(F.lit(1), own, whole).alias("a"), F.xxhash64(F.lit(2), own, whole).alias("b"))
    inside = license_units(docs.select(key.alias("key"), whole.alias("whole")), "whole", "key", entries).where(F.col("unit") != "text")
    inside = inside.groupBy(F.col("doc_id").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count_distinct("unit", "at").alias("n_notices"))
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("key"), digest(whole).alias("text_digest"))
    out = slim.join(known, "text_digest", "left").join(inside, "key", "left")
    return out.select("doc_id", "text_digest", "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql_form(x: str) -> str:
    out = f"translate({x}, '{UPPER}', '{LOWER}')"
    for pattern, to in RULES:
        out = f"regexp_replace({out}, '{pattern}', {'chr(10)' if to == chr(10) else repr(to)}, 'g')"
    return f"sha256(trim({out}, ' '))"


OP6_SQL = f"""
WITH known(digest, license) AS (VALUES {", ".join(f"('{d}', '{n}')" for d, n in catalogue())}),
doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
part AS (
  SELECT doc_id, unnest(parts) AS part FROM (
    SELECT doc_id, string_split(text, chr(10)) AS parts FROM doc
    UNION ALL
    SELECT doc_id, string_split_regex(text, '\\n[ \\t]*\\n') AS parts FROM doc
  ) WHERE len(parts) > 1
), inside AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices
  FROM (SELECT doc_id, {_sql_form("part")} AS digest FROM part) JOIN known USING (digest) GROUP BY doc_id
), whole AS (SELECT doc_id, {_sql_form("text")} AS text_digest FROM doc)
SELECT doc_id, text_digest, license, coalesce(notices, '') AS notices, coalesce(n_notices, 0)::BIGINT AS n_notices
FROM whole LEFT JOIN known ON digest = text_digest LEFT JOIN inside USING (doc_id)
"""
