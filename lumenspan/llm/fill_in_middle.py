"""Fill-in-middle transformation of training texts.

A text is a sequence of units: a word with the white space before it, or white space that no word follows. A document's hash says
between which units it is cut. Units are never stored: a first pass of a streaming matcher counts them, a second advances a lazy
iterator of matches to both cuts. That is the one step in Python, an Arrow-batched function that is given a text and two numbers
and returns three; forms, cuts and outputs are columns, and so is the way back from an output to its text.

Null text counts as empty, and an empty text is left plain, as is one that holds a sentinel. A null doc_id is hashed as an empty one.
Rows that repeat a doc_id or a whole row are transformed each on its own, alike. An empty table gives an empty result. Other
columns pass through, whatever their names; those in ADDED are replaced.
"""

from __future__ import annotations

import re
from collections import deque
from itertools import count, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SEED = 42
#: Of 100 documents so many are transformed, and of 100 of these so many have the suffix first.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
ADDED = ("n__fim", "form__fim", "prefix_chars__fim", "middle_chars__fim", "output__fim")
#: The classes share no character, so a match never has to give back what it took.
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")


def count_units(text: str) -> int:
    """First pass: how often the matcher finds a unit; no match is kept."""
    n = count()
    deque(zip(UNIT.finditer(text), n, strict=False), maxlen=0)
    return next(n)


def ends(text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: the offsets after `first` and after `second` units, first <= second."""
    matches, out, seen, at = UNIT.finditer(text), [], 0, 0
    for rank in (first, second):
        if rank > seen:
            at = next(islice(matches, rank - seen - 1, None)).end()
            seen = rank
        out.append(at)
    return out[0], out[1]


CUT = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")])


@F.pandas_udf(CUT)
def _cut(text: pd.Series, h1: pd.Series, h2: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    rows = []
    for t, a, b, cut in zip(text, h1, h2, wanted, strict=True):
        n = count_units(t)
        lo, hi = ends(t, *sorted((int(a) % (n + 1), int(b) % (n + 1)))) if cut else (0, 0)
        rows.append((n, lo, hi - lo))
    return pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars"], dtype="int64")


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from a document's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs with n__fim (units), form__fim (plain, psm or spm), prefix_chars__fim and middle_chars__fim (code points, null if plain), output__fim."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(f"`{doc_id}`"), seed)
    plain = (t == "") | (h3 % 100 >= rate) | t.rlike(SENTINEL)
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    # one struct, so that the columns of docs can have any names
    rows = docs.select(F.struct(*kept).alias("row"), t.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    rows = rows.withColumn("cut", _cut("text", "h1", "h2", F.col("form") != "plain"))
    a, m = F.col("cut.prefix_chars"), F.col("cut.middle_chars")
    from_ = lambda at, n: F.substring(F.col("text"), (at + 1).cast("int"), n.cast("int"))
    prefix, middle = from_(F.lit(0), a), from_(a, m)
    suffix = from_(a + m, F.char_length("text").cast("long"))
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm).otherwise(psm)
    cut = F.col("form") != "plain"
    values = [F.col("cut.n"), F.col("form"), F.when(cut, a), F.when(cut, m), output]
    return rows.select("row.*", *[v.alias(c) for v, c in zip(values, ADDED, strict=True)])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No sentinel's end is another's beginning, so the first of each kind is the one put in."""
    part = F.split(output, SENTINEL, 4)  # nothing, what each sentinel heads
    prefix, suffix = F.when(form == "spm", part[2]).otherwise(part[1]), F.when(form == "spm", part[1]).otherwise(part[2])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output__fim"), F.col("form__fim"))
    names = [F.col(c).alias(c.removesuffix("__fim")) for c in ADDED[:4]]
    return out.select("doc_id", *names, F.sha2("output__fim", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS unit
  FROM documents
), r AS (
  SELECT doc_id, text, unit, len(unit) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(unit) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(unit) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(unit[1:least(a, b)], '') AS prefix, array_to_string(unit[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(unit[greatest(a, b) + 1:], '') AS suffix
  FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
