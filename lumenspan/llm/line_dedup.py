"""Line deduplication with DataFrame functions only.

Lines are exploded as hashes of their normalised form. Hashes that fewer than `min_docs` rows hold are put aside first (map-side partial
sums keep very common lines small); the distinct documents of the others are counted from the rows that hold them. What is found
in `min_docs` documents or more is dropped from every document, and what stays is reassembled in the order of the lines. The text
itself crosses the network once, to meet its own list of dropped hashes, by a hash of doc_id and text.

Null or empty text is one empty line; empty keys are never dropped, and a document that loses all lines gets an empty text. Rows
that share a doc_id are one document in the counts and lose the same lines, each from its own text; a row without doc_id is a document
of its own, but rows equal to it count once. An empty table gives an empty result. Other columns pass through, whatever their names;
n_lines__ld and n_dropped__ld are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, materialise, table

MIN_DOCS = 10
MIN_CHARS = 1
ADDED = ("n_lines__ld", "n_dropped__ld")
#: Of more dropped hashes than this a document looks up a part only, one of so many.
PARTS = 64
#: What a task may hold of the lists of dropped hashes.
TABLE_BYTES = 64 << 20


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_hash(line: Column) -> Column:
    """128 bits of the key, so that different lines don't meet even among 10^12; null for keys that are never dropped."""
    key = line_key(line)
    return F.when(F.char_length(key) >= MIN_CHARS, F.unhex(F.md5(key)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """row (all columns), text, key (128 bits of doc_id and text: the fate of a row's lines depends on these), doc (what counts as one)."""
    t, d = F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("string")
    key = F.struct(F.xxhash64(d, t).alias("a"), F.xxhash64(F.lit(1), t, d).alias("b"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t.alias("text"), key.alias("key"), d.alias("id"))
    own = F.col("id").isNull()
    half = lambda c: F.when(own, F.col(f"key.{c}")).otherwise(F.lit(0)).alias(c)
    return out.withColumn("doc", F.struct("id", half("a"), half("b")))


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, hash: the distinct lines of rows that at least min_docs documents hold, for each row's key; written."""
    hashes = F.array_compact(F.array_distinct(F.transform(lines_of(F.col("text")), line_hash)))
    each = rows.select("key", "doc", F.explode(hashes).alias("hash"))
    often = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("hash")
    often = materialise(often, "often-held-lines")  # read anew, so that Spark may broadcast it or split a hot line's rows
    held = materialise(each.join(often, "hash", "left_semi").select("hash", "key", "doc"), "held-lines")
    frequent = held.groupBy("hash").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= min_docs).select("hash")
    return held.join(materialise(frequent, "frequent-lines"), "hash", "left_semi").select("key", "hash")


def _holds(gone: Column, parts: Column, h: Column) -> Column:
    """Whether a hash is among those gone; where these are many, among its part of them only."""
    return F.coalesce(F.when(parts.isNull(), F.array_contains(gone, h)).otherwise(F.array_contains(F.element_at(parts, _part(h)), h)), F.lit(False))


def _part(h: Column) -> Column:
    return (F.pmod(F.xxhash64(h), F.lit(PARTS)) + 1).cast("int")


def drop_frequent_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text replaced by its other lines, plus n_lines__ld (before) and n_dropped__ld."""
    rows = _rows(docs, text, doc_id)
    gone = frequent_lines(rows, min_docs).groupBy("key").agg(F.collect_set("hash").alias("gone"))
    gone = materialise(gone, "dropped-lines")
    held = gone.agg(F.sum(F.size("gone")), F.count(F.lit(1))).first()
    # a hash table of the lists only where they are known to fit a task, else both sides are sorted
    spark = docs.sparkSession
    if 16 * (held[0] or 0) + 200 * held[1] <= TABLE_BYTES * int(spark.conf.get("spark.sql.shuffle.partitions")):
        gone = gone.hint("shuffle_hash")
    out = rows.select("row", "text", "key").join(gone, "key", "left")
    many = F.transform(F.sequence(F.lit(1), F.lit(PARTS)), lambda i: F.filter("gone", lambda h: _part(h) == i))
    out = out.withColumns({"lines": lines_of(F.col("text")), "parts": F.when(F.size("gone") > PARTS, many)})
    # without a list of dropped hashes nothing is hashed again
    stay = F.filter("lines", lambda x: ~_holds(F.col("gone"), F.col("parts"), line_hash(x)))
    out = out.withColumn("stay", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stay))
    kept = [F.array_join("stay", "\n").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED]
    n = F.size("lines").cast("long")
    return out.select(*kept, n.alias("n_lines__ld"), (n - F.size("stay")).alias("n_dropped__ld"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines__ld").alias("n_lines"), F.col("n_dropped__ld").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH line AS (
  SELECT doc_id, pos, part AS line,
         translate(regexp_replace(part, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), frequent AS (
  SELECT key FROM line WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       (count(*) FILTER (WHERE f.key IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM line LEFT JOIN frequent f USING (key)
GROUP BY doc_id
"""
