"""Audit of how document filters interact, as a relational word pipeline.

Five filters judge every document: A few words, B few distinct words, C many capitals, D symbols, E a copy of an earlier document. Words are
exploded and aggregated by (row, word), then by row, for totals and distincts; what they say is joined with the other flags, and a
document is from then on a number from 0 to 31, one bit for each filter that it fails. Conditional counts of the 32 numbers, for each
part, answer every order of the filters: what a filter removes after others is a sum of some of the counts.

Texts are shuffled once, by row, after which both aggregations of words run in place. Rows are known by a hash of doc_id, part and text;
rows equal in all three share one, so totals are divided by their number, and a salt deals them out, whatever that number is. The smallest
doc_id of a text is looked for among texts that more than one row has; those that hold more than 2/HOT of all rows are fewer than HOT
and broadcast, the others are shuffled. doc_ids meet the labels when documents are already counts.

Null text is an empty text: no words, fails A, and E if a smaller doc_id has no text either. A null doc_id is larger than all others, and
rows that share a doc_id are no copies of each other, but each of an earlier one. Null part and empty part are one. A label that
is missing or null is neither good nor toxic; of labels that repeat a doc_id the largest counts. An empty table gives an empty
result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

FILTERS = "ABCDE"
MASKS = range(1 << len(FILTERS))
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
#: Equal rows are dealt over so many salts; texts with a larger share of the rows than 2 in so many are broadcast.
SALTS, HOT = 1024, 1024
#: All orders in which the filters can be applied.
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _key(doc_id: Column, part: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), doc_id, part, text).alias(f"k{i}") for i in (1, 2)]


KEY = ["k1", "k2"]


def word_counts(rows: DataFrame) -> DataFrame:
    """k1, k2, words, distinct_words from k1, k2, text: of all rows with the key together, and of one of them; no row without words."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")
    dealt = rows.select(*KEY, salt, "text").repartition(*KEY, "salt")
    words = dealt.select(*KEY, "salt", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    each = words.groupBy(*KEY, "salt", "word").agg(F.count(F.lit(1)).alias("n"))
    by_salt = each.groupBy(*KEY, "salt").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words"))
    return by_salt.groupBy(*KEY).agg(F.sum("words").alias("words"), F.max("distinct_words").alias("distinct_words"))


def first_holders(flags: DataFrame) -> DataFrame:
    """flags with first_id: the smallest doc_id of rows with the same text, where other rows have it."""
    groups = flags.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("copies").alias("rows")).where("rows > 1")
    groups = materialise(groups, "audit-groups")
    total = flags.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(groups.where(F.col("rows") > 2 * total / HOT).select("digest", "first_id"))  # fewer than HOT rows
    with_hot = flags.join(hot.withColumnRenamed("first_id", "hot_id").withColumn("is_hot", F.lit(True)), "digest", "left")
    rest = groups.where(F.col("rows") <= 2 * total / HOT).select("digest", "first_id")
    of_hot = with_hot.where("is_hot").withColumn("first_id", F.col("hot_id"))
    of_rest = with_hot.where("is_hot IS NULL").join(rest, "digest", "left")
    names = [*flags.columns, "first_id"]
    return of_hot.select(*names).unionByName(of_rest.select(*names))


def failures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """doc_id, part, mask, copies: rows that are equal in doc_id, part and text counted as one row with copies, and what filters they fail."""
    t, d = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{doc_id}`")
    p = F.coalesce(F.col(f"`{part}`").cast("string"), F.lit(""))
    rows = docs.select(*_key(d, p, t), d.alias("doc_id"), p.alias("part"), t.alias("text"))
    capitals = 100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.char_length("text")
    symbols = F.col("text").rlike("[#$%&*|]")
    flags = rows.select(*KEY, "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), capitals.alias("c"), symbols.alias("d"))
    flags = flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("copies"))
    flags = materialise(flags, "audit-flags")
    known = first_holders(flags).join(word_counts(rows), KEY, "left")
    words = F.coalesce(F.col("words") / F.col("copies"), F.lit(0.0))
    few = words < LEAST_WORDS
    alike = F.coalesce(100 * F.col("distinct_words") < LEAST_DISTINCT * words, F.lit(False))
    copy = F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id")))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate((few, alike, F.col("c"), F.col("d"), copy))), F.lit(0))
    return known.select("doc_id", "part", mask.alias("mask"), "copies")


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part: all, good and toxic, arrays of the numbers of documents with each mask."""
    each = failed.groupBy("doc_id", "part", "mask").agg(F.sum("copies").alias("copies"))
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    each = each.join(told, "doc_id", "left")
    of = lambda m, also: F.coalesce(F.sum(F.when((F.col("mask") == m) & also, F.col("copies"))), F.lit(0))
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = each.groupBy("part").agg(*[of(m, also).alias(f"{k}_{m}") for k, also in kinds.items() for m in MASKS])
    return counts.select("part", *[F.array(*[F.col(f"{k}_{m}") for m in MASKS]).alias(k) for k in kinds])


def _total(counts: str, holds) -> Column:
    """The sum of those counts whose mask holds."""
    return F.aggregate(F.transform(F.col(counts), lambda n, m: F.when(holds(m), n).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)


def audit(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order and step."""
    bits = lambda order: F.array(*[F.lit(1 << FILTERS.index(x)) for x in order])
    orders = F.array(*[F.struct(F.lit(o).alias("filter_order"), bits(o).alias("bits")) for o in ORDERS])
    steps = counts.select("*", F.inline(orders)).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    earlier = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b)
    steps = steps.withColumns({"own": F.element_at("bits", F.col("step")), "earlier": earlier})
    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("earlier")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # of n filters that a document fails, each is the first in one nth of the orders
    share = lambda n, m: F.when(fails(m), n * (F.lit(len(ORDERS)) / F.bit_count(m)).cast("long")).otherwise(F.lit(0))
    columns = {
        "kept": _total("all", lambda m: ~fails(m) & ~gone(m)), "removed": _total("all", removed), "redundant": _total("all", lambda m: fails(m) & gone(m)),
        "unique_fails": _total("all", lambda m: m == F.col("own")), "good_lost": _total("good", removed), "toxic_lost": _total("toxic", removed),
        "shapley": F.aggregate(F.transform("all", share), F.lit(0).cast("long"), lambda a, b: a + b),
    }
    return steps.select("part", "filter_order", "step", *[c.cast("long").alias(k) for k, c in columns.items()])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = failures(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return audit(mask_counts(failed, table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first_id OR (w.doc_id IS NULL AND first_id IS NOT NULL), false)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask
), bit AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM bit v, bit w, bit x, bit y, bit z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND len(list_distinct([v.b, w.b, x.b, y.b, z.b])) = 5
), s AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, range(1, 6) r(step)
), t AS (
  SELECT part, filter_order, step, n, good, toxic, mask = own AS only_own, mask & own <> 0 AS fails, mask & earlier <> 0 AS gone, bit_count(mask::INT) AS k FROM c, s
)
SELECT part, filter_order, step, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN only_own THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN fails THEN n * (120 // k) ELSE 0 END)::BIGINT AS shapley
FROM t GROUP BY part, filter_order, step
"""
