"""Who may call how often: keys, capacities and the order in which buckets are charged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.plans.buckets import token_bucket_of
from lumenspan.queries import query
from lumenspan.sources.tables import read

#: Calls an hour by kind, and what a sign-in may take from its address and its account within a window of seconds.
PER_HOUR = {"runs": 20, "rescores": 5, "register": 5}
REGISTER_ALL = 30
LOGIN = {"address": 8, "account": 10, "window": 300, "readable": 120}


def email_key(email: Column) -> Column:
    """Ordinary addresses stay readable; longer ones are keyed by their digest."""
    plain = F.char_length(email) <= LOGIN["readable"]
    return F.when(plain, F.concat(F.lit("login:email:"), email)).otherwise(F.concat(F.lit("login:email:sha256:"), F.sha2(email, 256)))


def admitted_logins(calls: DataFrame) -> DataFrame:
    """calls: call_id, ts, email, address (null if unknown). call_id, admitted. The address is charged first; what it refuses doesn't
    touch the account's bucket."""
    window = LOGIN["window"]
    known = calls.where("address IS NOT NULL").select(F.concat(F.lit("login:addr:"), "address").alias("bucket"), "call_id", "ts")
    by_address = token_bucket_of(known, LOGIN["address"], LOGIN["address"] / window).select("call_id", F.col("admitted").alias("let_in"))
    asked = calls.join(by_address, "call_id", "left").where("address IS NULL OR let_in")
    accounts = asked.select(email_key(F.col("email")).alias("bucket"), "call_id", "ts")
    by_account = token_bucket_of(accounts, LOGIN["account"], LOGIN["account"] / window).select("call_id", "admitted")
    return calls.select("call_id").join(by_account, "call_id", "left").select("call_id", F.coalesce("admitted", F.lit(False)).alias("admitted"))


def admitted_calls(calls: DataFrame) -> DataFrame:
    """calls: call_id, ts, kind (of PER_HOUR), who. call_id, bucket, admitted: a bucket for each kind and caller; other kinds have none, and
    are refused."""
    keyed = calls.withColumn("bucket", F.concat_ws(":", "kind", F.col("who").cast("string")))
    out = None
    for kind, n in PER_HOUR.items():
        some = token_bucket_of(keyed.where(F.col("kind") == kind).select("bucket", "call_id", "ts"), n, n / 3600)
        out = some if out is None else out.unionByName(some)
    return keyed.select("call_id", "bucket").join(out.select("call_id", "admitted"), "call_id", "left").select("call_id", "bucket", F.coalesce("admitted", F.lit(False)).alias("admitted"))


def admitted_registrations(calls: DataFrame) -> DataFrame:
    """calls: call_id, ts, address (null if unknown). call_id, admitted, refused_by. All registrations share one bucket, which is charged first,
    so that made-up addresses don't get round it; what it lets in is charged to its address."""
    shared = token_bucket_of(calls.select(F.lit("register:global").alias("bucket"), "call_id", "ts"), REGISTER_ALL, REGISTER_ALL / 3600)
    asked = calls.join(shared.select("call_id", F.col("admitted").alias("let_in")), "call_id")
    own = asked.where("let_in AND address IS NOT NULL").select(F.concat(F.lit("register:"), "address").alias("bucket"), "call_id", "ts")
    by_address = token_bucket_of(own, PER_HOUR["register"], PER_HOUR["register"] / 3600).select("call_id", "admitted")
    refused = F.when(~F.col("let_in"), "global").when(~F.coalesce("admitted", F.lit(True)), "address")
    return asked.join(by_address, "call_id", "left").select("call_id", refused.isNull().alias("admitted"), refused.alias("refused_by"))


@query("registration_admission")
def registration_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a registration, a hundred times faster, from four addresses; held against a loop in the tests."""
    e, t = read(spark, sf_dir, "events"), F.unix_micros(F.col("ts").cast("timestamp"))
    address = F.when(F.col("user_id") % 9 != 0, F.concat(F.lit("10.1.0."), (F.col("user_id") % 4).cast("string")))
    return admitted_registrations(e.select(F.col("event_id").alias("call_id"), F.timestamp_micros(F.floor(t / 100)).alias("ts"), address.alias("address")))


@query("admitted_calls")
def admitted_calls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of three kinds, one of them unknown, by user."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("runs", "rescores", "other")]), (F.col("event_id") % 3 + 1).cast("int"))
    return admitted_calls(read(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), "ts", kind.alias("kind"), F.col("user_id").alias("who")))


@query("login_admission")
def login_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ins from a few addresses, ten thousand times faster than the events they are made from; held against a loop in the tests."""
    e, t = read(spark, sf_dir, "events"), F.unix_micros(F.col("ts").cast("timestamp"))
    email = F.when(F.col("user_id") % 7 == 0, F.concat(F.repeat(F.lit("x"), 130), F.col("user_id").cast("string"))).otherwise(F.concat((F.col("user_id") % 20).cast("string"), F.lit("@example.com")))
    address = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("10.0.0."), (F.col("user_id") % 3).cast("string")))
    calls = e.select(F.col("event_id").alias("call_id"), F.timestamp_micros(F.floor(t / 10_000)).alias("ts"), email.alias("email"), address.alias("address"))
    return admitted_logins(calls)


@query("token_usage", "SELECT event_type, count(*) AS calls, count(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS told, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS tokens_out FROM events GROUP BY event_type")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that the engines say they have used; what isn't a finite number isn't counted."""
    from lumenspan.sources.payloads import usage

    n = usage(F.col("props"), "$.k")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.count(n).alias("told"), F.sum(n).alias("tokens_out"))
