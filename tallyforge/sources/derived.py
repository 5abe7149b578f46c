"""Tables that the star schema lacks, made from ``events`` by fixed expressions (k is the number in props)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.sources.profiles import cents, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def number():
    return F.col("event_id")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term for each 1000 events, from its first on."""
    return table(spark, sf_dir, "events").groupBy((F.floor(number() / 1000) + 1).alias("term")).agg((F.min("event_id") + 1).alias("start_tx_id"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of every term whose number 3 does not divide, and of the one after."""
    own = table(spark, sf_dir, "events").select((F.floor(number() / 1000) + 1).alias("term"))
    return own.unionByName(own.select((F.col("term") + 1).alias("term"))).where("term % 3 <> 0").distinct().select("term", (F.col("term") % 3).alias("voted_for"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nodes sampled every 100 ms."""
    at = F.floor(number() / 3)
    commit = F.greatest(F.lit(0), 50 * at - F.col("k"))
    rows = events(spark, sf_dir).select((at * 100).alias("at_ms"), (number() % 3).cast("int").alias("node_idx"), (50 * at + 10).alias("compute"), commit.alias("commit"), F.greatest(F.lit(0), commit - F.floor(F.col("k") / 2)).alias("snapshot"), F.greatest(F.lit(0), commit - 7).alias("cluster_commit"), (number() % 3 == 0).alias("is_leader"))
    return rows


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    latency = F.when(F.col("k") % 17 == 0, F.lit(None)).when(F.col("k") % 10 == 0, F.lit(0)).otherwise(F.round(F.col("value") * 1000)).cast("long")
    return events(spark, sf_dir).select((number() * 10).alias("at_ms"), (F.col("user_id") % 4).cast("int").alias("level"), latency.alias("latency_ns"))


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("k") % 2 == 0
    value = F.struct(F.when(even, "Int").otherwise("Const").alias("kind"), F.when(even, F.col("k")).otherwise(F.col("k") % 7).alias("i"), F.lit(None).cast("string").alias("s"))
    return events(spark, sf_dir).select((number() + 1).alias("tx_id"), F.lit(0).alias("seq"), F.concat_ws("/", F.lit("tariffs"), F.col("user_id") % 20, "event_type").alias("key_str"), value.alias("value"), ((F.col("event_type") == "error") & (F.col("k") % 3 == 0)).alias("is_delete"))


def constants(spark: SparkSession) -> DataFrame:
    return spark.range(6).select("id", F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"))


def flag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'signup'").select((number() + 1).alias("tx_id"), F.lit(0).alias("seq"), (F.col("user_id") + 1).alias("account_id"), F.lit(1).cast("long").alias("prev_flags"), (1 + 256 * (F.col("k") + 1)).alias("new_flags"))


def link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'view'").select((number() + 1).alias("tx_id"), F.lit(1).alias("seq"), (F.col("user_id") + 1).alias("parent_id"), (F.col("k") % 4).cast("int").alias("type_id"), (100_000 + number()).alias("child_id"))


def open_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'signup'").select((number() + 1).alias("tx_id"), (F.col("k") % 5).alias("count"), F.lit(0).cast("long").alias("user_ref"))


def bucket_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deposit to each linked account."""
    return events(spark, sf_dir).where("event_type = 'view'").select((number() + 1).alias("tx_id"), F.lit(2).alias("seq"), F.lit("DEBIT").alias("kind"), (100_000 + number()).alias("account_id"), cents(F.col("value")).alias("amount"), cents(F.col("value")).alias("computed_balance"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of watermarks over the events."""
    n = F.max("event_id") + 1
    return table(spark, sf_dir, "events").agg(n.alias("sequence"), (n - 100).alias("compute"), (n - 300).alias("commit"), (n - 600).alias("snapshot"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to look up: every event and one beyond the end."""
    ids = table(spark, sf_dir, "events").select((number() + 1).alias("tx_id"))
    return ids.unionByName(ids.agg((F.max("tx_id") + 1_000_000).alias("tx_id")))


def fn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event registers a program by one of 50 names, some of them bad, or unregisters it (a checksum of 0)."""
    name = F.when(F.col("user_id") % 13 == 0, F.concat(F.lit("9f"), F.col("user_id") % 50)).otherwise(F.concat(F.lit("f_"), F.col("user_id") % 50))
    return events(spark, sf_dir).select((number() + 1).alias("tx_id"), name.alias("name"), F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("k") + 1).alias("crc32c"))


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment_id, pos, tx_id, valid): a log with ids out of order and with broken groups."""
    k = F.col("k")
    valid = ~((k % 29 == 0) & (F.col("user_id") % 3 == 0)) & (number() % 4000 < 3990)
    return events(spark, sf_dir).select((F.floor(number() / 1000) + 1).alias("segment_id"), number().alias("pos"), (number() + 1 - F.when(k % 50 == 0, 2).otherwise(0)).alias("tx_id"), valid.alias("valid"))


def named_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants (id, name): the kinds of events, numbered in the order of their first appearance."""
    first = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.min(number()).alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at")).cast("long").alias("id"), "name")  # one row for each kind
