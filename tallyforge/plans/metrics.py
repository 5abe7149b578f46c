"""Metrics of a run from samples of node indexes and latency probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.quantiles import index_quantiles


def highest(samples: DataFrame) -> DataFrame:
    """(at_ms, high): the largest cluster_commit of each sampling."""
    return samples.groupBy("at_ms").agg(F.max("cluster_commit").alias("high"))


def throughput(samples: DataFrame) -> DataFrame:
    """Average, least and largest transactions a second between samplings of the active phase.

    The active phase runs from the last sampling at the lowest commit to the first at the highest. Samplings are one row
    each, however many nodes there are.
    """
    rows = highest(samples)
    ends = rows.agg(F.min("high").alias("lo"), F.max("high").alias("hi"))
    marked = rows.crossJoin(F.broadcast(ends))  # one row
    span = marked.agg(F.max(F.when(F.col("high") == F.col("lo"), F.col("at_ms"))).alias("begin"), F.min(F.when(F.col("high") == F.col("hi"), F.col("at_ms"))).alias("end"))
    active = rows.crossJoin(F.broadcast(span)).where("at_ms BETWEEN begin AND end")  # one row
    order = Window.orderBy("at_ms")
    rates = active.withColumns({"dt": F.col("at_ms") - F.lag("at_ms").over(order), "dn": F.col("high") - F.lag("high").over(order)}).where("dt > 0")
    return rates.agg((F.sum("dn") * 1000 / F.sum("dt")).alias("avg_tps"), F.min(F.col("dn") * 1000 / F.col("dt")).alias("min_tps"), F.max(F.col("dn") * 1000 / F.col("dt")).alias("max_tps"), F.count("*").alias("n_intervals"))


def latency_quantiles(probes: DataFrame) -> DataFrame:
    """Per level p50, p99, p999 and max of probes that had to wait."""
    return index_quantiles(probes.where("latency_ns > 0"), ["level"], "latency_ns", {"p50": 0.5, "p99": 0.99, "p999": 0.999})


def latency_per_second(probes: DataFrame, begin_ms: int, end_ms: int) -> DataFrame:
    """Per level and second within [begin, end) p50 and p99."""
    rows = probes.where((F.col("latency_ns") > 0) & (F.col("at_ms") >= begin_ms) & (F.col("at_ms") < end_ms)).withColumn("second", F.floor(F.col("at_ms") / 1000))
    return index_quantiles(rows, ["level", "second"], "latency_ns", {"p50": 0.5, "p99": 0.99}).drop("max")


def probe_counts(probes: DataFrame) -> DataFrame:
    """Per level the probes that waited, that were caught up already, and that timed out (null)."""
    return probes.groupBy("level").agg(F.count_if(F.col("latency_ns") > 0).alias("waited"), F.count_if(F.col("latency_ns") == 0).alias("caught_up"), F.count_if(F.col("latency_ns").isNull()).alias("timed_out"))


def node_lag(samples: DataFrame) -> DataFrame:
    """Per node the largest and the last distance of its commit to the largest cluster commit of the sampling."""
    rows = samples.join(highest(samples), "at_ms").withColumn("lag", F.greatest(F.lit(0), F.col("high") - F.col("commit")))
    return rows.groupBy("node_idx").agg(F.max("lag").alias("max_lag"), F.max_by("lag", "at_ms").alias("final_lag"))


def final_commit(samples: DataFrame) -> DataFrame:
    return highest(samples).agg(F.max_by("high", "at_ms").alias("final_commit"))


def quorum_commit(samples: DataFrame, n_nodes: int, term_first_tx: int | None = None) -> DataFrame:
    """(at_ms, quorum): the index that a majority has reached, never falling; below a leader's first transaction it waits.

    Samplings are one row each after grouping; the running maximum is taken over blocks of them and then over the blocks.
    """
    found = samples.groupBy("at_ms").agg(F.sort_array(F.collect_list("commit"), asc=False).alias("c"))  # one value for each node
    k = n_nodes // 2 + 1
    value = F.when(F.size("c") >= k, F.element_at("c", k)).otherwise(0)
    if term_first_tx is not None and n_nodes > 1:
        value = F.when(value >= term_first_tx, value).otherwise(0)
    rows = found.select("at_ms", value.alias("q"), F.floor(F.col("at_ms") / 1_000_000).alias("b"))
    blocks = rows.groupBy("b").agg(F.max("q").alias("q")).withColumn("before", F.coalesce(F.max("q").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("q")
    inner = Window.partitionBy("b").orderBy("at_ms").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(blocks, "b").select("at_ms", F.greatest(F.max("q").over(inner), "before").alias("quorum"))


def follower_commit(quorum: DataFrame, local_commit: int) -> DataFrame:
    return quorum.withColumn("quorum", F.least("quorum", F.lit(local_commit)))


def cluster_health(nodes: DataFrame) -> DataFrame:
    """(leader, alive, total) to health: healthy if there is a leader and a majority is alive."""
    well = (F.col("leader") != 0) & (F.col("alive") >= F.floor(F.col("total") / 2) + 1)
    return nodes.withColumn("health", F.when(well, "HEALTHY").otherwise("DEGRADED"))


def cluster_snapshot(samples: DataFrame) -> DataFrame:
    """The last sample of each node with its lag behind the highest commit, and the leader."""
    last = samples.groupBy("node_idx").agg(F.max_by(F.struct("at_ms", "compute", "commit", "snapshot", "cluster_commit", "is_leader"), "at_ms").alias("s")).select("node_idx", "s.*")
    every = Window.partitionBy()  # one row for each node
    return last.withColumns({"lag": F.greatest(F.lit(0), F.max("cluster_commit").over(every) - F.col("commit")), "leader": F.max(F.when(F.col("is_leader"), F.col("node_idx"))).over(every)})


def stage_backlog(samples: DataFrame) -> DataFrame:
    """Distances between the stages, per sample."""
    return samples.select("at_ms", "node_idx", (F.col("compute") - F.col("commit")).alias("compute_to_commit"), (F.col("commit") - F.col("snapshot")).alias("commit_to_snapshot"))


def stage_of(progress: DataFrame) -> DataFrame:
    """What a viewer is shown for (tx_id, compute, commit, snapshot, cluster_commit)."""
    t = F.col("tx_id")
    return progress.withColumn("stage", F.when(t <= F.col("snapshot"), "Snapshot").when(t <= F.col("cluster_commit"), "Committed").when(t <= F.col("compute"), "Computed").otherwise("Pending"))


def per_second(tx: DataFrame) -> DataFrame:
    """Transactions of each second and up to it."""
    rows = tx.groupBy(F.floor(F.col("ts_ns") / 1_000_000_000).alias("second")).agg(F.count("*").alias("tps"))
    return rows.withColumn("cumulative", F.sum("tps").over(Window.orderBy("second").rowsBetween(Window.unboundedPreceding, 0)))  # one row for each second


def matrix_grid(spark, n: int, initial: int, amount: int, rounds: int) -> DataFrame:
    """Expected balances of an n x n grid after rounds in which each cell pays amount to its right and lower neighbour."""
    cells = spark.range(n * n).select((F.floor(F.col("id") / n)).alias("r"), (F.col("id") % n).alias("c"))
    paid = (F.col("c") < n - 1).cast("int") + (F.col("r") < n - 1).cast("int")
    got = (F.col("c") > 0).cast("int") + (F.col("r") > 0).cast("int")
    return cells.select((F.col("r") * n + F.col("c") + 1).alias("account_id"), "r", "c", (F.lit(initial) + rounds * amount * (got - paid)).cast("long").alias("balance"))
