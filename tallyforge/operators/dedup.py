"""Idempotency by user_ref with count-based windows.

Only checks with a non-zero user_ref count. The first opens a window; a check at W or more transaction ids after the
window's start begins the next one. A reference is a duplicate while the transaction that recorded it lies in the same
window or the one before; failed transactions record theirs as well, duplicates do not. W = 0: references never expire.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge.scratch import drop_persisted, persist


def window_starts(checks: DataFrame, w: int) -> DataFrame:
    """(start) of every window over checks (tx_id).

    Each check points to the first check at w ids after it or later; the starts are what the first check leads to.
    Paths are doubled, so rounds grow with the logarithm of the windows.
    """
    block = lambda c: F.floor(c / w)
    points = checks.select(block(F.col("tx_id")).alias("b"), F.col("tx_id").alias("at"), F.col("tx_id"), F.lit(None).cast("long").alias("asked"))
    points = points.unionByName(checks.select(block(F.col("tx_id") + w).alias("b"), (F.col("tx_id") + w).alias("at"), F.lit(None).cast("long").alias("tx_id"), F.col("tx_id").alias("asked")))
    within = Window.partitionBy("b").orderBy("at").rangeBetween(0, Window.unboundedFollowing)  # 2 w ids at most
    blocks = checks.groupBy(block(F.col("tx_id")).alias("b")).agg(F.min("tx_id").alias("lowest"))
    asked_blocks = points.select("b").distinct().join(blocks, "b", "left")
    later = asked_blocks.withColumn("later", F.min("lowest").over(Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing))).select("b", "later")  # one row for each window's width
    jump = points.withColumn("same", F.min("tx_id").over(within)).where("asked IS NOT NULL").join(later, "b").select(F.col("asked").alias("a"), F.coalesce("same", "later").alias("z")).where("z IS NOT NULL")
    jump = persist(jump, "dedup-jump")
    reached = persist(checks.agg(F.min("tx_id").alias("start")).where("start IS NOT NULL"), "dedup-starts")
    while True:
        more = persist(reached.unionByName(reached.join(jump, reached["start"] == jump["a"]).select(F.col("z").alias("start"))).distinct(), "dedup-starts")
        if more.count() == reached.count():
            return more
        twice = persist(jump.select("a", F.col("z").alias("mid")).join(jump.select(F.col("a").alias("mid"), "z"), "mid").select("a", "z"), "dedup-jump")
        drop_persisted(jump)
        drop_persisted(reached)
        jump, reached = twice, more


def generations(checks: DataFrame, w: int) -> DataFrame:
    """checks (tx_id, ...) with the number of their window."""
    if not w:
        return checks.withColumn("generation", F.lit(0).cast("long"))
    first, last, n = checks.agg(F.min("tx_id"), F.max("tx_id"), F.count("*")).first()
    if n and n == last - first + 1:  # every id is a check: windows are even
        return checks.withColumn("generation", F.floor((F.col("tx_id") - first) / w).cast("long"))
    order = Window.orderBy("start")  # one row for each window
    spans = window_starts(checks.select("tx_id"), w).select("start", F.row_number().over(order).cast("long").alias("generation"), F.coalesce(F.lead("start").over(order), F.lit((last or 0) + 1)).alias("next"))
    spans = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / w), F.floor((F.col("next") - 1) / w))))
    keyed = checks.withColumn("b", F.floor(F.col("tx_id") / w))
    return keyed.join(spans, (keyed["b"] == spans["b"]) & (keyed["tx_id"] >= spans["start"]) & (keyed["tx_id"] < spans["next"])).drop("b", "start", "next")


def checks_of(ops: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(tx_id, user_ref, judged, repeated) of the operations with a reference and of prior transactions (tx_id, user_ref, fail_reason)."""
    new = ops.where("user_ref <> 0").select("tx_id", "user_ref", F.lit(False).alias("judged"), F.lit(False).alias("repeated"))
    if prior is None:
        return new
    old = prior.where("user_ref <> 0").select("tx_id", "user_ref", F.lit(True).alias("judged"), (F.col("fail_reason") == S.DUPLICATE).alias("repeated"))
    return new.unionByName(old)


def last_windows(checks: DataFrame, w: int) -> list[int]:
    """Starts of the last two windows, ascending; what began before them expires with the next one."""
    if not w:
        return []
    starts = generations(checks.select("tx_id"), w).groupBy("generation").agg(F.min("tx_id").alias("start"))
    return sorted(r["start"] for r in starts.orderBy(F.desc("start")).limit(2).collect())


def duplicates(ops: DataFrame, w: int, prior: DataFrame | None = None) -> DataFrame:
    """(tx_id, to_tx_id) of the operations (tx_id, user_ref) that repeat a recorded reference.

    prior holds the transactions with references from the start of the last window but one on, as they were judged.
    """
    checks = generations(checks_of(ops, prior), w)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, seen, held = None, 0, 0  # the reference at hand, the transaction and the window that recorded it last
        for batch in batches:
            own, original = [], []
            for r, t, g, judged, repeated in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if judged:
                    if not repeated:
                        ref, seen, held = r, t, g
                elif r == ref and (not w or g - held <= 1):
                    own.append(t)
                    original.append(seen)
                else:
                    ref, seen, held = r, t, g
            yield pa.RecordBatch.from_pydict({"tx_id": pa.array(own, pa.int64()), "to_tx_id": pa.array(original, pa.int64())})

    ordered = checks.select("user_ref", "tx_id", "generation", "judged", "repeated").repartition("user_ref").sortWithinPartitions("user_ref", "tx_id")
    return ordered.mapInArrow(scan, "tx_id long, to_tx_id long")


def recorded(ops: DataFrame, links: DataFrame) -> DataFrame:
    """user_ref to the last transaction that recorded it."""
    return ops.where("user_ref <> 0").join(links.select("tx_id"), "tx_id", "left_anti").groupBy("user_ref").agg(F.max("tx_id").alias("tx_id"))
