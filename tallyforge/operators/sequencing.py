"""Sequencing of operations: gap-free transaction ids in the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.prefix import row_numbers


def sequence(ops: DataFrame, arrival: list[str], last: int = 0) -> DataFrame:
    """ops with tx_id from last + 1 on."""
    return row_numbers(ops, arrival, "tx_id", last + 1)


def sequence_batches(batches: DataFrame, arrival: list[str], last: int = 0) -> DataFrame:
    """Rows with an array ``ops`` become one row for each operation; a batch gets a contiguous block of ids."""
    return sequence(batches.select("*", F.posexplode("ops").alias("pos", "op_row")).drop("ops"), [*arrival, "pos"], last)
