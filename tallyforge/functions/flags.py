"""Account flags: eight byte lanes in one long; lane 0 is the status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge import schemas as S


def get_flag(flags: Column, lane: int) -> Column:
    return F.shiftrightunsigned(flags, 8 * lane).bitwiseAND(F.lit(255)).cast("int")


def set_flag(flags: Column, lane: int, value: Column | int) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    mask = 255 << 8 * lane
    clear = F.lit(~mask if lane < 7 else (1 << 56) - 1).cast("long")
    return flags.bitwiseAND(clear).bitwiseOR(F.shiftleft(value.cast("long").bitwiseAND(F.lit(255)), 8 * lane))


def has_flag(flags: Column, lane: int, value: Column | int) -> Column:
    return get_flag(flags, lane) == value


def status(flags: Column) -> Column:
    return get_flag(flags, 0)


def is_existent(flags: Column) -> Column:
    return status(flags) != S.NOT_EXISTENT


def is_success(fail_reason: Column) -> Column:
    return fail_reason == S.NONE


def is_failure(fail_reason: Column) -> Column:
    return fail_reason != S.NONE


def is_user_defined(fail_reason: Column) -> Column:
    return fail_reason.between(128, 255)
