"""Tags, key paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<kind:string,i:long,s:string>"


def encode_tag(tag: Column) -> Column:
    """Eight bytes: UTF-8, cut to eight, padded with NUL."""
    raw = F.substring(tag.cast("binary"), 1, 8)
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), 8 - F.octet_length(raw))))


def decode_tag(raw: Column) -> Column:
    """The text without trailing NULs, or 16 lower-case hex digits where the bytes are no UTF-8."""
    text = F.try_validate_utf8(F.regexp_replace(raw.cast("string"), "\\x00+$", ""))
    return F.coalesce(text, F.lower(F.hex(raw)))


def function_tag(crc32c: Column) -> Column:
    """Tag of a program's transaction: a fixed head and the four bytes of its checksum."""
    return F.concat(F.lit(b"fnw\n"), F.unhex(F.lpad(F.hex(crc32c), 8, "0")))


def parse_key(path: Column) -> Column:
    """A key path as components: a number is an Int, anything else a constant's name; null if one is empty."""
    parts = F.transform(F.split(path, "/"), lambda p: F.struct(
        F.when(p.try_cast("long").isNotNull() & p.rlike(r"^[+-]?[0-9]+$"), F.lit("Int")).otherwise(F.lit("Const")).alias("kind"),
        F.when(p.rlike(r"^[+-]?[0-9]+$"), p.try_cast("long")).alias("i"),
        F.when(p.try_cast("long").isNull() | ~p.rlike(r"^[+-]?[0-9]+$"), p).alias("s"),
    ))
    return F.when(F.exists(F.split(path, "/"), lambda p: p == ""), F.lit(None)).otherwise(parts)


def format_key(key: Column) -> Column:
    return F.array_join(F.transform(key, lambda v: F.coalesce(v["i"].cast("string"), v["s"])), "/")


def is_function_name(name: Column) -> Column:
    return name.rlike("^[A-Za-z][A-Za-z0-9_]{0,31}$")
