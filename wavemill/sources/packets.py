"""Binary packets: a 16-bit id, then big-endian 16-bit I and Q samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _int16(hex_text: Column, place: Column) -> Column:
    raw = F.conv(F.substring(hex_text, place, F.lit(4)), 16, 10).cast("int")
    return F.when(raw >= 32768, raw - 65536).otherwise(raw)


def decode(packets: DataFrame, payload: str, scale: float = 32767.0) -> DataFrame:
    """Other columns, ``packet_id`` and ``samples`` (array of ``struct<i, q>``, over ``scale``). A short tail is dropped; packets under two bytes are left out."""
    h = F.hex(payload)
    n = F.floor((F.length(h) - 4) / 8).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda k: F.struct((_int16(h, k * 8 + 5) / scale).alias("i"), (_int16(h, k * 8 + 9) / scale).alias("q"))
    return packets.where(F.length(payload) >= 2).withColumns({"packet_id": F.conv(F.substring(h, 1, 4), 16, 10).cast("int"), "samples": F.transform(at, one)}).drop(payload)


def encode(packet_id: Column, values: Column) -> Column:
    """The payload of whole numbers in an array."""
    word = lambda v: F.lpad(F.hex(F.pmod(v.cast("long"), F.lit(65536))), 4, "0")
    return F.unhex(F.concat(word(packet_id), F.array_join(F.transform(values, word), "")))


def words32(payload: Column) -> Column:
    """Big-endian unsigned 32-bit words; a short tail is dropped."""
    h = F.hex(payload)
    n = F.floor(F.length(h) / 8).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.conv(F.substring(h, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def encode32(values: Column) -> Column:
    """The payload of whole numbers in an array."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(F.pmod(v.cast("long"), F.lit(1 << 32))), 8, "0")), ""))
