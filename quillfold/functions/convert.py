"""Source text to ledger integers. A null or odd text gives null and a reason of its own column, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfold.schema import STATES


def minor_units(text: Column) -> Column:
    """Decimal text with at most two decimals to minor units; empty is 0; anything else is null."""
    good = text.rlike(r"^-?[0-9]{1,16}(\.[0-9]{0,2})?$")
    value = F.expr("cast(null as decimal(20,2))")
    value = F.when(good, text.try_cast("decimal(20,2)")).otherwise(value)
    return F.when(text.isNull() | (text == ""), F.lit(0).cast("long")).otherwise((value * 100).try_cast("long"))


def cents(amount: Column) -> Column:
    """A double that holds whole cents, as a long."""
    return F.round(amount * 100).cast("long")


def epoch_ns(text: Column) -> Column:
    """Civil UTC time text (date, space, time) to nanoseconds; empty is 0; shorter or odd text is null."""
    good = text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}")
    stamp = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(text.isNull() | (text == ""), F.lit(0).cast("long")).when(good, F.unix_micros(stamp) * 1000)


def timestamp_ns(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp")) * 1000


def state_of(status: Column, states: dict[str, str]) -> Column:
    """A status by a declared map onto state names; others are open."""
    out = F.lit(STATES["open"])
    for text, name in states.items():
        out = F.when(status == text, F.lit(STATES[name])).otherwise(out)
    return out.cast("short")


def signed64(unsigned: Column) -> Column:
    """A decimal(20,0) of 64 unsigned bits as the long with the same bits."""
    half = F.lit(1 << 63).cast("decimal(20,0)")
    return F.when(unsigned >= half, unsigned - F.lit(1 << 64).cast("decimal(20,0)")).otherwise(unsigned).cast("long")
