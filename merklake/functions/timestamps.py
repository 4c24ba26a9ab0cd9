"""Per-entry nanosecond timestamps kept as a string map beside each entry bundle.

Key: slot in base 36. Value: queue time and (integrate - queue), both base 36, one space between.
Nanoseconds stay BIGINT throughout; a Spark TIMESTAMP has microseconds only.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from merklake.functions import base36
from merklake.functions.binding import let

MISSING = "TIMESTAMP_MISSING"
BAD_FORMAT = "TIMESTAMP_BAD_FORMAT"
BAD_QUEUE = "TIMESTAMP_BAD_QUEUE"
BAD_OFFSET = "TIMESTAMP_BAD_OFFSET"


def pair(slot: Column, queue: Column, integrate: Column) -> Column:
    return F.struct(slot.alias("slot"), queue.alias("queue"), integrate.alias("integrate"))


def build(pairs: Column) -> Column:
    """MAP<STRING,STRING> from an array of `pair` structs."""
    return F.map_from_entries(
        F.transform(
            pairs,
            lambda p: F.struct(
                base36.encode(p["slot"]).alias("key"),
                F.concat_ws(
                    " ", base36.encode(p["queue"]), base36.encode(p["integrate"] - p["queue"])
                ).alias("value"),
            ),
        )
    )


def parse(metadata: Column, slot: Column) -> Column:
    """STRUCT<queue_ts_nanos, integrate_ts_nanos, error_code> of one slot."""
    return let(F.try_element_at(metadata, base36.encode(slot)), parse_value)


def parse_value(value: Column) -> Column:
    """As `parse`, from the value of a slot."""
    parts = let(
        F.split(value, " ", 2),
        lambda p: F.struct(
            (F.size(p) == 2).alias("spaced"),
            let(F.get(p, F.lit(0)), base36.decode).alias("queue"),
            let(F.get(p, F.lit(1)), base36.decode).alias("offset"),
        ),
    )

    def times(read: Column) -> Column:
        error = (
            F.when(value.isNull(), F.lit(MISSING))
            .when(~read["spaced"], F.lit(BAD_FORMAT))
            .when(read["queue"].isNull(), F.lit(BAD_QUEUE))
            .when(read["offset"].isNull(), F.lit(BAD_OFFSET))
        )
        both = F.when(read["offset"].isNotNull(), read["queue"])
        return F.struct(
            both.alias("queue_ts_nanos"),
            F.try_add(both, read["offset"]).alias("integrate_ts_nanos"),
            error.alias("error_code"),
        )

    return let(parts, times)


def byte_size(metadata: Column) -> Column:
    """Bytes of all keys and values, the quantity the object metadata limit is about."""
    return F.aggregate(
        F.map_entries(metadata),
        F.lit(0),
        lambda total, e: total + F.octet_length(e["key"]) + F.octet_length(e["value"]),
    )


def as_timestamp(nanos: Column) -> Column:
    """Microsecond view of a nanosecond time; `sub_micros` holds what it leaves out."""
    return F.timestamp_micros(F.call_function("div", nanos - sub_micros(nanos), F.lit(1000)))


def sub_micros(nanos: Column) -> Column:
    return F.pmod(nanos, F.lit(1000))


def from_timestamp(timestamp: Column, sub: Column) -> Column:
    return F.unix_micros(timestamp) * 1000 + sub
