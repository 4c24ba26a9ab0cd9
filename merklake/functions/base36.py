"""Signed base-36 text of 64-bit integers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from merklake.constants import INT64_MAX_BASE36, INT64_MIN_BASE36


def encode(number: Column) -> Column:
    # A negative target base makes conv() treat the number as signed.
    return F.lower(F.conv(number.cast("string"), 10, -36))


def decode(text: Column) -> Column:
    """The number, or null when the text is not base 36 or does not fit 64 bits.

    conv() stops silently at a bad digit and fails the job on overflow, so only text
    already known to be good reaches it.
    """
    width = len(INT64_MAX_BASE36)
    negative = F.startswith(text, F.lit("-"))
    digits = F.ltrim(F.lower(text), F.lit("+-0"))
    padded = F.lpad(digits, width, "0")
    limit = F.when(negative, F.lit(INT64_MIN_BASE36)).otherwise(F.lit(INT64_MAX_BASE36))
    good = text.rlike(r"^[+-]?[0-9a-zA-Z]+$") & (F.length(digits) <= width) & (padded <= limit)
    sign = F.when(negative, F.lit("-")).otherwise(F.lit(""))
    return F.when(good, F.conv(F.concat(sign, padded), 36, -10).cast("bigint"))
