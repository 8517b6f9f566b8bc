"""Z-order keys: the bits of several scaled columns, interleaved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.errors import InvalidArgument

DEFAULT_BITS = 8


def scaled(c: Column, kind: T.DataType, low: object, high: object, bits: int) -> Column:
    """c, between low and high, as 0 to 2^bits - 1; null as 0. Text is scaled by its first 6 bytes."""

    def number(x: Column) -> Column:
        if isinstance(kind, T.StringType):
            return F.conv(F.rpad(F.hex(F.substr(x.cast("binary"), F.lit(1), F.lit(6))), 12, "0"), 16, 10).cast("double")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(x.cast("timestamp")).cast("double")
        return F.unix_date(x).cast("double") if isinstance(kind, T.DateType) else x.cast("double")

    least, most = number(F.lit(low).cast(kind)), number(F.lit(high).cast(kind))
    step = F.floor((number(c) - least) / F.nullif(most - least, F.lit(0.0)) * (2**bits))
    return F.coalesce(F.greatest(F.lit(0), F.least(step, F.lit(2**bits - 1))), F.lit(0)).cast("long")


def interleaved(columns: list[Column], bits: int = DEFAULT_BITS) -> Column:
    """One long from columns of ``bits`` bits, highest bits first, in turn."""
    if len(columns) * bits > 63:
        raise InvalidArgument(f"{len(columns)} columns of {bits} bits don't fit a z-order key of 63")
    key = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in columns:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1)))
    return key


def zorder_key(df: DataFrame, names: list[str], bits: int = DEFAULT_BITS) -> Column:
    """A key over df's columns, scaled between their least and greatest values (one aggregate over df)."""
    bounds = df.select(*[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("low", F.min), ("high", F.max))]).first()
    return interleaved([scaled(F.col(n), df.schema[n].dataType, bounds[f"low{i}"], bounds[f"high{i}"], bits) for i, n in enumerate(names)], bits)
