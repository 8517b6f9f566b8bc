"""Column statistics of files and tables, exact and sketched, and the JSON form of their values."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOUNDED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def encode(value: Any) -> Any:
    """A bound as JSON: plain where JSON has the type, else tagged."""
    if isinstance(value, datetime):
        return {"ts": value.replace(tzinfo=None).isoformat()}
    if isinstance(value, date):
        return {"d": value.isoformat()}
    if isinstance(value, Decimal):
        return {"n": str(value)}
    if isinstance(value, float) and not math.isfinite(value):
        return {"f": repr(value)}
    return value


def decode(value: Any) -> Any:
    if not isinstance(value, dict):
        return value
    (tag, text), = value.items()
    return {"ts": datetime.fromisoformat, "d": date.fromisoformat, "n": Decimal, "f": float}[tag](text)


def _floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def aggregates(schema: T.StructType, prefix: str = "", distinct: bool = False) -> list[Column]:
    """nulls, NaNs, bounds without NaN (which Spark takes as greatest), and approximate distinct values of each column."""
    out = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        out.append(F.sum(c.isNull().cast("long")).alias(f"{prefix}{f.name}|nulls"))
        out.append((F.sum(F.isnan(c).cast("long")) if _floating(f.dataType) else F.lit(0).cast("long")).alias(f"{prefix}{f.name}|nans"))
        if isinstance(f.dataType, _BOUNDED):
            seen = F.when(~F.isnan(c), c) if _floating(f.dataType) else c
            out += [F.min(seen).alias(f"{prefix}{f.name}|min"), F.max(seen).alias(f"{prefix}{f.name}|max")]
            if distinct:
                out.append(F.approx_count_distinct(c).alias(f"{prefix}{f.name}|distinct"))
    return out


def as_stats(row: Any, schema: T.StructType) -> dict[str, dict]:
    """The aggregates of one row by column, as they are kept with a file."""
    held = row.asDict()
    return {f.name: {k: encode(held[f"{f.name}|{k}"]) for k in ("nulls", "nans", "min", "max", "distinct") if f"{f.name}|{k}" in held} for f in schema}


def file_stats(scan: DataFrame, distinct: bool = False) -> DataFrame:
    """One row per file under a scan: path, size, rows and the columns' aggregates."""
    where = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size")]
    return scan.groupBy(*where).agg(F.count("*").alias("record_count"), *aggregates(scan.schema, distinct=distinct))


def merged(stats: list[dict[str, dict] | None]) -> dict[str, dict]:
    """Statistics of a table from those of its files: sums of counts, least and greatest bounds. Distinct counts don't add up and are left out."""
    out: dict[str, dict] = {}
    for name in dict.fromkeys(n for s in stats if s for n in s):
        own = [s[name] for s in stats if s and name in s]
        lows, highs = ([decode(s[k]) for s in own if s.get(k) is not None] for k in ("min", "max"))
        out[name] = {"nulls": sum(s.get("nulls") or 0 for s in own), "nans": sum(s.get("nans") or 0 for s in own), "min": encode(min(lows)) if lows else None, "max": encode(max(highs)) if highs else None}
    return out


def sketch(df: DataFrame, *names: str) -> DataFrame:
    """A row of mergeable HLL sketches, one a column."""
    return df.agg(*[F.hll_sketch_agg(n).alias(n) for n in names])


def distinct_estimate(sketches: DataFrame, *names: str) -> DataFrame:
    """Distinct values over the union of sketches."""
    return sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in names])


def average(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.avg(name).alias("average"))


def equi_width(df: DataFrame, name: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): bin 1 to bins between low and high, 0 below, bins + 1 from high on; nulls are left out."""
    return df.where(F.col(name).isNotNull()).groupBy(F.width_bucket(F.col(name).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def equi_height(df: DataFrame, name: str, bins: int, accuracy: int = 10_000) -> DataFrame:
    """(bin, high): approximate upper bounds of bins of equal size."""
    cuts = [i / bins for i in range(1, bins + 1)]
    return df.agg(F.percentile_approx(name, cuts, accuracy).alias("cuts")).select(F.posexplode("cuts").alias("bin", "high"))


def singleton(df: DataFrame, name: str) -> DataFrame:
    """(value, n) for each value."""
    return df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))


def scalar_diff(a: Any, b: Any) -> float:
    """a - b as a number, for numbers, dates and timestamps: how far along a range a value lies."""
    gap = a - b
    return gap.total_seconds() if isinstance(gap, timedelta) else float(gap)
