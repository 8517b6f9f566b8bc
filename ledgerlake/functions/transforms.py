"""Partition transforms as Column expressions, and partition specs made of them.

Partitions are hidden: the values are metadata of a file and never part of its path or schema.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.errors import InvalidArgument

_EPOCH = date(1970, 1, 1)
#: Transforms that keep the order of values, so that ranges can be pruned.
MONOTONIC = ("identity", "year", "month", "day", "hour", "truncate")
_MASK32 = 0xFFFFFFFF


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is named: nested hashing would else grow without bound."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32, in halves so that 64-bit products don't overflow."""
    low, high = F.lit(factor & 0xFFFF), F.lit(factor >> 16)
    return _let(x, lambda v: _low(F.shiftleft((F.shiftrightunsigned(v, 16) * low + v.bitwiseAND(F.lit(0xFFFF)) * high).bitwiseAND(F.lit(0xFFFF)), 16) + v.bitwiseAND(F.lit(0xFFFF)) * low))


def _turned(x: Column, n: int) -> Column:
    return _let(x, lambda v: _low(F.shiftleft(v, n)).bitwiseOR(F.shiftrightunsigned(v, 32 - n)))


def _folded(x: Column, n: int) -> Column:
    return _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n)))


def _scrambled(word: Column) -> Column:
    return _times(_turned(_times(word, 0xCC9E2D51), 15), 0x1B873593)


def _mixed(h: Column, word: Column) -> Column:
    return _low(_turned(h.bitwiseXOR(_scrambled(word)), 13) * 5 + F.lit(0xE6546B64))


def _final(h: Column, length: Column) -> Column:
    return _folded(_times(_folded(_times(_folded(h.bitwiseXOR(length), 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)


def murmur3_long(value: Column) -> Column:
    """32-bit Murmur3 with seed 0 of a long's 8 little-endian bytes, as a non-negative long."""
    x = value.cast("long")
    h = _mixed(_mixed(F.lit(0).cast("long"), _low(x)), _low(F.shiftrightunsigned(x, 32)))
    return _final(h, F.lit(8).cast("long"))


def murmur3_bytes(value: Column) -> Column:
    """The same of a binary column, over its bytes in an aggregate expression."""
    hexed, size = F.hex(value), F.length(value).cast("long")

    def byte(i: Column) -> Column:
        return F.conv(F.substr(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long")

    def word(start: Column, n: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(n):
            out = out.bitwiseOR(F.shiftleft(byte(start + k), 8 * k))
        return out

    whole = F.when(size >= 4, F.sequence(F.lit(0), (size / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(whole, F.lit(0).cast("long"), lambda acc, i: _mixed(acc, word(4 * i, 4)))
    start = (size - size % 4).cast("int")
    tail = F.when(size % 4 == 1, word(start, 1)).when(size % 4 == 2, word(start, 2)).when(size % 4 == 3, word(start, 3))
    h = F.when(size % 4 == 0, h).otherwise(h.bitwiseXOR(_scrambled(tail)))
    return _final(h, size)


def _micros(c: Column, kind: T.DataType) -> Column:
    return F.unix_micros(c.cast("timestamp")) if isinstance(kind, T.TimestampNTZType) else F.unix_micros(c)


@dataclass(frozen=True)
class PartitionField:
    """transform: identity, year, month, day, hour, bucket, truncate or void; width: buckets, or characters or units of truncate."""

    field_id: int
    source: str
    transform: str
    width: int | None = None

    @property
    def name(self) -> str:
        return {"identity": self.source, "bucket": f"{self.source}_bucket", "truncate": f"{self.source}_trunc"}.get(self.transform, f"{self.source}_{self.transform}")

    @property
    def monotonic(self) -> bool:
        return self.transform in MONOTONIC

    def check(self, kind: T.DataType) -> None:
        """Refuses a transform on a type that it has no meaning for."""
        times, whole = (T.TimestampType, T.TimestampNTZType), (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        fits = {
            "identity": True, "void": True, "year": isinstance(kind, (T.DateType, *times)), "month": isinstance(kind, (T.DateType, *times)), "day": isinstance(kind, (T.DateType, *times)), "hour": isinstance(kind, times),
            "bucket": isinstance(kind, (*whole, T.DateType, *times, T.StringType, T.BinaryType)), "truncate": isinstance(kind, (*whole, T.StringType)),
        }
        if self.transform not in fits:
            raise InvalidArgument(f"unknown transform '{self.transform}'")
        if not fits[self.transform]:
            raise InvalidArgument(f"transform {self.transform} does not apply to {kind.simpleString()} column '{self.source}'")
        if self.transform in ("bucket", "truncate") and (self.width or 0) <= 0:
            raise InvalidArgument(f"transform {self.transform} needs a positive width")

    def column(self, kind: T.DataType) -> Column:
        self.check(kind)
        c = F.col(self.source)
        if self.transform == "identity":
            return c
        if self.transform == "year":
            return F.year(c)
        if self.transform == "month":
            return F.year(c) * 12 + F.month(c) - 1
        if self.transform == "day":
            return F.unix_date(F.to_date(c))
        if self.transform == "hour":
            return F.floor(_micros(c, kind) / F.lit(3_600_000_000)).cast("long")
        if self.transform == "void":
            return F.lit(None).cast("string")
        if self.transform == "truncate":
            return F.substring(c, 1, self.width) if isinstance(kind, T.StringType) else (c.cast("long") - c.cast("long") % self.width).cast(kind)
        if isinstance(kind, (T.StringType, T.BinaryType)):
            h = murmur3_bytes(c.cast("binary"))
        elif isinstance(kind, T.DateType):
            h = murmur3_long(F.unix_date(c))
        else:
            h = murmur3_long(_micros(c, kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c)
        return F.when(c.isNotNull(), h.bitwiseAND(F.lit(0x7FFFFFFF)) % self.width).cast("int")

    def value(self, v: Any) -> Any:
        """The same of one Python value, for pruning."""
        if v is None or self.transform == "void":
            return None
        if self.transform == "identity":
            return v
        if self.transform == "truncate":
            return v[: self.width] if isinstance(v, str) else int(abs(v) // self.width * self.width * (1 if v >= 0 else -1))
        if self.transform == "bucket":
            return (_murmur3(_bytes(v)) & 0x7FFFFFFF) % self.width
        day = v.date() if isinstance(v, datetime) else v
        if self.transform == "year":
            return day.year
        if self.transform == "month":
            return day.year * 12 + day.month - 1
        if self.transform == "day":
            return (day - _EPOCH).days
        return _to_micros(v) // 3_600_000_000


def _to_micros(v: datetime) -> int:
    v = v if v.tzinfo else v.replace(tzinfo=timezone.utc)
    gap = v - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (gap.days * 86_400 + gap.seconds) * 1_000_000 + gap.microseconds


def _bytes(v: Any) -> bytes:
    if isinstance(v, str):
        return v.encode()
    if isinstance(v, bytes):
        return v
    if isinstance(v, datetime):
        v = _to_micros(v)
    elif isinstance(v, date):
        v = (v - _EPOCH).days
    return int(v).to_bytes(8, "little", signed=True)


def _murmur3(data: bytes) -> int:
    def rotate(x: int, n: int) -> int:
        return (x << n | x >> (32 - n)) & _MASK32

    def scrambled(k: int) -> int:
        return rotate(k * 0xCC9E2D51 & _MASK32, 15) * 0x1B873593 & _MASK32

    h, whole = 0, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rotate(h ^ scrambled(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & _MASK32
    if len(data) > whole:
        h ^= scrambled(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & _MASK32
    return h ^ h >> 16


@dataclass(frozen=True)
class PartitionSpec:
    spec_id: int = 0
    fields: tuple[PartitionField, ...] = ()

    @classmethod
    def load(cls, spec_id: int, fields: tuple[dict, ...]) -> PartitionSpec:
        return cls(spec_id, tuple(PartitionField(**f) for f in fields))

    @classmethod
    def by(cls, *fields: tuple) -> PartitionSpec:
        """From (source, transform) or (source, transform, width)."""
        return cls(0, tuple(PartitionField(1000 + i, *f) for i, f in enumerate(fields)))

    @classmethod
    def unpartitioned(cls) -> PartitionSpec:
        return cls()

    @property
    def is_partitioned(self) -> bool:
        return any(f.transform != "void" for f in self.fields)

    def dump(self) -> list[dict]:
        return [asdict(f) for f in self.fields]

    def adding(self, source: str, transform: str, width: int | None = None) -> PartitionSpec:
        return PartitionSpec(self.spec_id + 1, (*self.fields, PartitionField(max([999, *(f.field_id for f in self.fields)]) + 1, source, transform, width)))

    def removing(self, name: str) -> PartitionSpec:
        """The field stays, as void: ids are never used again."""
        self._field(name)
        return PartitionSpec(self.spec_id + 1, tuple(PartitionField(f.field_id, f.source, "void") if f.name == name else f for f in self.fields))

    def replacing(self, name: str, transform: str, width: int | None = None) -> PartitionSpec:
        return self.removing(name).adding(self._field(name).source, transform, width)

    def _field(self, name: str) -> PartitionField:
        for f in self.fields:
            if f.name == name:
                return f
        raise InvalidArgument(f"no partition field '{name}'")

    def normalized(self, values: dict | None, current: PartitionSpec) -> dict:
        """Partition values written under this spec, by the fields of the current one; a field that it lacks is null."""
        own = {f.field_id: f.name for f in self.fields}
        return {f.name: (values or {}).get(own.get(f.field_id, "")) for f in current.fields}


def plain(value: Any) -> Any:
    """A partition value as JSON."""
    if isinstance(value, (datetime, date, Decimal)):
        return str(value)
    return value.hex() if isinstance(value, (bytes, bytearray)) else value
