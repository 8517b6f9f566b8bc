"""Column types: Arrow types in the catalog, Spark types in DataFrames, and which changes of type are safe."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

from ledgerlake.errors import InvalidArgument, Unsupported

#: Families in which a type may become any later one.
_WIDENING = (
    (pa.int8(), pa.int16(), pa.int32(), pa.int64()),
    (pa.uint8(), pa.uint16(), pa.uint32(), pa.uint64()),
    (pa.float32(), pa.float64()),
    (pa.date32(), pa.date64()),
)
_UNITS = ("s", "ms", "us", "ns")


def encode(kind: pa.DataType) -> bytes:
    """The type as an Arrow IPC schema of one field."""
    return pa.schema([pa.field("_", kind)]).serialize().to_pybytes()


def decode(data: bytes) -> pa.DataType:
    try:
        schema = pa.ipc.read_schema(pa.py_buffer(data))
    except (pa.ArrowInvalid, OSError, EOFError) as error:
        raise InvalidArgument(f"column type can't be read: {error}") from error
    if len(schema) != 1:
        raise InvalidArgument(f"column type holds {len(schema)} fields, not one")
    return schema.field(0).type


def can_evolve(old: pa.DataType, new: pa.DataType) -> bool:
    """Whether files written with the old type can be read as the new one without loss."""
    if old == new:
        return True
    for family in _WIDENING:
        if old in family and new in family:
            return family.index(old) < family.index(new)
    if pa.types.is_timestamp(old) and pa.types.is_timestamp(new):
        return old.tz == new.tz and _UNITS.index(old.unit) < _UNITS.index(new.unit)
    for same in (pa.types.is_decimal128, pa.types.is_decimal256):
        if same(old) and same(new):
            return old.scale == new.scale and old.precision < new.precision
    return False


_SPARK = {
    pa.bool_(): T.BooleanType(), pa.int8(): T.ByteType(), pa.int16(): T.ShortType(), pa.int32(): T.IntegerType(), pa.int64(): T.LongType(),
    pa.uint8(): T.ShortType(), pa.uint16(): T.IntegerType(), pa.uint32(): T.LongType(), pa.uint64(): T.DecimalType(20, 0),
    pa.float32(): T.FloatType(), pa.float64(): T.DoubleType(), pa.string(): T.StringType(), pa.large_string(): T.StringType(),
    pa.binary(): T.BinaryType(), pa.large_binary(): T.BinaryType(), pa.date32(): T.DateType(), pa.date64(): T.DateType(),
}


def to_spark(kind: pa.DataType) -> T.DataType:
    """The Spark type that holds values of an Arrow type.

    Times are kept as long, durations as day-time intervals; lengths of fixed-size types, time zones and
    the difference between large and plain types stay in the catalog. What Spark can't hold is refused.
    """
    if kind in _SPARK:
        return _SPARK[kind]
    if pa.types.is_fixed_size_binary(kind):
        return T.BinaryType()
    if pa.types.is_time(kind):
        return T.LongType()
    if pa.types.is_duration(kind):
        return T.DayTimeIntervalType()
    if pa.types.is_timestamp(kind):
        if kind.unit == "ns":
            raise Unsupported(f"Spark keeps microseconds; {kind} would lose precision")
        return T.TimestampType() if kind.tz else T.TimestampNTZType()
    if pa.types.is_decimal128(kind):
        return T.DecimalType(kind.precision, kind.scale)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return T.ArrayType(to_spark(kind.value_type), kind.value_field.nullable)
    if pa.types.is_struct(kind):
        return T.StructType([T.StructField(f.name, to_spark(f.type), f.nullable) for f in kind])
    if pa.types.is_map(kind):
        return T.MapType(to_spark(kind.key_type), to_spark(kind.item_type))
    raise Unsupported(f"no Spark type for {kind}")


def from_spark(kind: T.DataType) -> pa.DataType:
    """The Arrow type that a column of a DataFrame is declared with."""
    for arrow, spark in _SPARK.items():
        if spark == kind and not (pa.types.is_unsigned_integer(arrow) or pa.types.is_large_string(arrow)):
            return arrow
    if isinstance(kind, T.TimestampNTZType):
        return pa.timestamp("us")
    if isinstance(kind, T.TimestampType):
        return pa.timestamp("us", "UTC")
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    if isinstance(kind, T.DayTimeIntervalType):
        return pa.duration("us")
    if isinstance(kind, T.ArrayType):
        return pa.list_(from_spark(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, from_spark(f.dataType), f.nullable) for f in kind])
    if isinstance(kind, T.MapType):
        return pa.map_(from_spark(kind.keyType), from_spark(kind.valueType))
    raise Unsupported(f"no Arrow type for {kind.simpleString()}")
