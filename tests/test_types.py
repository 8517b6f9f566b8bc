import pyarrow as pa
import pytest
from pyspark.sql import types as T

from ledgerlake import types
from ledgerlake.errors import InvalidArgument, Unsupported

KINDS = [
    pa.bool_(), pa.int8(), pa.int16(), pa.int32(), pa.int64(), pa.uint8(), pa.uint16(), pa.uint32(), pa.uint64(), pa.float32(), pa.float64(), pa.string(), pa.large_string(), pa.binary(), pa.large_binary(), pa.binary(16),
    pa.date32(), pa.date64(), pa.time32("s"), pa.time32("ms"), pa.time64("us"), pa.time64("ns"), *[pa.duration(u) for u in ("s", "ms", "us", "ns")], *[pa.timestamp(u) for u in ("s", "ms", "us", "ns")],
    *[pa.timestamp(u, "UTC") for u in ("s", "ms", "us", "ns")], pa.timestamp("us", "Europe/Paris"), pa.decimal128(10, 2), pa.decimal128(38, 10), pa.decimal256(76, 20), pa.list_(pa.int32()), pa.large_list(pa.int32()),
    pa.list_(pa.int32(), 3), pa.struct([("a", pa.int32()), ("b", pa.list_(pa.string()))]),
]


@pytest.mark.parametrize("kind", KINDS, ids=str)
def test_round_trip(kind):
    assert types.decode(types.encode(kind)) == kind


@pytest.mark.parametrize("data", [b"", b"garbage", pa.schema([]).serialize().to_pybytes(), pa.schema([("a", pa.int8()), ("b", pa.int8())]).serialize().to_pybytes()])
def test_unreadable(data):
    with pytest.raises(InvalidArgument):
        types.decode(data)


ALLOWED = {
    ("int8", "int16"), ("int8", "int32"), ("int8", "int64"), ("int16", "int32"), ("int16", "int64"), ("int32", "int64"), ("uint8", "uint16"), ("uint8", "uint32"), ("uint8", "uint64"),
    ("uint16", "uint32"), ("uint16", "uint64"), ("uint32", "uint64"), ("float", "double"), ("date32[day]", "date64[ms]"), ("decimal128(10, 2)", "decimal128(20, 2)"),
    *[(f"timestamp[{a}{z}]", f"timestamp[{b}{z}]") for z in ("", ", tz=UTC") for a, b in (("s", "ms"), ("s", "us"), ("s", "ns"), ("ms", "us"), ("ms", "ns"), ("us", "ns"))],
}


def test_evolution_matrix():
    """Every pair of types, both ways."""
    kinds = [*KINDS, pa.decimal128(20, 2), pa.decimal128(20, 3), pa.decimal256(40, 2), pa.list_(pa.int64())]
    for a in kinds:
        for b in kinds:
            assert types.can_evolve(a, b) == (a == b or (str(a), str(b)) in ALLOWED), (a, b)


def test_spark_types():
    assert types.to_spark(pa.uint64()) == T.DecimalType(20, 0)
    assert types.to_spark(pa.time64("us")) == T.LongType()
    assert types.to_spark(pa.timestamp("ms")) == T.TimestampNTZType() and types.to_spark(pa.timestamp("ms", "UTC")) == T.TimestampType()
    for kind in (pa.timestamp("ns"), pa.float16(), pa.decimal256(40, 2), pa.dense_union([pa.field("a", pa.int8())])):
        with pytest.raises(Unsupported):
            types.to_spark(kind)
    for kind in (pa.int32(), pa.string(), pa.timestamp("us"), pa.decimal128(9, 1), pa.list_(pa.struct([("x", pa.float64())])), pa.map_(pa.string(), pa.int64())):
        assert types.to_spark(types.from_spark(types.to_spark(kind))) == types.to_spark(kind)
