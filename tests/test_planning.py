from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.errors import InvalidArgument, Unsupported
from ledgerlake.functions.transforms import PartitionField, PartitionSpec
from ledgerlake.functions.zorder import interleaved
from ledgerlake.model import DataFile
from ledgerlake.operators.compaction import Config, bin_pack
from ledgerlake.plans import predicate as P
from ledgerlake.plans.pruning import partition_may_match
from ledgerlake.plans.stats import decode, encode, merged
from ledgerlake.sources import formats

NUMBERS = st.one_of(st.none(), st.integers(-5, 5))


def stats_of(values):
    seen = [v for v in values if v is not None]
    return lambda _: P.ColumnStats(len(values), len(values) - len(seen), 0, min(seen, default=None), max(seen, default=None), len(set(seen)))


SIGNS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@given(st.lists(NUMBERS, min_size=1, max_size=6), st.sampled_from(sorted(SIGNS)), st.integers(-6, 6), st.integers(-6, 6))
@settings(max_examples=300, deadline=None)
def test_pruning_never_loses_a_row(values, sign, v, w):
    known, seen = stats_of(values), [x for x in values if x is not None]
    cases = [
        (P.Compare("a", sign, v), any(SIGNS[sign](x, v) for x in seen)),
        (P.Between("a", v, w), any(v <= x <= w for x in seen)),
        (P.In("a", (v, w)), any(x in (v, w) for x in seen)),
        (P.IsNull("a"), None in values),
        (P.IsNotNull("a"), bool(seen)),
        (~P.Compare("a", sign, v), any(not SIGNS[sign](x, v) for x in seen)),
        (P.Eq("a", v) | P.Eq("a", w), any(x in (v, w) for x in seen)),
        (P.Ge("a", v) & P.Le("a", w), any(v <= x <= w for x in seen)),
    ]
    for predicate, some in cases:
        assert predicate.may_match(known) or not some, predicate
        assert 0 <= predicate.selectivity(known) <= 1


def test_pruning_prunes():
    known = stats_of([3, 4, 5])
    assert not any(p.may_match(known) for p in (P.Eq("a", 9), P.Lt("a", 3), P.Le("a", 2), P.Gt("a", 5), P.Ge("a", 6), P.Between("a", 6, 9), P.In("a", (1, 2)), P.IsNull("a"), P.Eq("a", None)))
    assert not P.IsNotNull("a").may_match(stats_of([None, None]))


def test_nan_and_unknown_keep():
    assert P.Gt("a", 9.0).may_match(lambda _: P.ColumnStats(3, 0, 1, 1.0, 2.0)) and not P.Gt("a", 9.0).may_match(lambda _: P.ColumnStats(3, 0, 0, 1.0, 2.0))
    assert P.Eq("a", 1).may_match(lambda _: P.ColumnStats()) and P.Eq("a", "x").may_match(stats_of([1, 2]))


def test_text_prefixes():
    known = lambda _: P.ColumnStats(3, 0, 0, "cat", "dog")
    assert P.StartsWith("a", "ca").may_match(known) and P.StartsWith("a", "d").may_match(known) and not P.StartsWith("a", "e").may_match(known) and not P.StartsWith("a", "b").may_match(known)
    assert P.Like("a", "c%t").may_match(known) and not P.Like("a", "zz%").may_match(known) and P.Like("a", "%x").may_match(known)


def test_forms():
    p = (P.Eq("a", "it's") & P.Gt("b", 2)) & P.IsNull("c")
    assert p.columns() == {"a", "b", "c"} and len(list(p.conjuncts())) == 3
    assert p.to_lance() == "((a = 'it''s') AND (b > 2)) AND (c IS NULL)" and (p | P.Like("a", "x")).to_lance() is None
    with pytest.raises(InvalidArgument):
        P.Compare("a", "<>", 1)


@pytest.mark.parametrize("value", [1, 1.5, "x", None, True, datetime(2020, 1, 2, 3, 4, 5, 6), date(1969, 12, 31), Decimal("1.20"), float("inf")])
def test_bounds_as_json(value):
    assert decode(encode(value)) == value


def test_merged_stats():
    out = merged([{"a": {"nulls": 1, "nans": 0, "min": 3, "max": 5}}, None, {"a": {"nulls": 2, "nans": 1, "min": -1, "max": None}}])
    assert out == {"a": {"nulls": 3, "nans": 1, "min": -1, "max": 5}}


DAY = PartitionField(1, "ts", "day")


@pytest.mark.parametrize(("transform", "value", "out"), [("year", datetime(1969, 12, 31, 22), 1969), ("month", date(1970, 2, 1), 1970 * 12 + 1), ("day", datetime(1969, 12, 31, 22, 30), -1), ("hour", datetime(1969, 12, 31, 23, 30), -1), ("identity", 5, 5), ("void", 5, None), ("day", None, None)])
def test_transform_values(transform, value, out):
    assert PartitionField(1, "c", transform).value(value) == out


def test_bucket_and_truncate():
    assert PartitionField(1, "c", "bucket", 16).value(34) == (2017239379 & 0x7FFFFFFF) % 16
    assert [PartitionField(1, "c", "truncate", 5).value(v) for v in (-7, 7, "abcdefg")] == [-5, 5, "abcde"]


def test_spec_evolution():
    spec = PartitionSpec.by(("ts", "day"), ("id", "bucket", 4))
    assert spec.is_partitioned and not PartitionSpec.unpartitioned().is_partitioned
    gone = spec.removing("ts_day").removing("id_bucket")
    assert not gone.is_partitioned and [f.field_id for f in gone.fields] == [1000, 1001]
    new = spec.replacing("ts_day", "month")
    assert [f.transform for f in new.fields] == ["void", "bucket", "month"] and new.fields[-1].field_id == 1002
    assert spec.normalized({"ts_day": 3, "id_bucket": 1}, new) == {"ts_void": 3, "id_bucket": 1, "ts_month": None}
    with pytest.raises(InvalidArgument):
        spec.removing("none")


def test_partition_pruning():
    spec = PartitionSpec.by(("ts", "day"), ("id", "bucket", 4))
    at = (date(2020, 1, 2) - date(1970, 1, 1)).days
    values = {"ts_day": at, "id_bucket": 1}
    test = lambda p: partition_may_match(p, spec, values)
    assert test(P.Eq("ts", datetime(2020, 1, 2, 5))) and not test(P.Eq("ts", datetime(2020, 1, 3)))
    assert test(P.Lt("ts", datetime(2020, 1, 2, 1))) and not test(P.Lt("ts", datetime(2020, 1, 1))) and not test(P.Gt("ts", datetime(2020, 1, 3, 1)))
    own = PartitionField(1, "id", "bucket", 4)
    inside = next(v for v in range(99) if own.value(v) == 1)
    outside = next(v for v in range(99) if own.value(v) != 1)
    assert test(P.Eq("id", inside)) and not test(P.Eq("id", outside)) and test(P.Lt("id", -99)) and test(P.In("id", (outside, inside)))
    assert not partition_may_match(P.Eq("ts", datetime(2020, 1, 1)), spec, {"ts_day": None}) and partition_may_match(P.Eq("ts", datetime(2020, 1, 1)), spec, {}) and partition_may_match(P.IsNull("ts"), spec, {"ts_day": None})


def sized(n, size, dv=0, part=None):
    return DataFile(f"u{n}", "parquet", f"p{n}", 100, size, "t", 2, None, None, part, None, 0, None, "dv" if dv else None, dv)


def test_bin_packing():
    mb = 1 << 20
    config = Config(target_bytes=30 * mb, small_bytes=16 * mb, fewest_files=3)
    bins = bin_pack([sized(n, s * mb) for n, s in enumerate((12, 10, 8, 15, 5, 200))], config)
    assert sorted(sorted(f.size_bytes // mb for f in b) for b in bins) == [[5, 8, 10], [12, 15]]
    assert bin_pack([sized(0, mb), sized(1, mb)], config) == []
    assert [len(b) for b in bin_pack([sized(0, 200 * mb, dv=20), sized(1, 200 * mb, dv=2)], config)] == [1]
    apart = bin_pack([sized(n, mb, part={"p": n % 2}) for n in range(4)], config)
    assert sorted(len(b) for b in apart) == [2, 2] and all(len({f.partition_values["p"] for f in b}) == 1 for b in apart)


def test_format_options():
    assert formats.parse_format("PARQUET") == "parquet"
    good = {"compression": "ZSTD", "max_row_group_size": 10, "writer_version": "2.0", "created_by": "x", "offset_index_disabled": True, "bloom_filter_position": "end"}
    assert formats.spark_options(formats.write_options("parquet", good))["compression"] == "zstd"
    assert formats.write_options("lance", {"mode": "append", "max_rows_per_file": 1}) and formats.write_options("vortex", {"exclude_dtype": True}) and formats.write_options("parquet", None) == {}
    for name, options in (("csv", {}), ("parquet", {"nope": 1}), ("parquet", {"compression": 1}), ("parquet", {"compression": "rar"}), ("parquet", {"max_row_group_size": "1"}), ("parquet", {"max_row_group_size": True}), ("lance", {"mode": "x"}), ("vortex", {"exclude_dtype": 1}), ("parquet", [1])):
        with pytest.raises(Unsupported):
            formats.write_options(name, options)
    with pytest.raises(Unsupported):
        formats.spark_options({"compression": "brotli"})


def test_zorder_limits(spark):
    from pyspark.sql import functions as F

    with pytest.raises(InvalidArgument):
        interleaved([F.lit(1)] * 8, 8)
