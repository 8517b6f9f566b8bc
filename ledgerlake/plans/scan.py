"""From a view to a DataFrame: choose files, scan by format, cast to the table's schema, leave out deleted rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.model import DataFile, View
from ledgerlake.plans import pruning
from ledgerlake.plans.predicate import Predicate
from ledgerlake.sources.formats import Reader, limited
from ledgerlake.types import to_spark

#: Where a row lies; named so that no table's column is like it.
PATH, POSITION = "__file_path", "__row_position"


@dataclass(frozen=True)
class ScanRequest:
    """What to read of a view. order_by: (column, ascending) or (column, ascending, nulls first)."""

    predicate: Predicate | None = None
    columns: tuple[str, ...] | None = None
    order_by: tuple[tuple, ...] = ()
    limit: int | None = None
    offset: int | None = None
    files: tuple[str, ...] | None = None

    def builder(self) -> Plan:
        return Plan(self)


@dataclass(frozen=True)
class Plan:
    """A logical plan, built step by step; Catalyst optimises what it compiles to."""

    request: ScanRequest = field(default_factory=ScanRequest)

    def filter(self, predicate: Predicate) -> Plan:
        both = predicate if self.request.predicate is None else self.request.predicate & predicate
        return Plan(_with(self.request, predicate=both))

    def project(self, *columns: str) -> Plan:
        return Plan(_with(self.request, columns=columns))

    def sort(self, *order: tuple) -> Plan:
        return Plan(_with(self.request, order_by=order))

    def limit(self, n: int, offset: int | None = None) -> Plan:
        return Plan(_with(self.request, limit=n, offset=offset))

    def build(self) -> ScanRequest:
        return self.request


def _with(request: ScanRequest, **changes: object) -> ScanRequest:
    return ScanRequest(**{**request.__dict__, **changes})


def scan(spark: SparkSession, view: View, request: ScanRequest | None = None) -> DataFrame:
    request = request or ScanRequest()
    files = pruning.pruned(view, request.predicate)
    if request.files is not None:
        files = [f for f in files if f.uuid in request.files]
    df = read_files(spark, files, view.schema.spec.to_spark())
    if request.predicate is not None:
        df = df.where(request.predicate.to_column())
    if request.order_by:
        df = df.orderBy(*[order_column(*o) for o in request.order_by])
    df = limited(df, request.limit, request.offset)
    return df.select(*request.columns) if request.columns else df


def order_column(name: str, ascending: bool = True, nulls_first: bool | None = None):
    c = F.col(name)
    first = ascending if nulls_first is None else nulls_first
    if ascending:
        return c.asc_nulls_first() if first else c.asc_nulls_last()
    return c.desc_nulls_first() if first else c.desc_nulls_last()


def read_files(spark: SparkSession, files: list[DataFile], schema: T.StructType, located: bool = False) -> DataFrame:
    """Live rows of files in the given schema; columns that a file lacks are null. located: with PATH and POSITION."""
    whole = [f for f in files if not f.dv_path]
    holed = [f for f in files if f.dv_path]
    parts = [_located(_read(spark, group, schema, located), schema, located) for group in _by_format(whole)]
    for group in _by_format(holed):
        rows = _located(_read(spark, group, schema, True), schema, True)
        rows = rows.join(deleted_positions(spark, group), [PATH, POSITION], "left_anti")
        parts.append(rows if located else rows.drop(PATH, POSITION))
    if not parts:
        extra = [T.StructField(PATH, T.StringType()), T.StructField(POSITION, T.LongType())] if located else []
        return spark.createDataFrame([], T.StructType([*schema.fields, *extra]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _by_format(files: list[DataFile]) -> list[list[DataFile]]:
    """Files that one scan can read: of one format, and with the same types as they were written in."""
    kind = lambda f: (f.format, f.written_as)
    return [[f for f in files if kind(f) == k] for k in dict.fromkeys(kind(f) for f in files)]


def _read(spark: SparkSession, files: list[DataFile], schema: T.StructType, located: bool) -> DataFrame:
    older = dict(files[0].written_as)
    schema = T.StructType([T.StructField(f.name, to_spark(older[f.name])) if f.name in older else f for f in schema])
    df = Reader.new(spark, files[0].format, schema if files[0].format == "parquet" else None).read(*[f.path for f in files])
    if located:
        # Taken directly from the scan, where the metadata columns belong.
        df = df.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_metadata.file_path").alias(PATH), F.col("_metadata.row_index").alias(POSITION))
    return df


def _located(df: DataFrame, schema: T.StructType, located: bool) -> DataFrame:
    names = set(df.columns)
    own = [(F.col(f"`{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*own, *([PATH, POSITION] if located else []))


def deleted_positions(spark: SparkSession, files: list[DataFile]) -> DataFrame:
    """(PATH, POSITION) that the files' deletion vectors hold. A vector file may serve several files, so it is narrowed to these."""
    rows = spark.read.schema(f"{PATH} string, {POSITION} long").parquet(*dict.fromkeys(f.dv_path for f in files if f.dv_path))
    return rows.where(F.col(PATH).isin([f.path for f in files])) if len(files) <= 500 else rows
