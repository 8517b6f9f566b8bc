"""Writing rows into new data files: staged, measured, then registered by a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.errors import InvalidArgument
from ledgerlake.functions.transforms import PartitionSpec, plain
from ledgerlake.ids import new_uuid
from ledgerlake.model import FileSpec, SchemaSpec
from ledgerlake.plans import stats
from ledgerlake.sources.formats import WriteOptions, write

_DERIVED = "__part_"


def conformed(df: DataFrame, schema: SchemaSpec) -> DataFrame:
    """df in the table's columns and types. Missing nullable columns become null; anything else that differs is refused."""
    target = schema.to_spark()
    extra = [c for c in df.columns if c not in target.names]
    if extra:
        raise InvalidArgument(f"columns not in the table: {', '.join(extra)}")
    given = {f.name: f for f in df.schema}
    out = []
    for column, wanted in zip(schema.columns, target, strict=True):
        if column.name not in given:
            if not column.nullable:
                raise InvalidArgument(f"column '{column.name}' is not nullable and is missing")
            out.append(F.lit(None).cast(wanted.dataType).alias(wanted.name))
            continue
        if not _fits(given[column.name].dataType, wanted.dataType):
            raise InvalidArgument(f"column '{column.name}' is {given[column.name].dataType.simpleString()}, not {wanted.dataType.simpleString()}")
        value = F.col(f"`{column.name}`").cast(wanted.dataType)
        if not column.nullable and given[column.name].nullable:
            value = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"null in column '{column.name}', which is not nullable")).cast(wanted.dataType))
        out.append(value.alias(wanted.name))
    return df.select(*out)


_ORDER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _fits(given: T.DataType, wanted: T.DataType) -> bool:
    if type(given) in _ORDER and type(wanted) in _ORDER:
        return _ORDER.index(type(given)) <= _ORDER.index(type(wanted))
    if isinstance(given, T.FloatType) and isinstance(wanted, T.DoubleType):
        return True
    if isinstance(given, T.DecimalType) and isinstance(wanted, T.DecimalType):
        return given.scale == wanted.scale and given.precision <= wanted.precision
    return given.simpleString() == wanted.simpleString()


def stage(df: DataFrame, location: str, schema: SchemaSpec, spec: PartitionSpec | None = None, options: WriteOptions | None = None, *, stream: bool = False, arranged: bool = False) -> list[FileSpec]:
    """Writes df under location/data in new files and returns them, with rows, sizes, partition values and statistics.

    Rows of a partition are brought together by a rebalancing shuffle, which splits a partition that is too
    large for one task; arranged rows are written as they lie. Statistics take one aggregate over the new files, by file.
    """
    options, spec = options or WriteOptions(), spec or PartitionSpec()
    df = conformed(df, schema)
    kinds = {f.name: f.dataType for f in df.schema}
    fields = [f for f in spec.fields if f.transform != "void"]
    derived = [f"{_DERIVED}{i}" for i in range(len(fields))]
    folder = f"{location.rstrip('/')}/data/{new_uuid()}"
    if fields:
        df = df.withColumns({d: f.column(kinds[f.source]).cast("string") for d, f in zip(derived, fields, strict=True)})
        df = df if arranged else df.hint("rebalance", *derived)
    write(df, folder, options, partition_by=tuple(derived), stream=stream)
    written = df.sparkSession.read.schema(T.StructType([f for f in df.schema if f.name not in derived])).parquet(folder) if _any_file(df, folder) else None
    if written is None:
        return []
    values = [F.first(f.column(kinds[f.source])).alias(f"{d}|value") for d, f in zip(derived, fields, strict=True)]
    where = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size")]
    own = T.StructType([f for f in df.schema if f.name not in derived])
    rows = written.groupBy(*where).agg(F.count("*").alias("record_count"), *stats.aggregates(own), *values).orderBy("file_path").collect()
    out = []
    for r in rows:
        parts = {f.name: plain(r[f"{d}|value"]) for d, f in zip(derived, fields, strict=True)} if fields else None
        out.append(FileSpec(r["file_path"], r["record_count"], r["file_size"], options.format, partition_values=parts, format_options=options.format_options or None, spec_id=spec.spec_id, column_stats=stats.as_stats(r, own)))
    return out


def _any_file(df: DataFrame, folder: str) -> bool:
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(path)
