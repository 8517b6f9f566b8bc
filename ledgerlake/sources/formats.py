"""File formats and their options. Parquet is Spark's; lance and vortex need their libraries, which are looked for when used."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.errors import InvalidInput, Unsupported

FORMATS = ("parquet", "lance", "vortex")

#: Codecs by accepted name. Spark can't write brotli without a codec that does not come with it.
_CODECS = {"uncompressed": "uncompressed", "none": "uncompressed", "snappy": "snappy", "gzip": "gzip", "brotli": "brotli", "lz4": "lz4_raw", "zstd": "zstd"}
_WRITER_VERSIONS = {"1.0": "v1", "parquet_1_0": "v1", "2.0": "v2", "parquet_2_0": "v2"}
_BLOOM_POSITIONS = ("afterrowgroup", "after_row_group", "end")


def parse_format(name: str) -> str:
    if name.lower() not in FORMATS:
        raise Unsupported(f"File format '{name}' is not supported. Supported formats: {', '.join(FORMATS)}")
    return name.lower()


def _text(key: str, value: Any) -> str:
    if not isinstance(value, str):
        raise Unsupported(f"{key} must be a string")
    return value


def _flag(key: str, value: Any) -> bool:
    if not isinstance(value, bool):
        raise Unsupported(f"{key} must be a bool")
    return value


def _size(key: str, value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise Unsupported(f"{key} must be a non-negative integer")
    return value


def _one_of(names: Any) -> Callable[[str, Any], str]:
    def check(key: str, value: Any) -> str:
        if _text(key, value).lower() not in names:
            raise Unsupported(f"Unsupported {key}: {value}")
        return value.lower()

    return check


#: Options that a format's writer knows, each with its check.
_OPTIONS: dict[str, dict[str, Callable[[str, Any], Any]]] = {
    "parquet": {
        "compression": _one_of(_CODECS), "max_row_group_size": _size, "data_page_size_limit": _size, "data_page_row_count_limit": _size, "write_batch_size": _size,
        "writer_version": _one_of(_WRITER_VERSIONS), "bloom_filter_position": _one_of(_BLOOM_POSITIONS), "created_by": _text, "offset_index_disabled": _flag,
    },
    "lance": {"max_rows_per_file": _size, "max_rows_per_group": _size, "max_bytes_per_file": _size, "mode": _one_of(("create", "append", "overwrite")), "enable_stable_row_ids": _flag, "enable_v2_manifest_paths": _flag},
    "vortex": {"exclude_dtype": _flag},
}


def write_options(format_name: str, options: dict | None) -> dict:
    """The checked options of a format; unknown keys and wrong types are refused. Registering a file and writing one use this alike."""
    known = _OPTIONS[parse_format(format_name)]
    if options is None:
        return {}
    if not isinstance(options, dict):
        raise Unsupported("format_options must be a JSON object")
    for key in options:
        if key not in known:
            raise Unsupported(f"Unsupported option '{key}' for format '{format_name}'")
    return {key: known[key](key, value) for key, value in options.items()}


def spark_options(options: dict) -> dict[str, str]:
    """Spark's names of checked Parquet options. A row group's limit in rows becomes one in bytes at 128 bytes a row;
    batch size, bloom position, creator and offset index have no knob in Spark: they are recorded with the file only."""
    out = {}
    if "compression" in options:
        if options["compression"] == "brotli":
            raise Unsupported("compression brotli: this Spark has no codec for it")
        out["compression"] = _CODECS[options["compression"]]
    if "max_row_group_size" in options:
        out["parquet.block.size"] = str(max(1, options["max_row_group_size"]) * 128)
    if "data_page_size_limit" in options:
        out["parquet.page.size"] = str(options["data_page_size_limit"])
    if "data_page_row_count_limit" in options:
        out["parquet.page.row.count.limit"] = str(options["data_page_row_count_limit"])
    if "writer_version" in options:
        out["parquet.writer.version"] = _WRITER_VERSIONS[options["writer_version"]]
    return out


@dataclass(frozen=True)
class ParquetRead:
    """batch_size: rows of a columnar batch; columns, where: projection and filter, which reach the scan."""

    batch_size: int | None = None
    columns: tuple[str, ...] | None = None
    where: Any = None


@dataclass(frozen=True)
class LanceRead:
    columns: tuple[str, ...] | None = None
    filter: str | None = None
    limit: int | None = None
    offset: int | None = None
    batch_size: int | None = None
    scan_in_order: bool | None = None
    io_buffer_size: int | None = None


@dataclass(frozen=True)
class VortexRead:
    initial_read_size: int | None = None
    segment_cache: bool = True
    dtype: T.StructType | None = None


READ_OPTIONS = {"parquet": ParquetRead, "lance": LanceRead, "vortex": VortexRead}


def _library(format_name: str) -> None:
    if importlib.util.find_spec(format_name) is None:
        raise Unsupported(f"format '{format_name}' needs the {format_name} library, which is not installed")


@dataclass(frozen=True)
class Reader:
    """Reads files of one format as a DataFrame, lazily: a stream and a whole read are the same plan."""

    spark: SparkSession
    format: str
    schema: T.StructType | None = None

    @classmethod
    def new(cls, spark: SparkSession, format_name: str, schema: T.StructType | None = None) -> Reader:
        return cls(spark, parse_format(format_name), schema)

    def read(self, *paths: str, options: Any = None) -> DataFrame:
        options = options or READ_OPTIONS[self.format]()
        if not isinstance(options, READ_OPTIONS[self.format]):
            raise Unsupported("read options do not match reader format")
        if self.format != "parquet":
            _library(self.format)
            return _sliced(self.spark.read.format(self.format).load(list(paths)), options)
        reader = self.spark.read
        if options.batch_size:
            self.spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", options.batch_size)
        df = (reader.schema(self.schema) if self.schema else reader).parquet(*paths)
        if options.where is not None:
            df = df.where(options.where)
        return df.select(*options.columns) if options.columns else df

    def stream(self, *paths: str, options: Any = None):
        """Rows, a partition at a time."""
        return self.read(*paths, options=options).toLocalIterator(prefetchPartitions=True)


def _sliced(df: DataFrame, options: Any) -> DataFrame:
    if getattr(options, "filter", None):
        df = df.where(options.filter)
    if getattr(options, "columns", None):
        df = df.select(*options.columns)
    return limited(df, getattr(options, "limit", None), getattr(options, "offset", None))


def limited(df: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


@dataclass(frozen=True)
class WriteOptions:
    """Options of any format: those of the format itself, and how rows are laid out."""

    format: str = "parquet"
    format_options: dict = field(default_factory=dict)
    sort_columns: tuple[str, ...] = ()
    max_rows_per_file: int | None = None


def write(df: DataFrame, path: str, options: WriteOptions | None = None, *, partition_by: tuple[str, ...] = (), stream: bool = False) -> None:
    """Writes df to the folder ``path``, which must be new. stream: refuse an empty input, as a stream has no schema without a first batch."""
    options = options or WriteOptions()
    own = write_options(options.format, options.format_options)
    if options.format != "parquet":
        _library(options.format)
    if stream and df.isEmpty():
        raise InvalidInput("cannot write an empty stream")
    if options.sort_columns:
        df = df.sortWithinPartitions(*options.sort_columns)
    writer = df.write.format(options.format).mode("errorifexists")
    for key, value in (spark_options(own) if options.format == "parquet" else own).items():
        writer = writer.option(key, value)
    if options.max_rows_per_file or own.get("max_rows_per_file"):
        writer = writer.option("maxRecordsPerFile", options.max_rows_per_file or own["max_rows_per_file"])
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def files_of(df: DataFrame) -> DataFrame:
    """(file_path, file_size, record_count) of the files under a scan."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size")).agg(F.count("*").alias("record_count"))
