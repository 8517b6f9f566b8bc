"""Compaction: rewriting files without changing rows. Bin-packing, sorting, Z-order, and writing deletes into files.

Planning works on metadata; rewriting reads a plan's files as rows, so schemas, formats and deletion vectors
are resolved as in any read. Commits are marked as compactions, which change feeds pass over.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.catalog import Catalog
from ledgerlake.functions.zorder import DEFAULT_BITS, zorder_key
from ledgerlake.model import CommitResult, DataFile, View
from ledgerlake.plans import scan
from ledgerlake.plans.scan import order_column
from ledgerlake.sources.formats import WriteOptions
from ledgerlake.sources.staging import stage
from ledgerlake.table import Snapshot, Table

MB = 1 << 20


@dataclass(frozen=True)
class Config:
    target_bytes: int = 256 * MB
    small_bytes: int = 16 * MB
    most_files: int = 100
    fewest_files: int = 10
    deleted_share: float = 0.1
    vector_rows: int = 1_000_000


@dataclass(frozen=True)
class Triggers:
    """Any one that is reached asks for compaction."""

    small_files: int = 10
    small_share: float = 0.5
    total_files: int = 1000
    deleted_share: float = 0.1


@dataclass(frozen=True)
class Result:
    """What a compaction took and made; commit is None if there was nothing to do."""

    files_before: int = 0
    files_after: int = 0
    bytes_before: int = 0
    bytes_after: int = 0
    rows: int = 0
    commit: CommitResult | None = None


def worth_materializing(f: DataFile, config: Config) -> bool:
    return bool(f.dv_path) and (f.deleted_share >= config.deleted_share or f.dv_cardinality >= config.vector_rows)


def bin_pack(files: Iterable[DataFile], config: Config = Config()) -> list[list[DataFile]]:  # noqa: B008 - immutable
    """Groups to rewrite together: small files and those with many deletes, largest first into the first bin with room.

    Bins of one file without deletes are dropped. Files of different partitions or specs never share a bin.
    """
    chosen = {f.uuid: f for f in files if f.effective_bytes < config.small_bytes or worth_materializing(f, config)}
    if len(chosen) < config.fewest_files and not any(worth_materializing(f, config) for f in chosen.values()):
        return []
    bins: list[tuple[tuple, list[DataFile]]] = []
    for f in sorted(chosen.values(), key=lambda f: (-f.effective_bytes, f.path))[: config.most_files]:
        place = _partition(f)
        for at, own in bins:
            if at == place and sum(x.effective_bytes for x in own) + f.effective_bytes <= config.target_bytes:
                own.append(f)
                break
        else:
            bins.append((place, [f]))
    return [own for _, own in bins if len(own) > 1 or own[0].dv_path]


def _partition(f: DataFile) -> tuple:
    return (f.spec_id, *sorted((k, str(v)) for k, v in (f.partition_values or {}).items()))


def running_bins(files: DataFrame, target_bytes: int) -> DataFrame:
    """files(file_uuid, file_size_bytes, partition_values) with bin: an approximation of bin-packing by running sums, for file lists that are themselves large."""
    from pyspark.sql import Window

    w = Window.partitionBy("partition_values").orderBy(F.desc("file_size_bytes"), "file_uuid").rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("bin", F.floor((F.sum("file_size_bytes").over(w) - F.col("file_size_bytes")) / F.lit(target_bytes)))


def needs_compaction(view: View, triggers: Triggers = Triggers(), config: Config = Config()) -> dict:  # noqa: B008 - immutable
    """The measures and whether any trigger is reached."""
    n, small = len(view.files), sum(f.size_bytes < config.small_bytes for f in view.files)
    rows, deleted = sum(f.record_count for f in view.files), sum(f.dv_cardinality for f in view.files)
    out = {"files": n, "small_files": small, "small_share": small / n if n else 0.0, "deleted_share": deleted / rows if rows else 0.0}
    out["needed"] = n > 1 and (small >= triggers.small_files or out["small_share"] >= triggers.small_share or n >= triggers.total_files) or out["deleted_share"] >= triggers.deleted_share
    return out


def _outputs(files: list[DataFile], target_bytes: int) -> int:
    return max(1, -(-sum(f.effective_bytes for f in files) // target_bytes))


def _rewrite(table: Table, view: View, groups: list[list[DataFile]], lay_out) -> Result:
    """One commit for all groups: their files out, the new ones in. A group's rows are laid out by lay_out(df, outputs)."""
    spark, before, after = table.catalog.spark, [f for g in groups for f in g], []
    spec = Snapshot(table.catalog, view).spec()
    for group in groups:
        df = lay_out(scan.read_files(spark, group, view.schema.spec.to_spark()), group)
        if not _all_deleted(group):
            after += stage(df, view.location, view.schema.spec, spec, WriteOptions(), arranged=True)
    builder = table.write(view.transaction_id).of_kind("compaction").delete_files([f.uuid for f in before])
    if after:
        builder = builder.append_files(after)
    commit = builder.commit()
    return Result(len(before), len(after), sum(f.size_bytes for f in before), sum(f.size_bytes for f in after), sum(f.record_count for f in after), commit)


def _all_deleted(files: list[DataFile]) -> bool:
    return not sum(f.live_rows for f in files)


def compact(table: Table, config: Config = Config(), attempts: int = 3, dry_run: bool = False) -> Result:  # noqa: B008 - immutable
    """Bin-packs the head. After a conflict, plans again on the new head. Files that are left alone are not listed."""

    def attempt() -> Result:
        view = table.catalog.rewritable(table.ident, config.small_bytes)
        groups = bin_pack(view.files, config)
        if dry_run or not groups:
            files = [f for g in groups for f in g]
            return Result(len(files), sum(_outputs(g, config.target_bytes) for g in groups), sum(f.size_bytes for f in files))
        return _rewrite(table, view, groups, lambda df, group: df.coalesce(_outputs(group, config.target_bytes)))

    return table.catalog.commit_with_retry(attempt, attempts)


def _by_partition(files: Iterable[DataFile]) -> list[list[DataFile]]:
    groups = defaultdict(list)
    for f in files:
        groups[_partition(f)].append(f)
    return list(groups.values())


def compact_partitions(table: Table, config: Config = Config()) -> Result:  # noqa: B008 - immutable
    """Each partition that has more than one file, or deletes, into as few files as its size asks for."""

    def attempt() -> Result:
        view = table.read()
        groups = [g for g in _by_partition(view.files) if len(g) > 1 or g[0].dv_path]
        return _rewrite(table, view, groups, lambda df, group: df.coalesce(_outputs(group, config.target_bytes))) if groups else Result()

    return table.catalog.commit_with_retry(attempt)


def sort_compact(table: Table, order: list[tuple], config: Config = Config()) -> Result:  # noqa: B008 - immutable
    """Rewrites each partition in order: (column, ascending, nulls first). Files hold consecutive ranges, so bounds prune."""
    columns = [order_column(*o) for o in order]

    def lay_out(df: DataFrame, group: list[DataFile]) -> DataFrame:
        return df.repartitionByRange(_outputs(group, config.target_bytes), *columns).sortWithinPartitions(*columns)

    return _whole(table, lay_out)


def zorder_compact(table: Table, names: list[str], bits: int = DEFAULT_BITS, config: Config = Config()) -> Result:  # noqa: B008 - immutable
    """Rewrites each partition along a Z-order curve over columns."""

    def lay_out(df: DataFrame, group: list[DataFile]) -> DataFrame:
        key = zorder_key(df, names, bits)
        return df.repartitionByRange(_outputs(group, config.target_bytes), key).sortWithinPartitions(key)

    return _whole(table, lay_out)


def _whole(table: Table, lay_out) -> Result:
    def attempt() -> Result:
        view = table.read()
        groups = _by_partition(view.files)
        return _rewrite(table, view, groups, lay_out) if groups else Result()

    return table.catalog.commit_with_retry(attempt)


def materialize_deletes(table: Table, config: Config = Config()) -> Result:  # noqa: B008 - immutable
    """Rewrites the files of which enough rows are deleted, each by itself."""

    def attempt() -> Result:
        view = table.read()
        groups = [[f] for f in view.files if worth_materializing(f, config)]
        return _rewrite(table, view, groups, lambda df, _: df.coalesce(1)) if groups else Result()

    return table.catalog.commit_with_retry(attempt)


def compact_all(catalog: Catalog, namespace: str | None = None, triggers: Triggers = Triggers(), config: Config = Config()) -> dict[str, Result]:  # noqa: B008 - immutable
    """One round over the tables that need it; to be called on a schedule."""
    out = {}
    for ident in catalog.list_tables(namespace):
        table = Table(catalog, ident)
        if needs_compaction(table.read(), triggers, config)["needed"]:
            out[str(ident)] = compact(table, config)
    return out
