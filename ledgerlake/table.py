"""A table: snapshots at any commit as DataFrames, writes, changes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerlake.catalog import Catalog, MutationBuilder
from ledgerlake.functions.transforms import PartitionSpec
from ledgerlake.model import CommitResult, DataFile, Delta, Event, FileSpec, SchemaSpec, TableIdent, View
from ledgerlake.plans import pruning, scan
from ledgerlake.plans.predicate import Predicate
from ledgerlake.plans.scan import ScanRequest
from ledgerlake.sources.formats import WriteOptions
from ledgerlake.sources.staging import stage


@dataclass(frozen=True)
class Snapshot:
    """A table as of one commit."""

    catalog: Catalog
    view: View

    def df(self, predicate: Predicate | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """The rows, lazily. Files that the predicate rules out are not opened."""
        return self.scan(ScanRequest(predicate, tuple(columns) if columns else None))

    def scan(self, request: ScanRequest) -> DataFrame:
        return scan.scan(self.catalog.spark, self.view, request)

    def files(self, predicate: Predicate | None = None) -> list[DataFile]:
        return pruning.pruned(self.view, predicate)

    def cost(self, predicate: Predicate | None = None, limit: int | None = None) -> pruning.Cost:
        return pruning.cost(self.view, predicate, limit)

    def record_count(self) -> int:
        """From metadata: rows of the files less those deleted by position."""
        return sum(f.live_rows for f in self.view.files)

    def spec(self) -> PartitionSpec:
        return PartitionSpec.load(self.view.spec_id, self.view.specs.get(self.view.spec_id, ()))

    def create_view(self, name: str) -> None:
        """Makes the snapshot a table of spark.sql."""
        self.df().createOrReplaceTempView(name)


@dataclass(frozen=True)
class Table:
    catalog: Catalog
    ident: TableIdent

    def read(self) -> View:
        return self.catalog.read_table(self.ident)

    def read_at(self, at: str | int) -> View:
        return self.catalog.read_table(self.ident, at)

    def snapshot(self, at: str | int | None = None) -> Snapshot:
        """At a transaction id or sequence, or the head."""
        return Snapshot(self.catalog, self.catalog.read_table(self.ident, at))

    def df(self, predicate: Predicate | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        return self.snapshot().df(predicate, columns)

    def current_transaction_id(self) -> str:
        return self.catalog.current_transaction_id(self.ident)

    def events(self, after: str | int | None = None, to: str | int | None = None) -> list[Event]:
        return self.catalog.events(self.ident, after, to)

    def diff(self, after: str | int, to: str | int) -> Delta:
        return self.catalog.diff(self.ident, after, to)

    def write(self, base: str | None = None) -> MutationBuilder:
        """A commit on top of ``base``, by default the head."""
        return MutationBuilder(self.catalog, self.ident, base or self.current_transaction_id())

    def stage(self, df: DataFrame, options: WriteOptions | None = None, *, stream: bool = False) -> list[FileSpec]:
        """Data files with df's rows, not yet part of the table."""
        now = Snapshot(self.catalog, self.catalog.describe(self.ident))
        return stage(df, now.view.location, now.view.schema.spec, now.spec(), options, stream=stream)

    def append(self, df: DataFrame, options: WriteOptions | None = None, change: Callable[[MutationBuilder], MutationBuilder] = lambda b: b) -> CommitResult:
        """Adds df's rows. An append depends on no other row, so after a conflict it is committed on the new head.

        More files than one operation may add go into several operations of the same commit.
        """
        files = self.stage(df, options)
        most = self.catalog.limits.files_per_append

        def attempt() -> CommitResult:
            builder = change(self.write())
            for i in range(0, max(1, len(files)), most):
                builder = builder.append_files(files[i : i + most])
            return builder.commit()

        return self.catalog.commit_with_retry(attempt)

    def evolve(self, schema: SchemaSpec) -> CommitResult:
        return self.write().update_schema(schema).commit()

    def set_partitioning(self, spec: PartitionSpec) -> CommitResult:
        """For files written from now on."""
        kinds = {f.name: f.dataType for f in self.read().schema.spec.to_spark()}
        for f in spec.fields:
            f.check(kinds[f.source])
        return self.write().set_partition_spec(spec.dump()).commit()

    def drop(self) -> None:
        self.catalog.drop_table(self.ident)
