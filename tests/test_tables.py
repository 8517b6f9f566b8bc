"""Tables with data: every operator against plain filters of the rows that went in."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlake import relations as R
from ledgerlake.catalog import Catalog
from ledgerlake.errors import Conflict, InvalidArgument, LimitExceeded, PermissionDenied, Unsupported
from ledgerlake.functions.masks import Mask
from ledgerlake.functions.transforms import PartitionField, PartitionSpec
from ledgerlake.limits import Limits
from ledgerlake.model import ColumnSpec, SchemaSpec
from ledgerlake.operators import changes, compaction, deletes, maintenance, partitions, security
from ledgerlake.plans import predicate as P
from ledgerlake.plans import scan, stats
from ledgerlake.plans.pruning import pushdown
from ledgerlake.sources.formats import LanceRead, ParquetRead, Reader, WriteOptions
from ledgerlake.streaming import changelog, ingest

ROWS = [(n, f"g{n % 3}", None if n % 7 == 0 else float(n), datetime(2020, 1 + n % 4, 1 + n % 28, n % 24)) for n in range(60)]
SCHEMA = "id long, grp string, x double, ts timestamp_ntz"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def table(catalog, rows, tmp_path):
    return catalog.create_table("s.t", str(tmp_path / "t"), SchemaSpec.from_spark(rows.schema))


@pytest.fixture
def filled(table, rows):
    """2, 3, 4: a third of the ids each."""
    for k in range(3):
        table.append(rows.where(f"id div 20 = {k}").coalesce(1))
    return table


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_snapshot_equals_what_was_appended(filled):
    assert ids(filled.df()) == list(range(60)) and ids(filled.snapshot(3).df()) == list(range(40)) and ids(filled.snapshot(1).df()) == []
    assert filled.snapshot().record_count() == 60 and filled.df().schema.names == ["id", "grp", "x", "ts"]


def test_pruned_reads(filled):
    p = P.Between("id", 25, 30)
    assert len(filled.snapshot().files(p)) == 1 and ids(filled.df(p)) == list(range(25, 31))
    assert ids(filled.df(P.IsNull("x"))) == [n for n in range(60) if n % 7 == 0] and filled.df(P.Eq("id", 99)).count() == 0
    plan = filled.df(p, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,25), LessThanOrEqual(id,30)]" in plan and "ReadSchema: struct<id:bigint>" in plan
    cost = filled.snapshot().cost(p)
    assert (cost.files_total, cost.files_read, cost.rows_read) == (3, 1, 20) and cost.rows_returned < 20
    assert [how for _, how in pushdown([p, "id = 1"])] == ["exact", "unsupported"]


def test_file_stats_are_exact(filled):
    first = filled.read().files[0]
    assert first.column_stats["id"] == {"nulls": 0, "nans": 0, "min": 0, "max": 19, "distinct": None} and first.column_stats["x"]["nulls"] == 3 and first.record_count == 20
    assert stats.decode(first.column_stats["ts"]["min"]) == min(r[3] for r in ROWS[:20])
    assert maintenance.column_statistics(filled)["id"] == {"nulls": 0, "nans": 0, "min": 0, "max": 59}
    assert maintenance.refresh_table_stats(filled)["record_count"] == 60 == filled.read().stats["record_count"]


def test_nan_is_kept_out_of_bounds(catalog, spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double").coalesce(1)
    t = catalog.create_table("s.nan", str(tmp_path / "n"), SchemaSpec.from_spark(df.schema))
    t.append(df)
    assert t.read().files[0].column_stats["x"] == {"nulls": 1, "nans": 1, "min": 1.0, "max": 1.0, "distinct": None}
    assert t.df(P.Gt("x", 5.0)).count() == 1


def test_writes_are_checked(table, spark):
    one = datetime(2020, 1, 1)
    for bad in (spark.createDataFrame([(1,)], "nope int"), spark.createDataFrame([("a", "b", 1.0, one)], "id string, grp string, x double, ts timestamp_ntz")):
        with pytest.raises(InvalidArgument):
            table.append(bad)
    table.append(spark.createDataFrame([(1, "a")], "id int, grp string"))
    assert table.df().collect()[0].asDict() == {"id": 1, "grp": "a", "x": None, "ts": None}


def test_not_null_is_enforced(catalog, spark, tmp_path):
    t = catalog.create_table("s.nn", str(tmp_path / "nn"), SchemaSpec.of(("id", pa.int64())))
    with pytest.raises(Exception, match="not nullable"):
        t.append(spark.createDataFrame([(None,)], "id long"))
    with pytest.raises(InvalidArgument):
        t.append(spark.createDataFrame([(1,)], "other long"))
    assert t.read().sequence == 1


def test_evolution_reads_old_files_in_the_new_schema(catalog, spark, tmp_path):
    t = catalog.create_table("s.e", str(tmp_path / "e"), SchemaSpec.of(("a", pa.int32(), True), ("f", pa.float32(), True), ("u", pa.uint32(), True)))
    t.append(spark.createDataFrame([(1, 1.5, 7)], "a int, f float, u long"))
    t.evolve(SchemaSpec((ColumnSpec("n", pa.string(), True), ColumnSpec("a", pa.int64(), True), ColumnSpec("f", pa.float64(), True), ColumnSpec("u", pa.uint64(), True))))
    t.append(spark.createDataFrame([("x", 2**40, 2.5, Decimal(2))], "n string, a long, f double, u decimal(20,0)"))
    assert sorted((r.n or "", r.a, r.f, int(r.u)) for r in t.df().collect()) == [("", 1, 1.5, 7), ("x", 2**40, 2.5, 2)]
    assert t.snapshot(2).df().dtypes == [("a", "int"), ("f", "float"), ("u", "bigint")]
    assert [c["change"] for c in changes.schema_changes(t)] == ["created", "added", "type_changed", "type_changed", "type_changed"]


def test_partitioned_writes_and_pruning(catalog, rows, tmp_path):
    spec = PartitionSpec.by(("ts", "month"), ("id", "bucket", 2))
    t = catalog.create_table("s.p", str(tmp_path / "p"), SchemaSpec.from_spark(rows.schema), partitioned_by=spec.dump())
    t.append(rows)
    assert all(set(f.partition_values) == {"ts_month", "id_bucket"} for f in t.read().files) and ids(t.df()) == list(range(60))
    p = P.Ge("ts", datetime(2020, 3, 5)) & P.Lt("ts", datetime(2020, 3, 20))
    read = t.snapshot().files(p)
    assert read and {f.partition_values["ts_month"] for f in read} == {2020 * 12 + 2}
    assert ids(t.df(p)) == [r[0] for r in ROWS if datetime(2020, 3, 5) <= r[3] < datetime(2020, 3, 20)]
    own = PartitionField(1, "id", "bucket", 2)
    assert {f.partition_values["id_bucket"] for f in t.snapshot().files(P.Eq("id", 11))} == {own.value(11)} and ids(t.df(P.Eq("id", 11))) == [11]
    partitions.drop_partition(t, {"ts_month": 2020 * 12})
    assert ids(t.df()) == [r[0] for r in ROWS if r[3].month != 1] and partitions.drop_partition(t, {"ts_month": 1}) is None
    t.set_partitioning(t.snapshot().spec().removing("id_bucket").adding("grp", "truncate", 1))
    t.append(rows.where("id = 0"))
    assert ids(t.df(P.Eq("grp", "g0")))[0] == 0 and any(dict(k).get("grp_trunc") == "g" for k in partitions.partitions(t))
    with pytest.raises(InvalidArgument):
        t.set_partitioning(PartitionSpec.by(("x", "year")))


def test_null_partition(catalog, spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, date(1969, 12, 31))], "id long, d date")
    t = catalog.create_table("s.np", str(tmp_path / "np"), SchemaSpec.from_spark(df.schema), partitioned_by=PartitionSpec.by(("d", "day")).dump())
    t.append(df)
    assert sorted(str(f.partition_values["d_day"]) for f in t.read().files) == ["-1", "None"]
    assert ids(t.df(P.IsNull("d"))) == [1] and ids(t.df(P.Eq("d", date(1969, 12, 31)))) == [2]


def test_transforms_in_spark_and_python_agree(spark):
    df = spark.createDataFrame([(n, f"tëxt{n}" if n % 5 else "", datetime(1969, 12, 30) + timedelta(hours=7 * n), date(1969, 12, 30) + timedelta(days=n), n - 10) for n in range(30)], "id long, s string, ts timestamp_ntz, d date, i int")
    for field in [
        PartitionField(1, c, t, w) for c, t, w in (("s", "bucket", 8), ("id", "bucket", 8), ("ts", "bucket", 8), ("d", "bucket", 8), ("i", "bucket", 8), ("ts", "hour", None), ("ts", "day", None), ("d", "month", None), ("d", "year", None), ("i", "truncate", 4), ("s", "truncate", 2))
    ]:
        got = df.select(F.col(field.source).alias("v"), field.column(df.schema[field.source].dataType).alias("p")).collect()
        assert all(r.p == field.value(r.v) for r in got), field


def test_deletes(filled):
    deletes.delete_where(filled, P.Gt("x", 50.0))
    kept = [r[0] for r in ROWS if not (r[2] is not None and r[2] > 50)]
    assert ids(filled.df()) == kept and filled.snapshot().record_count() == len(kept) and ids(filled.snapshot(4).df()) == list(range(60))
    deletes.delete_where(filled, P.Lt("id", 3))
    kept = [n for n in kept if n >= 3]
    assert ids(filled.df()) == kept
    assert deletes.delete_where(filled, P.Lt("id", 3)) is None and deletes.delete_where(filled, P.Eq("id", 999)) is None
    first = filled.read().files[0]
    deletes.delete_rows(filled, {first.uuid: [3, 4]})
    assert len(ids(filled.df())) == len(kept) - 2
    by = {f.uuid: f for f in filled.read().files}[first.uuid]
    assert by.dv_cardinality == 5 and by.live_rows == 15 and deletes.stats_after_delete(by)["column_stats"]["id"]["min"] is None
    with pytest.raises(InvalidArgument):
        deletes.delete_rows(filled, {first.uuid: [20]})
    with pytest.raises(Conflict):
        deletes.delete_rows(filled, {"none": [0]})
    counts = R.effective_counts(filled.catalog, "s.t", filled.read().sequence).agg(F.sum("live").alias("n")).first().n
    assert counts == filled.snapshot().record_count()


def test_delete_conflicts_with_compaction(filled):
    base, file = filled.current_transaction_id(), filled.read().files[0]
    compaction.compact(filled, compaction.Config(fewest_files=2))
    with pytest.raises(Conflict):
        filled.write(base).set_deletion_vector(file.uuid, "x", 1).commit()
    with pytest.raises(Conflict):
        filled.write().set_deletion_vector(file.uuid, "x", 1).commit()
    deletes.delete_where_with_retry(filled, P.Eq("id", 1))
    assert ids(filled.df()) == [0, *range(2, 60)]


def test_upsert(filled, rows):
    deletes.upsert(filled, rows.where("id < 5").withColumn("grp", F.lit("new")).unionByName(rows.where("id = 0").withColumn("id", F.lit(100).cast("long"))), ["id"])
    got = {r.id: r.grp for r in filled.df().collect()}
    assert len(got) == 61 and got[4] == "new" and got[5] == "g2" and got[100] == "g0"
    with pytest.raises(InvalidArgument):
        deletes.upsert(filled, rows.limit(1).unionByName(rows.limit(1)), ["id"])


def test_row_changes(filled, rows):
    deletes.delete_where(filled, P.Lt("id", 4))
    deletes.delete_where(filled, P.Lt("id", 6))
    filled.write().delete_files([filled.read().files[0].uuid]).commit()
    got = [(r._txn_seq, r._op, r.id) for r in changes.in_order(changes.read_changes(filled, 4)).collect()]
    assert got == [(5, "delete", n) for n in range(4)] + [(6, "delete", n) for n in (4, 5)] + [(7, "delete", n) for n in range(6, 20)]
    replayed = set()
    for r in changes.in_order(changes.read_changes(filled)).collect():
        (replayed.add if r._op == "insert" else replayed.remove)(r.id)
    assert sorted(replayed) == ids(filled.df())
    saved = changes.Checkpoint.loads(changes.Checkpoint("s.t", 6).dumps())
    df, after = changes.read_changes_since(filled, saved)
    assert df.count() == 14 and after.sequence == 7 and changes.read_changes_since(filled, after)[0].count() == 0
    with pytest.raises(InvalidArgument):
        changes.read_changes(filled, 5, 2)


def test_updates_by_key(filled, rows):
    deletes.upsert(filled, rows.where("id in (1, 25)").withColumn("x", F.lit(-1.0)), ["id"])
    df = changes.read_changes(filled, 4, keys=("id",), previous=True)
    assert sorted((r.id, r._op, r._prev.x, r.x) for r in df.collect()) == [(1, "update", 1.0, -1.0), (25, "update", 25.0, -1.0)]
    plain = changes.read_changes(filled, 4)
    assert plain.count() == 4 and changes.read_changes(filled, 4, ops=("delete",), columns=("id",)).columns == ["id", *changes.META]
    with pytest.raises(InvalidArgument):
        changes.read_changes(filled, 4, previous=True)
    import json

    envelope = json.loads(changes.debezium(df, ["id", "x"], "s.t").first().value)
    assert envelope["op"] == "u" and envelope["after"]["x"] == -1.0 and envelope["before"]["id"] in (1, 25) and envelope["source"]["sequence"] == 5


def test_duplicate_keys_stay_deletes_and_inserts(spark):
    rows = [(1, "delete", 1, "t", "f", 0), (1, "delete", 1, "t", "f", 1), (1, "insert", 1, "t", "g", 0), (2, "insert", 1, "t", "g", 1)]
    df = spark.createDataFrame(rows, "id long, _op string, _txn_seq long, _txn_id string, _file string, _pos long")
    assert sorted((r.id, r._op) for r in changes.detect_updates(df, ("id",), ["id"]).collect()) == [(1, "delete"), (1, "delete"), (1, "insert"), (2, "insert")]


def test_compaction_changes_no_row(filled):
    deletes.delete_where(filled, P.Eq("grp", "g1"))
    before, log = ids(filled.df()), changes.read_changes(filled).count()
    assert compaction.compact(filled, compaction.Config(fewest_files=2), dry_run=True).commit is None
    result = compaction.compact(filled, compaction.Config(fewest_files=2))
    assert (result.files_before, result.files_after) == (3, 1) and ids(filled.df()) == before and changes.read_changes(filled).count() == log
    assert not any(f.dv_path for f in filled.read().files) and ids(filled.snapshot(4).df()) == list(range(60))
    assert compaction.compact(filled, compaction.Config(fewest_files=2)).commit is None


def test_sorted_and_zordered_files(filled):
    small = compaction.Config(target_bytes=1)
    compaction.sort_compact(filled, [("id", False)], compaction.Config())
    assert [r.id for r in filled.df().collect()] == list(range(59, -1, -1))
    compaction.zorder_compact(filled, ["id", "ts"], 4, small)
    assert ids(filled.df()) == list(range(60))
    with pytest.raises(InvalidArgument):
        compaction.zorder_compact(filled, ["id", "ts", "x"], 30)


def test_materialized_deletes_and_triggers(filled):
    deletes.delete_where(filled, P.Lt("id", 5))
    measures = compaction.needs_compaction(filled.read())
    assert measures["needed"] and measures["files"] == 3
    result = compaction.materialize_deletes(filled)
    assert (result.files_before, result.rows) == (1, 15) and ids(filled.df()) == list(range(5, 60))
    deletes.delete_where(filled, P.Lt("id", 20))
    assert compaction.materialize_deletes(filled).files_after == 0 and ids(filled.df()) == list(range(20, 60))
    assert "s.t" in compaction.compact_all(filled.catalog, "s", config=compaction.Config(fewest_files=2))


def test_compaction_retries_on_the_new_head(filled, rows, monkeypatch):
    real, done = compaction.bin_pack, []

    def racing(files, config):
        groups = real(files, config)
        if not done:
            done.append(filled.append(rows.where("id = 0").withColumn("id", F.lit(500).cast("long")).coalesce(1)))
        return groups

    monkeypatch.setattr(compaction, "bin_pack", racing)
    assert compaction.compact(filled, compaction.Config(fewest_files=2)).files_before == 4
    assert ids(filled.df()) == [*range(60), 500]


def test_retention(filled):
    filled.write().delete_files([filled.read().files[0].uuid]).commit()
    maintenance.tag(filled, "keep", 3)
    assert maintenance.expire(filled, keep=1) == 2 and len(filled.snapshot(3).view.files) == 2
    with filled.catalog.store.write() as w:
        w.run("delete from tags")
    assert maintenance.expire(filled, keep=1) == 2 and ids(filled.df()) == list(range(20, 60)) and changes.earliest(filled) == 5
    with pytest.raises(InvalidArgument):
        filled.read_at(3)
    with pytest.raises(InvalidArgument):
        maintenance.expire(filled, keep=0)
    assert maintenance.expire(filled, older_than=timedelta(days=1)) == 0


def test_orphans(filled, rows):
    deletes.delete_where(filled, P.Eq("id", 1))
    filled.stage(rows.coalesce(1))
    assert maintenance.orphans(filled).count() == 0 and maintenance.orphans(filled, timedelta(seconds=-5)).count() == 1
    assert maintenance.remove_orphans(filled, timedelta(seconds=-5)) == 1 and ids(filled.df()) == [0, *range(2, 60)]


def test_relations(filled):
    c = filled.catalog
    assert R.totals(c, "s.t", 3).first().asDict()["records"] == 40 and R.chain_gaps(c, "s.t").count() == 0 and R.schema_gaps(c, "s.t").count() == 0
    assert {r.state for r in R.lifecycle(c, "s.t", 1).collect()} == {"visible"}
    assert R.bounded(R.relation(c, "files", "s.t"), 3) and c.limits.files_per_query == 10_000
    with pytest.raises(LimitExceeded):
        R.bounded(R.relation(c, "files", "s.t"), 2)
    R.register_views(c)
    assert c.spark.sql("select count(*) as n from meta_columns").first().n == 4
    bins = compaction.running_bins(R.relation(c, "files", "s.t"), 1)
    assert {r.bin for r in bins.collect()} and bins.count() == 3


def test_stats_of_scans(spark, filled):
    df = filled.df()
    assert {r.bin: r.n for r in stats.equi_width(df, "id", 0, 60, 3).collect()} == {1: 20, 2: 20, 3: 20}
    assert {r.value: r.n for r in stats.singleton(df, "grp").collect()} == {"g0": 20, "g1": 20, "g2": 20}
    assert [r.high for r in stats.equi_height(df, "id", 3).collect()] == [19, 39, 59] and stats.average(df, "id").first().average == 29.5
    both = stats.sketch(df.where("id < 40"), "id").union(stats.sketch(df.where("id >= 20"), "id"))
    assert abs(stats.distinct_estimate(both, "id").first().id - 60) <= 2


def test_formats(spark, rows, tmp_path):
    from ledgerlake.errors import InvalidInput
    from ledgerlake.sources.formats import write

    write(rows.coalesce(1), str(tmp_path / "z"), WriteOptions(format_options={"compression": "zstd", "data_page_size_limit": 4096}, sort_columns=("grp",), max_rows_per_file=25))
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "z").glob("*.parquet"))
    assert len(files) == 3 and pq.ParquetFile(files[0]).metadata.row_group(0).column(0).compression == "ZSTD"
    reader = Reader.new(spark, "parquet", rows.schema)
    assert ids(reader.read(str(tmp_path / "z"))) == sorted(r.id for r in reader.stream(str(tmp_path / "z"))) == list(range(60))
    assert reader.read(str(tmp_path / "z"), options=ParquetRead(columns=("id",), where="id < 3", batch_size=100)).columns == ["id"]
    with pytest.raises(Unsupported, match="do not match"):
        reader.read(str(tmp_path / "z"), options=LanceRead())
    for name in ("lance", "vortex"):
        with pytest.raises(Unsupported, match="not installed"):
            Reader.new(spark, name).read("x")
        with pytest.raises(Unsupported):
            write(rows, str(tmp_path / name), WriteOptions(name))
    write(rows.where("false"), str(tmp_path / "empty"))
    assert reader.read(str(tmp_path / "empty")).schema == rows.schema
    with pytest.raises(InvalidInput):
        write(rows.where("false"), str(tmp_path / "stream"), stream=True)


def test_scan_requests(filled):
    plan = scan.Plan().filter(P.Gt("id", 10)).filter(P.Lt("id", 50)).sort(("x", True, False), ("id",)).limit(5, 2).project("id", "x")
    got = filled.snapshot().scan(plan.build())
    want = sorted((r for r in ROWS if 10 < r[0] < 50), key=lambda r: (r[2] is None, r[2] or 0, r[0]))[2:7]
    assert [(r.id, r.x) for r in got.collect()] == [(r[0], r[2]) for r in want]


def test_ingest_is_idempotent(spark, table, rows, tmp_path):
    source = str(tmp_path / "in")
    rows.repartition(3).write.parquet(source)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.ingest(stream(), table, "q", str(tmp_path / "c1")).awaitTermination()
    assert ids(table.df()) == list(range(60)) and table.read().sequence == 4
    # A lost checkpoint: all batches run again under their numbers.
    ingest.ingest(stream(), table, "q", str(tmp_path / "c2")).awaitTermination()
    assert ids(table.df()) == list(range(60)) and table.read().sequence == 4
    assert ingest.replay(table, [(0, rows), (9, rows.limit(1))], "q") == 1 and not ingest.commit_batch(table, rows.where("false"), "q", 10)


def test_buffer(table, rows):
    buffer = ingest.Buffer(table, "b", flush_rows=20)
    assert not buffer.add(rows.where("id < 5"), 5)
    assert ids(buffer.read()) == [] and ids(buffer.read(include_buffered=True)) == list(range(5))
    assert buffer.add(rows.where("id >= 5 and id < 25"), 20) and ids(buffer.read()) == list(range(25)) and not buffer.flush()
    log = changes.read_changes(table, table.read().sequence, buffered=rows.where("id = 30"))
    assert [(r._op, r._txn_seq) for r in log.collect()] == [("insert", None)]


def test_change_log_stream(spark, rows, tmp_path):
    path = str(tmp_path / "m.db")
    t = Catalog.open(spark, path).create_table("s.log", str(tmp_path / "d"), SchemaSpec.from_spark(rows.schema))
    t.append(rows.coalesce(1))
    t.write().delete_files([t.read().files[0].uuid]).commit()
    changelog.read_log(spark, path, "s.log", 1).writeStream.format("memory").queryName("log_seen").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.txn_sequence, r.change) for r in spark.table("log_seen").collect()) == [(2, "added"), (3, "removed")]


def test_security(filled):
    who = security.Principal("eve", frozenset({"analyst"}), {"grp": "g1' or '1'='1", "least": 10, "own": ["g1", "g2"]})
    own = security.Security(
        {"analyst": (security.Permission("read", "s.*"),)}, [security.Policy("deny", (("least", ">", 99),))],
        {"s.t": [security.RowFilter("grp = :grp"), security.RowFilter("array_contains(:own, grp)"), security.RowFilter("id >= :least", restrictive=True), security.RowFilter("false", roles=frozenset({"other"}))]},
        {"s.t": [security.ColumnRule("x"), security.ColumnRule("ts", Mask("null")), security.ColumnRule("grp", Mask("partial", first=1), unless=frozenset({"boss"}))]},
    )
    got = own.read(who, filled)
    assert ids(got) == [n for n in range(10, 60) if n % 3] and got.columns == ["id", "grp", "ts"]
    first = got.first()
    assert first.ts is None and first.grp == "g*"
    assert own.read(security.Principal("b", frozenset({"analyst", "boss"}), who.attributes), filled).first().grp in ("g1", "g2")
    for call in (lambda: own.check(who, "write", "s.t"), lambda: own.check(who, "read", "other.t"), lambda: own.check(security.Principal("n"), "read", "s.t"), lambda: own.check(security.Principal("d", frozenset({"analyst"}), {"least": 100}), "read", "s.t")):
        with pytest.raises(PermissionDenied):
            call()
    with pytest.raises(InvalidArgument):
        own.allowed(who, "fly", "s.t")
    assert own.audit(filled.catalog.spark).where("not allowed").count() == 4 and security.matches("*", "a.b") and not security.matches("a.b", "a.bc")


def test_masks(spark):
    df = spark.createDataFrame([("abcdef", 5), ("ab", None), (None, 1)], "s string, n int")
    show = lambda mask, c="s": [r[0] for r in df.select(mask.column(c, df.schema[c].dataType)).collect()]
    assert show(Mask("partial", first=1, last=2)) == ["a***ef", "**", None] and show(Mask("partial", first=1), "n") == [None] * 3
    assert show(Mask("default", 0), "n") == [0] * 3 and show(Mask("custom", "upper(s)")) == ["ABCDEF", "AB", None] and show(Mask("null")) == [None] * 3
    a, b = show(Mask("tokenize", "k1")), show(Mask("tokenize", "k2"))
    assert a[0] != b[0] and a[2] is None and len(show(Mask("sha256"))[0]) == 64
    with pytest.raises(InvalidArgument):
        show(Mask("odd"))


def test_files_registered_without_statistics_are_measured(catalog, rows, tmp_path):
    from ledgerlake.model import FileSpec

    rows.coalesce(1).write.parquet(str(tmp_path / "raw"))
    path = next((tmp_path / "raw").glob("*.parquet"))
    t = catalog.create_table("s.raw", str(tmp_path / "raw"), SchemaSpec.from_spark(rows.schema))
    t.write().append_file(FileSpec(str(path), 60, path.stat().st_size)).commit()
    assert t.df(P.Eq("id", 3)).count() == 1 and len(t.snapshot().files(P.Eq("id", 99))) == 1
    assert maintenance.collect_file_stats(t) == 1 and t.snapshot().files(P.Eq("id", 99)) == [] and maintenance.collect_file_stats(t) == 0


def test_changes_after_expiry(spark, tmp_path):
    table = Catalog.in_memory(spark).create_table("n.t", str(tmp_path / "t"), SchemaSpec.from_spark(spark.range(1).schema))
    for k in range(3):
        table.append(spark.range(10 * k, 10 * k + 10))
    assert changes.read_changes(table).count() == 30
    maintenance.expire(table, keep=1)
    deletes.delete_where(table, P.Lt("id", 5))
    assert sorted((r.id, r["_op"]) for r in changes.read_changes(table).collect()) == [(k, "delete") for k in range(5)]
    assert changes.initial_checkpoint(table).sequence == 4 and changes.read_changes(table, 4).count() == 5
    with pytest.raises(InvalidArgument, match="have expired"):
        changes.read_changes(table, 2)


def test_a_buffer_after_a_restart_loses_nothing(spark, tmp_path):
    table = Catalog.in_memory(spark).create_table("n.t", str(tmp_path / "t"), SchemaSpec.from_spark(spark.range(1).schema))
    first = ingest.Buffer(table, "q")
    first.add(spark.range(3), 3)
    assert first.flush() and not first.flush()
    second = ingest.Buffer(table, "q")
    second.add(spark.range(3, 9), 6)
    assert second.flush() and not second.pending and table.df().count() == 9
    sized = ingest.Buffer(table, "q", flush_bytes=100)
    assert not sized.add(spark.range(9, 10), 1, 60) and sized.add(spark.range(10, 11), 1, 60) and table.df().count() == 11
    aged = ingest.Buffer(table, "q", flush_seconds=0)
    assert aged.add(spark.range(11, 12), 1) and table.df().count() == 12


def test_updates_of_keys_that_are_not_one_to_one(spark):
    """A key with a null, and one with two inserts in a transaction, stay deletes and inserts."""
    rows = [(1, "a", "delete", 1), (1, "b", "insert", 1), (2, "c", "delete", 1), (2, "d", "insert", 1), (2, "e", "insert", 1), (None, "f", "delete", 1), (None, "g", "insert", 1), (1, "h", "insert", 2)]
    df = spark.createDataFrame([(k, v, op, n, str(n), "f", i) for i, (k, v, op, n) in enumerate(rows)], "id long, v string, _op string, _txn_seq long, _txn_id string, _file string, _pos long")
    got = {(r.id, r.v, r["_op"], r["_prev"] and r["_prev"].v) for r in changes.detect_updates(df, ("id",), ["id", "v"], True).collect()}
    assert got == {(1, "b", "update", "a"), (2, "c", "delete", None), (2, "d", "insert", None), (2, "e", "insert", None), (None, "f", "delete", None), (None, "g", "insert", None), (1, "h", "insert", None)}


def test_masks_of_names_with_dots(spark):
    df = spark.createDataFrame([("abcdef", "x")], "`a.b` string, `c``d` string")
    masks = {"a.b": Mask("partial", first=1, last=1), "c`d": Mask("sha256")}
    got = df.select(*[masks[f.name].column(f.name, f.dataType) for f in df.schema]).first()
    assert got[0] == "a****f" and len(got[1]) == 64


def test_upsert_evaluates_its_input_once(spark, catalog, tmp_path):
    """Random values: those that were compared are those that were written."""
    df = spark.range(20).select(F.col("id"), F.lit(0.0).alias("x"))
    table = catalog.create_table("s.once", str(tmp_path / "once"), SchemaSpec.from_spark(df.schema))
    table.append(df)
    drawn = spark.range(10).select((F.col("id") * 4 + F.floor(F.rand() * 4)).alias("id"), F.lit(1.0).alias("x"))
    deletes.upsert(table, drawn, ["id"])
    ids = [r.id for r in table.df().collect()]
    assert len(ids) == len(set(ids)) and table.df().where("x = 1").count() == 10
    deletes.upsert(table, drawn.limit(0), ["id"])
    assert sorted(r.id for r in table.df().collect()) == sorted(ids)


def test_changes_hold_no_rows_in_a_broadcast(spark, tmp_path):
    """Inserts and deletes of files that are small as they are written, with many rows: only the list of files is broadcast."""
    table = Catalog.in_memory(spark).create_table("n.t", str(tmp_path / "t"), SchemaSpec.from_spark(spark.range(1).schema))
    for k in range(2):
        table.append(spark.range(1000 * k, 1000 * k + 1000).coalesce(1))
    table.write().delete_files([table.read().files[0].uuid]).commit()
    found = changes.read_changes(table)
    seen = [(r["_op"], r["_txn_seq"], r["count"]) for r in found.groupBy("_op", "_txn_seq").count().collect()]
    assert sorted(seen) == [("delete", 4, 1000), ("insert", 2, 1000), ("insert", 3, 1000)]
    plan = str(found._jdf.queryExecution().executedPlan())
    assert plan.count("BuildRight") == 2 and "BuildLeft" not in plan


def test_changes_of_a_table_with_more_files_than_a_snapshot_may_list(spark, tmp_path):
    """Files too large for compaction stay: appends, change feeds and compactions of others go on, reading the whole is refused."""
    catalog = Catalog.in_memory(spark, limits=Limits(files_per_query=2))
    table = catalog.create_table("n.t", str(tmp_path / "t"), SchemaSpec.from_spark(spark.range(1).schema))
    seen, point = [], changes.initial_checkpoint(table)
    for k in range(4):
        table.append(spark.range(10 * k, 10 * k + 10).coalesce(1))
        new, point = changes.read_changes_since(table, point)
        seen += [(r.id, r["_op"], r["_txn_seq"]) for r in new.collect()]
        assert compaction.compact(table, compaction.Config(small_bytes=1, fewest_files=2)).commit is None
    assert sorted(seen) == [(n, "insert", 2 + n // 10) for n in range(40)] and point.sequence == 5
    with pytest.raises(LimitExceeded):
        table.read()
    small = compaction.Config(small_bytes=5000, fewest_files=2)
    with pytest.raises(LimitExceeded):  # four to choose from
        compaction.compact(table, small)
    table.write().delete_files([c.file.uuid for n in (2, 3) for c in catalog.events("n.t", n - 1, n)[0].file_changes]).commit()
    table.append(spark.range(40, 20040).coalesce(1))
    assert compaction.compact(table, small).files_before == 2 and len(table.read().files) == 2
    steps = [changes.read_changes(table, n, n + k).groupBy("_op").count().collect() for n, k in ((5, 1), (6, 2))]
    assert [[tuple(r) for r in step] for step in steps] == [[("delete", 20)], [("insert", 20000)]]
    assert sorted(r.id for r in table.df().collect()) == list(range(20, 20040))
