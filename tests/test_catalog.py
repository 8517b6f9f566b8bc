import threading

import pyarrow as pa
import pytest

from ledgerlake.catalog import Catalog
from ledgerlake.errors import Conflict, InvalidArgument, LimitExceeded, NotFound, ProtocolVersionIncompatible
from ledgerlake.ids import new_transaction_id
from ledgerlake.limits import Limits
from ledgerlake.metastore import MetaStore, Postgres
from ledgerlake.model import AppendFiles, ColumnSpec, DeleteFiles, FileSpec, Mutation, RemoveProperties, SchemaSpec, SetProperties, TableIdent, UpdateSchema

ID = SchemaSpec.of(("id", pa.int64()))


def table_of(catalog, name="ns.t", schema=ID, **more):
    return catalog.create_table(name, "memory://t", schema, **more)


def file(n=1, **more):
    return FileSpec(f"memory://f{n}.parquet", n, 128, **more)


def test_create_load_list_drop(catalog):
    table = table_of(catalog, properties={"a": 1})
    assert table.read().sequence == 1 and table.read().properties == {"a": 1} and table.read().schema.version == 1
    assert catalog.load_table("ns.t").ident == TableIdent("ns", "t") and catalog.load_table("ns.none") is None
    with pytest.raises(Conflict):
        table_of(catalog)
    table_of(catalog, "other.t")
    assert [str(t) for t in catalog.list_tables("ns")] == ["ns.t"] and len(catalog.list_tables()) == 2
    table.write().append_file(file(column_stats={"id": {"min": 1, "max": 2}})).commit()
    catalog.drop_table("ns.t")
    assert catalog.load_table("ns.t") is None
    for call in (lambda: catalog.drop_table("ns.t"), lambda: catalog.read_table("ns.t"), lambda: catalog.current_transaction_id("ns.t")):
        with pytest.raises(NotFound):
            call()


def test_transaction_ids_are_version_7():
    import uuid

    ids = [uuid.UUID(new_transaction_id()) for _ in range(50)]
    assert len(set(ids)) == 50 and {i.version for i in ids} == {7}


def test_commits_time_travel_and_delta(catalog):
    table = table_of(catalog)
    first = table.current_transaction_id()
    results = [table.write().append_files([file(n)]).commit() for n in (1, 2, 3)]
    assert [r.sequence for r in results] == [2, 3, 4]
    gone = table.read_at(results[0].transaction_id).files[0].uuid
    removed = table.write().delete_files([gone, "unknown"]).commit()
    assert removed.removed_files == 1 and [f.record_count for f in table.read().files] == [2, 3]
    assert len(table.read_at(3).files) == 2 and len(table.read_at(first).files) == 0
    delta = table.diff(first, removed.transaction_id)
    assert sorted(f.record_count for f in delta.added_files) == [2, 3] and not delta.removed_files and delta.new_properties is None
    assert [f.uuid for f in table.diff(4, 5).removed_files] == [gone]
    events = table.events()
    assert [e.sequence for e in events] == [1, 2, 3, 4, 5] and events[0].schema_change.version == 1 and events[-1].file_changes[0].kind == "removed"
    assert table.events(5, 5) == [] and len(table.events(2, 4)) == 2
    for call in (lambda: table.events(4, 2), lambda: table.read_at(9), lambda: table.read_at(new_transaction_id()), lambda: table.diff(4, 2)):
        with pytest.raises(InvalidArgument):
            call()


def test_added_before_removed_within_a_transaction(catalog):
    table = table_of(catalog)
    table.write().append_file(file(1)).commit()
    old = table.read().files[0].uuid
    table.write().delete_files([old]).append_file(file(2)).commit()
    assert [c.kind for c in table.events()[-1].file_changes] == ["added", "removed"]


def test_stale_base_conflicts(catalog):
    table = table_of(catalog)
    base = table.current_transaction_id()
    table.write(base).append_file(file(1)).commit()
    with pytest.raises(Conflict):
        table.write(base).append_file(file(2)).commit()
    assert len(table.read().files) == 1


def test_one_winner_of_concurrent_commits(spark, tmp_path):
    catalog = Catalog.open(spark, f"sqlite:{tmp_path}/meta.db")
    table = table_of(catalog)
    base, barrier, out = table.current_transaction_id(), threading.Barrier(4), []

    def run(n):
        barrier.wait()
        try:
            table.write(base).append_file(file(n)).commit()
            out.append("ok")
        except Conflict:
            out.append("conflict")

    threads = [threading.Thread(target=run, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(out) == ["conflict"] * 3 + ["ok"] and len(table.read().files) == 1


def test_one_winner_of_concurrent_creates(spark, tmp_path):
    catalog, barrier, out = Catalog.open(spark, f"{tmp_path}/meta.db"), threading.Barrier(3), []

    def run():
        barrier.wait()
        try:
            table_of(catalog)
            out.append("ok")
        except Conflict:
            out.append("conflict")

    threads = [threading.Thread(target=run) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(out) == ["conflict", "conflict", "ok"]


def test_failed_commit_leaves_nothing(catalog):
    table = table_of(catalog)
    with pytest.raises(InvalidArgument):
        table.write().append_file(file(1)).append_file(FileSpec(" ", 1, 1)).commit()
    assert table.read().sequence == 1 and not table.read().files and len(table.events()) == 1


def test_multi_table_commit_is_all_or_nothing(catalog):
    a, b = table_of(catalog, "ns.a"), table_of(catalog, "ns.b")
    one = Mutation((AppendFiles((file(1),)),))
    with pytest.raises(Conflict):
        catalog.commit_many([(a.ident, a.current_transaction_id(), one), (b.ident, "stale", one)])
    assert not a.read().files and catalog.recover() == 0
    catalog.commit_many([(t.ident, t.current_transaction_id(), one) for t in (a, b)])
    assert len(a.read().files) == len(b.read().files) == 1
    with pytest.raises(InvalidArgument):
        catalog.commit_many([(a.ident, a.current_transaction_id(), one)] * 2)


@pytest.mark.parametrize(
    "mutation",
    [
        Mutation(), Mutation((DeleteFiles(("x", "x")),)), Mutation((UpdateSchema(ID), UpdateSchema(ID))), Mutation((SetProperties({}), SetProperties({}))), Mutation((RemoveProperties(("k", "k")),)), Mutation((RemoveProperties((" ",)),)),
        Mutation((AppendFiles((FileSpec("", 1, 1),)),)), Mutation((AppendFiles((FileSpec("p", -1, 1),)),)), Mutation((AppendFiles((FileSpec("p", 1, -1),)),)), Mutation((AppendFiles((FileSpec("p", 1, 1, partition_values=[1]),)),)),
        Mutation((AppendFiles((FileSpec("p", 1, 1, format="csv"),)),)), Mutation((AppendFiles((FileSpec("p", 1, 1, format_options={"nope": 1}),)),)),
    ],
)
def test_invalid_mutations(catalog, mutation):
    table = table_of(catalog)
    with pytest.raises(InvalidArgument):
        catalog.commit(table.ident, table.current_transaction_id(), mutation)


@pytest.mark.parametrize("schema", [SchemaSpec(()), SchemaSpec.of((" ", pa.int8())), SchemaSpec.of(("a", pa.int8()), ("a", pa.int8()))])
def test_invalid_schemas(catalog, schema):
    with pytest.raises(InvalidArgument):
        table_of(catalog, schema=schema)


def test_names_that_differ_in_case_are_two_columns(catalog):
    assert len(table_of(catalog, schema=SchemaSpec.of(("a", pa.int8()), ("A", pa.int8()))).read().schema.spec.columns) == 2


def test_properties(catalog):
    table = table_of(catalog, properties={"a": 1})
    table.write().set_properties({"b": 2, "c": 3}).remove_properties("c", "missing").commit()
    assert table.read().properties == {"b": 2} == table.read_at(1).properties
    table.write().remove_properties().commit()
    assert table.read().properties == {"b": 2}
    for wrong in ([1], {" ": 1}):
        with pytest.raises(InvalidArgument):
            table.write().set_properties(wrong).commit()


def test_an_empty_append_is_a_transaction(catalog):
    table = table_of(catalog)
    assert table.write().append_files([]).commit().sequence == 2


LIMITS = Limits(files_per_query=3, columns_per_schema=2, tables_per_list=2, transactions_per_scan=3, schema_changes_per_scan=2, operations_per_mutation=2, files_per_append=2, files_per_delete=2, property_keys_to_remove=1, json_bytes=20)


def test_limits_on_both_sides(spark):
    catalog = Catalog.in_memory(spark, limits=LIMITS)
    table = table_of(catalog)

    def over(call):
        with pytest.raises(LimitExceeded):
            call()

    over(lambda: table_of(catalog, "ns.wide", SchemaSpec.of(*((c, pa.int8()) for c in "abc"))))
    over(lambda: table.write().append_files([file(n) for n in range(3)]).commit())
    over(lambda: table.write().delete_files(list("abc")).commit())
    over(lambda: table.write().remove_properties("a", "b").commit())
    over(lambda: table.write().append_files([]).append_files([]).append_files([]).commit())
    over(lambda: table.write().set_properties({"key": "x" * 20}).commit())
    table.write().append_files([file(1), file(2)]).commit()
    table.write().append_file(file(3)).commit()
    assert len(table.read().files) == 3 and len(table.events()) == 3
    table.write().append_file(file(4)).commit()
    over(table.read)
    over(table.events)
    table_of(catalog, "ns.u")
    assert len(catalog.list_tables()) == 2
    table_of(catalog, "ns.v")
    over(catalog.list_tables)


def test_protocol_versions(spark):
    catalog = Catalog.in_memory(spark, reader_version=2, writer_version=3)
    table = table_of(catalog)
    old = Catalog(spark, catalog.store)
    with pytest.raises(ProtocolVersionIncompatible):
        old.read_table("ns.t")
    with pytest.raises(ProtocolVersionIncompatible):
        old.commit("ns.t", table.current_transaction_id(), Mutation((AppendFiles(()),)))
    assert len(old.list_tables()) == 1 and len(old.events("ns.t")) == 1


def evolve(table, *columns):
    return table.evolve(SchemaSpec(tuple(ColumnSpec(*c) for c in columns)))


def test_schema_evolution_chain(catalog):
    table = table_of(catalog, schema=SchemaSpec.of(("id", pa.int8())))
    for kind in (pa.int16(), pa.int32(), pa.int64()):
        evolve(table, ("id", kind))
    assert [table.read_at(s).schema.spec.columns[0].type for s in (1, 2, 3, 4)] == [pa.int8(), pa.int16(), pa.int32(), pa.int64()]
    assert [(v.version, v.valid_from, v.valid_to) for v in catalog.schema_history("ns.t")] == [(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 4, None)]


@pytest.mark.parametrize(
    ("columns", "says"),
    [((("id", pa.int32()),), "cannot evolve"), ((("other", pa.int64()),), "cannot drop"), ((("id", pa.int64()), ("name", pa.string())), "non-nullable")],
)
def test_forbidden_evolution(catalog, columns, says):
    table = table_of(catalog, schema=SchemaSpec.of(("id", pa.int64()), ("name", pa.string(), True)) if says == "non-nullable" else ID)
    with pytest.raises(InvalidArgument, match=says):
        evolve(table, *columns)
    assert table.read().sequence == 1


def test_allowed_evolution(catalog):
    table = table_of(catalog)
    evolve(table, ("new", pa.string(), False), ("id", pa.int64(), True))
    assert [c.name for c in table.read().schema.spec.columns] == ["new", "id"]


def test_order_is_by_sequence_not_id(catalog, monkeypatch):
    """Ids that sort backwards change nothing."""
    ids = iter(f"{99 - n:08d}-0000-7000-8000-000000000000" for n in range(20))
    monkeypatch.setattr("ledgerlake.catalog.new_transaction_id", lambda: next(ids))
    table = table_of(catalog)
    for n in range(4):
        table.write().append_file(file(n)).commit()
    assert [e.sequence for e in table.events()] == [1, 2, 3, 4, 5] and [f.record_count for f in table.read().files] == [0, 1, 2, 3]


def test_four_hundred_commits(catalog):
    table = table_of(catalog)
    for n in range(400):
        table.write().append_file(FileSpec(f"f{n}", 1, 128)).commit()
    events = table.events(1)
    assert len(events) == 400 and all(len(e.file_changes) == 1 for e in events)
    delta = table.diff(1, 401)
    assert len(delta.added_files) == 400 and not delta.removed_files


def test_batches_are_committed_once(catalog):
    table = table_of(catalog)
    table.write().append_file(file(1)).for_batch("q", 0).commit()
    with pytest.raises(Conflict):
        table.write().append_file(file(2)).for_batch("q", 0).commit()
    assert catalog.has_batch("ns.t", "q", 0) and not catalog.has_batch("ns.t", "q", 1) and len(table.read().files) == 1


def test_foreign_keys_and_relations(spark):
    import sqlite3

    store = MetaStore()
    names = {r["name"] for r in store.rows("select name from sqlite_master where type in ('table', 'index')")}
    assert {"tables", "transactions", "schemas", "columns", "files", "table_stats", "file_column_stats", "files_visibility", "schemas_validity"} <= names
    with pytest.raises(sqlite3.IntegrityError), store.write() as w:
        w.insert("transactions", {"transaction_id": "t", "table_uuid": "none", "txn_sequence": 1, "transaction_timestamp": "now"})


def test_dialects():
    assert Postgres.sql("select ? where a = ? and b = ?") == "select $1 where a = $2 and b = $3"


def test_catalog_urls(spark, tmp_path):
    with pytest.raises(InvalidArgument):
        Catalog.open(spark, "postgres://host/db")
    Catalog.open(spark, f"sqlite:{tmp_path}/m.db").create_table("a.b", "x", ID)
    assert Catalog.open(spark, f"{tmp_path}/m.db").load_table("a.b") is not None
