"""The driver's contract, and some of its queries against SQL on the smallest tables."""

import importlib.util
import sys

import pytest

SF = "/root/testdata/sf0.001"


def comparable(rows, columns):
    return sorted([tuple(round(float(r[c]), 6) if isinstance(r[c], float) or type(r[c]).__name__ == "Decimal" else r[c] for c in columns) for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize(
    "name",
    ["snapshot_current", "time_travel_v4", "schema_evolution_read", "event_log_counts", "net_delta_rows", "pred_and", "prune_partition_bucket", "transform_bucket", "dv_delete_where", "upsert_by_key", "cdc_counts", "cdc_updates", "compact_zorder", "stream_ingest", "multi_table_commit", "security_masks", "snapshot_join", "snapshot_as_of_join"],
)
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    answer = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    assert comparable(df.collect(), columns) == comparable([dict(zip(names, r, strict=True)) for r in answer.fetchall()], columns)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators(monkeypatch):
    """Both are optional for the entry module, and nothing else needs them."""
    for name in [m for m in sys.modules if m.startswith("ledgerlake.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ledgerlake.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as entry

    spec = importlib.util.spec_from_file_location("entry_alone", entry.__file__)
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert "snapshot_current" in alone.queries() and not any(n.startswith("op1") for n in alone.queries()) and "pipeline" not in alone.queries()
