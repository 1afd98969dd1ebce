import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in entry.catalogue.queries())


@pytest.fixture(scope="module")
def duck(data_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    return connection


def plain(value):
    import math

    import numpy as np
    import pandas as pd

    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, list | tuple | np.ndarray):
        return tuple(plain(v) for v in value)
    return value.item() if hasattr(value, "item") else value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, data_dir, name):
    found = entry.queries()[name](spark, data_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(found.columns)
        return
    want = duck.sql(sql).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted((tuple(plain(v) for v in row) for row in df[columns].itertuples(index=False, name=None)), key=repr)
    assert key(found) == key(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("ionweave.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ionweave.llm", None)
    try:
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(OWN)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_streams_equal_batches(spark, data_dir, tmp_path):
    from ionweave.streaming import events

    batch = events.event_stream  # the folder also holds other tables; the glob picks the events
    for k, (form, mode) in enumerate([(events.tumbling, "complete"), (events.sliding, "complete"), (events.sessions, "complete")]):
        stream = form(batch(spark, data_dir, glob="events.parquet"))
        got = events.run_once(stream, f"stream_{k}", str(tmp_path / f"c{k}"), mode)
        table = spark.read.parquet(f"{data_dir}/events.parquet")
        want = form(table.withColumn("ts", table["ts"].cast("timestamp")))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    firsts = events.run_once(events.first_events(batch(spark, data_dir, glob="events.parquet"), ["user_id"]), "firsts", str(tmp_path / "f"), "append")
    assert firsts.count() == table.select("user_id").distinct().count()
    state = events.tranches(table, {"tranches": 4, "n": 0}, lambda s, b: s | {"n": s["n"] + b.count()}, lambda s: False)
    assert state["n"] == table.count()
