"""Queries against their SQL on the smallest tables, where those are at hand, and under other partitionings."""

import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import pytest

from lodemill.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VARIED = {"search_files", "connector_evidence", "resolved_references", "build_context", "event_gaps", "projection_freshness", "brief_fit", "packed_chunks", "interval_speakers", "interval_boundaries", "representation_cache", "files_latest", "last_view", "p5_state", "workspace_brief", "change_set_compensation", "graph_rebuilt"}
here = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, dt.datetime):
        return str(value.replace(tzinfo=None))
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@here
@pytest.mark.parametrize("name", list(registry.SQL))
def test_equal_to_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    truth = db.sql(registry.SQL[name])
    want = rows(truth.columns, truth.fetchall())
    for partitions in ("1", "7") if name in VARIED else ("3",):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = registry.QUERIES[name](spark, DATA)
        assert sorted(df.columns) == sorted(truth.columns)
        assert rows(df.columns, df.collect()) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_core_stands_alone():
    code = "import sys; sys.modules['lodemill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p4_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
