"""Every query over tables without rows, and over tables with rows of nothing but nulls."""

from pathlib import Path

import pytest

from lodemill.plans import registry

DATA = Path("/root/testdata/sf0.001")


def write_tables(at: Path, nulls: int) -> str:
    import pyarrow as pa
    import pyarrow.parquet as pq

    for f in DATA.glob("*.parquet"):
        t = pq.read_table(f)
        schema = pa.schema([pa.field(x.name, x.type) for x in t.schema])
        rows = pa.table([pa.nulls(nulls, x.type) for x in schema], schema=schema)
        pq.write_table(pa.concat_tables([t.slice(0, nulls).cast(schema), rows]), at / f.name)
    return str(at)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("nulls", [0, 4])
def test_core_queries(spark, tmp_path, nulls):
    tables = write_tables(tmp_path, nulls)
    for query in registry.QUERIES.values():
        query(spark, tables).collect()
