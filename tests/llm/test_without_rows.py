import sys
from pathlib import Path

import pytest

from lodemill.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from test_empty_tables import DATA, write_tables  # noqa: E402


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("nulls", [0, 4])
def test_queries(spark, tmp_path, nulls):
    tables = write_tables(tmp_path, nulls)
    for query in queries.QUERIES.values():
        query(spark, tables).collect()
