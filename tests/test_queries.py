"""Every registered query against its SQL, in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) if isinstance(v, int | float) else str(v)
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got)
