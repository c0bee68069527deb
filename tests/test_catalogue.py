import datetime
from pathlib import Path

import duckdb
import pytest

from tessella.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def test_every_query_without_sql_has_its_own_test():
    text = (Path(__file__).parent / "test_queries_without_sql.py").read_text()
    assert all(f'"{name}"' in text for name in set(catalogue.QUERIES) - set(catalogue.SQL))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = [tuple(map(plain, r)) for r in frame.select(columns).collect()]
    relation = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL[name]})")
    want = [tuple(map(plain, r)) for r in relation.fetchall()]
    assert want and sorted(map(str, got)) == sorted(map(str, want))
