"""Every core query beside its SQL on the smallest tables."""

import os
from collections import Counter

import pytest

from quillmere.plans import drift_queries, nested_queries, source_queries, table_queries

BASE = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
PARTS = (table_queries, source_queries, nested_queries, drift_queries)
QUERIES = {n: q for part in PARTS for n, q in part.QUERIES.items()}
ORACLE = {n: q for part in PARTS for n, q in part.ORACLE.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(BASE):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{BASE}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, BASE)
    columns = sorted(df.columns)
    got = Counter(repr([r[c] for c in columns]) for r in df.collect())
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        want = Counter(repr([dict(zip(names, r))[c] for c in columns]) for r in result.fetchall())
        assert got == want
    else:
        assert got


def test_retained_errors_stop_at_the_cap(spark, tmp_path):
    import duckdb

    rows = [(k, 1 + (k > 130), (7 * k) % 131, "failed" if k % 3 else "partial") for k in range(140)] + [(900, 1, None, "failed"), (901, 1, 5, "parsed")]
    schema = "source_record_id long, source_file_id long, record_index long, parse_status string"
    spark.createDataFrame(rows + rows[:9], schema).write.parquet(f"{tmp_path}/source_records.parquet")
    got = Counter((r.source_file_id, r.record_index, r.parse_status) for r in QUERIES["retained_errors"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW source_records AS SELECT * FROM '{tmp_path}/source_records.parquet/*.parquet'")
    assert got == Counter(con.execute(ORACLE["retained_errors"]).fetchall())
    assert sum(n for (f, _, _), n in got.items() if f == 1) == 100 and (1, None, "failed") in got and max(i for f, i, _ in got if f == 1 and i is not None) == 98


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.queries()) >= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
