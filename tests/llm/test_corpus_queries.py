"""The corpus queries on the smallest tables; beside their SQL where there is any."""

import os
from collections import Counter

import pytest

from quillmere.llm import queries

BASE = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["post_id", "field_name", "source_record_id"], "p4_found": ["source_record_id", "field_name", "entity_type"], "p5_found": ["source_record_id_a", "source_record_id_b"],
    "p6_found": ["source_record_id", "field_name", "restored_sha256"], "p7_found": ["keep_id", "source_record_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "band"],
}

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, BASE)
    assert df.columns == COLUMNS.get(name, df.columns)
    got = Counter(tuple(r) for r in df.collect())
    if name.endswith("_found"):
        assert max(got.values(), default=1) == 1
    if name in queries.ORACLE:
        import duckdb

        con = duckdb.connect()
        for table in os.listdir(BASE):
            con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{BASE}/{table}'")
        result = con.execute(queries.ORACLE[name])
        order = [[c[0] for c in result.description].index(c) for c in df.columns]
        assert got == Counter(tuple(r[i] for i in order) for r in result.fetchall())
