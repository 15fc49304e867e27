"""Queries of problem 3 (schemas that drift between files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators.schema_drift import changes, consistent_table
from quillmere.session import keep, load


def _files(spark: SparkSession, base: str) -> DataFrame:
    key = F.when(F.col("source_kind") == "reel", "fbid").otherwise("uri")
    group = F.to_json(F.struct("profile_id", "source_kind"))
    return load(spark, base, "export_files").select(F.col("export_file_id").alias("file"), group.alias("group"), F.col("source_kind").alias("kind"), "exported_at", key.alias("key_field"), "content")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Every change of a readable file against the readable file before it."""
    return changes(_files(spark, base)).select(F.col("file").alias("export_file_id"), F.col("kind").alias("change_kind"), F.col("path").alias("field_path"))


def p3_changes(spark: SparkSession, base: str) -> DataFrame:
    """Every change with its step of the edit script, both paths and both types."""
    columns = [F.col("file").alias("export_file_id"), F.col("kind").alias("change_kind"), F.col("path").alias("field_path"), "old_path", "step", "old_type", "new_type"]
    return changes(_files(spark, base)).select(*columns)


def p3_records(spark: SparkSession, base: str) -> DataFrame:
    """All records of all readable files under one naming and one typing of fields, as JSON objects."""
    files = _files(spark, base)
    table = consistent_table(files, keep(changes(files)))
    return table.select(F.col("file").alias("export_file_id"), F.col("kind").alias("source_kind"), "record_key", F.col("typed").alias("fields"))


#: Renames by the agreement of values alone, where each path agrees best with one other; the operator finds them by its edit scripts.
P3_FOUND_SQL = r"""
WITH f AS (SELECT DISTINCT export_file_id, profile_id, source_kind, exported_at, content AS j FROM export_files WHERE json_valid(content)),
o AS (SELECT export_file_id, lag(export_file_id) OVER (PARTITION BY profile_id, source_kind ORDER BY exported_at NULLS FIRST, export_file_id) AS before FROM f),
n AS (SELECT export_file_id, source_kind, t.id, t.type, t.atom, t.fullkey, json_type(j) AS root FROM f, json_tree(f.j) AS t),
w AS (SELECT export_file_id, regexp_extract(fullkey, '^\$\."?([^".\[]+)"?$', 1) AS wrapper FROM n WHERE root = 'OBJECT' AND type = 'ARRAY' AND regexp_matches(fullkey, '^\$\."?[^".\[]+"?$')),
s AS (SELECT export_file_id, id, regexp_extract(fullkey, '^\$(?:\."?[^".\[]+"?)?\[(\d+)\]', 0) AS record, regexp_replace(regexp_replace(fullkey, '^\$(?:\."?[^".\[]+"?)?\[\d+\]\.', ''), '\[\d+\]', '[]', 'g') AS path,
    CASE WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer' WHEN type = 'DOUBLE' THEN 'fraction' ELSE 'string' END AS kind, atom,
    CASE source_kind WHEN 'reel' THEN 'fbid' ELSE 'uri' END AS key_field
  FROM n WHERE atom IS NOT NULL AND type <> 'NULL' AND regexp_matches(fullkey, '^\$(?:\."?[^".\[]+"?)?\[\d+\]\.') AND (root = 'ARRAY' OR regexp_matches(fullkey, '^\$\."?[^".\[]+"?\['))),
c AS (SELECT export_file_id, path, kind, count(*) AS times FROM s GROUP BY 1, 2, 3),
types AS (SELECT export_file_id, path, CASE WHEN list_sort(list(kind)) = ['fraction', 'integer'] THEN 'fraction' ELSE arg_min(kind, (-times, kind)) END AS kind FROM c GROUP BY 1, 2),
keyed AS (SELECT export_file_id, atom ->> '$' AS k, arg_max(record, id) AS record FROM s WHERE path = key_field GROUP BY 1, 2),
v AS (SELECT export_file_id, k, path, list((kind, CAST(atom AS VARCHAR)) ORDER BY id) AS v FROM s JOIN keyed USING (export_file_id, record) GROUP BY 1, 2, 3),
pairs AS (SELECT export_file_id, before FROM o WHERE before IS NOT NULL),
gone AS (SELECT p.export_file_id, before, t.path, t.kind FROM pairs p JOIN types t ON t.export_file_id = before WHERE NOT EXISTS (SELECT 1 FROM types x WHERE x.export_file_id = p.export_file_id AND x.path = t.path)),
come AS (SELECT p.export_file_id, before, t.path, t.kind FROM pairs p JOIN types t USING (export_file_id) WHERE NOT EXISTS (SELECT 1 FROM types x WHERE x.export_file_id = before AND x.path = t.path)),
common AS (SELECT p.export_file_id, before, a.k FROM pairs p JOIN keyed a ON a.export_file_id = before JOIN keyed b ON b.export_file_id = p.export_file_id AND a.k = b.k),
old_v AS (SELECT g.export_file_id, g.path, common.k, v.v FROM gone g JOIN common USING (export_file_id, before) JOIN v ON v.export_file_id = g.before AND v.path = g.path AND v.k = common.k),
new_v AS (SELECT g.export_file_id, g.path, common.k, v.v FROM come g JOIN common USING (export_file_id, before) JOIN v ON v.export_file_id = g.export_file_id AND v.path = g.path AND v.k = common.k),
old_n AS (SELECT export_file_id, path, count(*) AS n FROM old_v GROUP BY 1, 2), new_n AS (SELECT export_file_id, path, count(*) AS n FROM new_v GROUP BY 1, 2),
met AS (SELECT a.export_file_id, a.path AS p, b.path AS q, count(*) AS n, count(DISTINCT a.v) AS d, bool_and(a.v = b.v) AS ok FROM old_v a JOIN new_v b USING (export_file_id, k) GROUP BY 1, 2, 3),
agree AS (SELECT met.* FROM met JOIN old_n ON old_n.export_file_id = met.export_file_id AND old_n.path = p JOIN new_n ON new_n.export_file_id = met.export_file_id AND new_n.path = q WHERE ok AND 2 * met.n >= greatest(old_n.n, new_n.n)),
renamed AS (SELECT * FROM agree QUALIFY row_number() OVER (PARTITION BY export_file_id, p ORDER BY least(d, 3) DESC, n DESC, q) = 1 AND row_number() OVER (PARTITION BY export_file_id, q ORDER BY least(d, 3) DESC, n DESC, p) = 1),
lost AS (SELECT p.export_file_id, wrapper, row_number() OVER (PARTITION BY p.export_file_id ORDER BY wrapper) AS i FROM pairs p JOIN w ON w.export_file_id = before WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.export_file_id = p.export_file_id AND x.wrapper = w.wrapper)),
won AS (SELECT p.export_file_id, wrapper, row_number() OVER (PARTITION BY p.export_file_id ORDER BY wrapper) AS i FROM pairs p JOIN w USING (export_file_id) WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.export_file_id = before AND x.wrapper = w.wrapper))
SELECT export_file_id, 'renamed' AS change_kind, q AS field_path FROM renamed
UNION ALL SELECT export_file_id, 'removed', path FROM gone WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.export_file_id = gone.export_file_id AND r.p = gone.path)
UNION ALL SELECT export_file_id, 'added', path FROM come WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.export_file_id = come.export_file_id AND r.q = come.path)
UNION ALL SELECT p.export_file_id, 'retyped', a.path FROM pairs p JOIN types a ON a.export_file_id = before JOIN types b ON b.export_file_id = p.export_file_id AND b.path = a.path WHERE a.kind <> b.kind
UNION ALL SELECT export_file_id, CASE WHEN a.wrapper IS NULL THEN 'added' WHEN b.wrapper IS NULL THEN 'removed' ELSE 'renamed' END, '$.' || coalesce(b.wrapper, a.wrapper) FROM lost a FULL JOIN won b USING (export_file_id, i)
"""

QUERIES = {"p3_found": p3_found, "p3_changes": p3_changes, "p3_records": p3_records}
ORACLE = {"p3_found": P3_FOUND_SQL}
