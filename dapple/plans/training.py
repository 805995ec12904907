"""Queries over nested, drifting and very small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.operators.compaction import compact
from dapple.operators.drift import SchemaDrift
from dapple.operators.flatten import FlatTables
from dapple.runtime import read_table

PERSON = "age_range string, body_type string, gender_presentation string, pose string, skin_tone string"


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(read_table(spark, sf_dir, "tiny_files")).dropped


def p4_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(read_table(spark, sf_dir, "tiny_files")).bins


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bins of each kind hold in all."""
    bins = compact(read_table(spark, sf_dir, "tiny_files")).bins
    return bins.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("files", "bytes", "records")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = FlatTables(read_table(spark, sf_dir, "audit_records"))
    return flat.rows().select("record_id", "child", "person_no", "clothing_no", "pos", "value")


def p6_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FlatTables(read_table(spark, sf_dir, "audit_records")).table("person", PERSON)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SchemaDrift(read_table(spark, sf_dir, "drift_files")).changes()


def p7_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    drift = SchemaDrift(read_table(spark, sf_dir, "drift_files"))
    return drift.table(drift.changes(), "audit")


def p7_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the table of reports, without their fields: none is lost or doubled."""
    drift = SchemaDrift(read_table(spark, sf_dir, "drift_files"))
    return drift.table(drift.changes(), "summary_report").select("stream", "file_seq", "line_no", "record_id")


QUERIES = {"p4_kept": p4_kept, "p7_rows": p7_rows, "p4_found": p4_found, "p4_bins": p4_bins, "p6_found": p6_found, "p6_persons": p6_persons, "p7_found": p7_found, "p7_table": p7_table}


def _texts(x: str) -> str:
    """A list of JSON texts: elements of a list, sorted keys of an object, one value."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN list_transform(list_sort(json_keys({x})), lambda k: to_json(k)) WHEN 'NULL' THEN [] ELSE list_filter([{x}], lambda v: v IS NOT NULL) END"


def _objects(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"


def _leaves(child: str, source: str, x: str, person: str, clothing: str) -> str:
    return f"SELECT record_id, '{child}' AS child, {person} AS person_no, {clothing} AS clothing_no, pos, x->>'$' AS value FROM (SELECT *, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (SELECT *, {_texts(x)} AS l FROM {source})) WHERE regexp_matches(x->>'$', '\\S')"


_PERSONS = f"""WITH whole AS (SELECT record_id, CAST(record AS JSON)->'cohorts' AS c FROM audit_records WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
parts AS (SELECT record_id, CASE WHEN json_type(c->'objects') = 'OBJECT' THEN c->'objects'->'items' ELSE c->'objects' END AS items, CASE WHEN json_type(c->'people') = 'ARRAY' THEN c->'people' ELSE c->'people'->'persons' END AS people FROM whole),
person AS (SELECT * FROM (SELECT record_id, unnest(l) AS p, generate_subscripts(l, 1) AS no FROM (SELECT record_id, {_objects("people")} AS l FROM parts)) WHERE json_type(p) = 'OBJECT')
"""
_PIECES = r"""WITH line AS (SELECT file_id, split_part(file_path, '/frequency/', 1) AS origin, generate_subscripts(string_split(body, chr(10)), 1) AS ln, unnest(string_split(body, chr(10))) AS x FROM tiny_files WHERE kind = 'frequencies' AND body IS NOT NULL),
cells AS (SELECT file_id, origin, ln, list_transform(regexp_extract_all(rtrim(x, chr(13)) || ',', '("(?:[^"]|"")*"|[^,"]*),', 1), lambda v: CASE WHEN starts_with(v, '"') THEN replace(v[2:-2], '""', '"') ELSE v END) AS c FROM line WHERE trim(x, chr(13) || ' ,') <> ''),
headed AS (SELECT *, last_value(CASE WHEN list_sort(list_transform(c, lambda v: trim(v))) @> ['cohort', 'count', 'dimension', 'label'] THEN list_transform(c, lambda v: trim(v)) END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY ln) AS head,
  list_sort(list_transform(c, lambda v: trim(v))) @> ['cohort', 'count', 'dimension', 'label'] AS is_head FROM cells),
frequency AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY ln) AS record_no, to_json([origin, c[list_position(head, 'cohort')], c[list_position(head, 'dimension')], c[list_position(head, 'label')], c[list_position(head, 'count')]])::VARCHAR AS key
  FROM headed WHERE NOT is_head AND len(c) >= len(head)),
audit AS (SELECT file_id, body, trim(body, chr(10) || chr(13) || chr(9) || ' ') AS t FROM tiny_files WHERE kind = 'audit' AND body IS NOT NULL),
cut AS (SELECT file_id, list_filter(list_reverse(range(1, length(t) + 1)), lambda i: t[i] = '}' AND json_valid(t[1:i] || ']')) AS ends, t FROM audit WHERE NOT json_valid(t) AND starts_with(t, '[')),
piece AS (SELECT file_id, 1 AS ln, CAST(t AS JSON) AS j FROM audit WHERE json_valid(t) AND json_type(t) = 'OBJECT'
  UNION ALL SELECT file_id, generate_subscripts(json_extract(t, '$[*]'), 1), unnest(json_extract(t, '$[*]')) FROM audit WHERE json_valid(t) AND json_type(t) = 'ARRAY'
  UNION ALL SELECT file_id, generate_subscripts(json_extract(t[1:ends[1]] || ']', '$[*]'), 1), unnest(json_extract(t[1:ends[1]] || ']', '$[*]')) FROM cut WHERE len(ends) > 0
  UNION ALL SELECT file_id, ln, CAST(x AS JSON) FROM (SELECT file_id, generate_subscripts(string_split(t, chr(10)), 1) AS ln, unnest(string_split(t, chr(10))) AS x FROM audit WHERE NOT json_valid(t) AND NOT starts_with(t, '[')) WHERE json_valid(x)),
numbered AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY ln) AS record_no, j FROM piece WHERE json_type(j) = 'OBJECT'),
document AS (SELECT file_id, record_no, string_agg(n.fullkey || ' ' || n.type || ' ' || coalesce(n.atom->>'$', ''), chr(30) ORDER BY n.fullkey) AS key FROM numbered, json_tree(numbered.j) n GROUP BY ALL),
every AS (SELECT 'f' AS kind, * FROM frequency UNION ALL SELECT 'a', * FROM document)
"""
SQL: dict[str, str] = {
    "p4_found": _PIECES + """SELECT file_id, CAST(record_no AS INTEGER) AS record_no FROM every QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY file_id, record_no) > 1""",
    "p4_kept": _PIECES + """, kept AS (SELECT file_id FROM every QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY file_id, record_no) = 1), n AS (SELECT file_id, count(*) AS n FROM kept GROUP BY ALL)
SELECT kind, count(*) AS files, CAST(sum(n_bytes) AS BIGINT) AS bytes, CAST(coalesce(sum(n), 0) AS BIGINT) AS records FROM tiny_files LEFT JOIN n USING (file_id) GROUP BY ALL""",
    "p7_rows": r"""WITH once AS (SELECT * FROM drift_files WHERE stream IS NOT NULL AND file_seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stream, file_seq ORDER BY file_id) = 1),
line AS (SELECT stream, file_seq, generate_subscripts(string_split(body, chr(10)), 1) AS ln, unnest(string_split(body, chr(10))) AS x FROM once WHERE kind = 'summary_report')
SELECT stream, file_seq, CAST(ln AS INTEGER) AS line_no, coalesce(x->>'$.image_id', x->>'$.report_id') AS record_id FROM line WHERE CASE WHEN json_valid(x) THEN json_type(x) = 'OBJECT' ELSE false END""",
    "p7_found": r"""WITH RECURSIVE once AS (SELECT * FROM drift_files WHERE stream IS NOT NULL AND file_seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stream, file_seq ORDER BY file_id) = 1),
files AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY file_seq) AS idx FROM once),
line AS (SELECT stream, idx, kind, generate_subscripts(string_split(body, chr(10)), 1) AS ln, unnest(string_split(body, chr(10))) AS x FROM files),
rec AS (SELECT stream, idx, kind, ln, CAST(x AS JSON) AS j FROM line WHERE CASE WHEN json_valid(x) THEN json_type(x) = 'OBJECT' ELSE false END),
ids AS (SELECT stream, idx, ln, coalesce(j->>'$.image_id', j->>'$.report_id') AS rid FROM rec WHERE coalesce(j->>'$.image_id', j->>'$.report_id') IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stream, idx, rid ORDER BY ln DESC) = 1),
node AS (SELECT stream, idx, kind, ln, 0 AS el, 0 AS depth, '' AS path, j AS v FROM rec
  UNION ALL SELECT stream, idx, kind, ln, el, depth, 'groups', v FROM (SELECT stream, idx, '' AS kind, ln, generate_subscripts(json_extract(j, '$.groups[*]'), 1) AS el, 0 AS depth, unnest(json_extract(j, '$.groups[*]')) AS v FROM rec WHERE json_type(j->'groups') = 'ARRAY') WHERE json_type(v) = 'OBJECT'
  UNION ALL SELECT stream, idx, kind, ln, el, depth + 1, CASE WHEN path = '' THEN k ELSE path || '.' || k END, json_extract(v, '$."' || k || '"')
  FROM (SELECT *, unnest(json_keys(v)) AS k FROM node WHERE json_type(v) = 'OBJECT' AND NOT (kind = 'summary_report' AND depth = 3 AND starts_with(path, 'attributes.')))),
leaf AS (SELECT stream, idx, ln, el, path AS field, v, CASE json_type(v) WHEN 'BOOLEAN' THEN 1 WHEN 'BIGINT' THEN 2 WHEN 'UBIGINT' THEN 2 WHEN 'HUGEINT' THEN 2 WHEN 'DOUBLE' THEN 3 WHEN 'VARCHAR' THEN 4 WHEN 'OBJECT' THEN 7
    ELSE CASE WHEN len(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) = 'OBJECT')) > 0 THEN 6 WHEN json_array_length(v) > 0 THEN 5 END END AS type
  FROM node WHERE path <> '' AND json_type(v) <> 'NULL' AND NOT (json_type(v) = 'OBJECT' AND NOT (kind = 'summary_report' AND depth = 3 AND starts_with(path, 'attributes.'))) AND NOT (path = 'groups' AND json_type(v) = 'ARRAY')),
has AS (SELECT stream, idx, field, coalesce(max(type), 5) AS type FROM leaf GROUP BY ALL),
added AS (SELECT n.stream, n.idx, n.field FROM has n LEFT JOIN has o ON o.stream = n.stream AND o.idx = n.idx - 1 AND o.field = n.field WHERE o.field IS NULL AND n.idx > 1),
removed AS (SELECT o.stream, o.idx + 1 AS idx, o.field FROM has o JOIN files f ON f.stream = o.stream AND f.idx = o.idx + 1 LEFT JOIN has n ON o.stream = n.stream AND o.idx = n.idx - 1 AND o.field = n.field WHERE n.field IS NULL),
retyped AS (SELECT n.stream, n.idx, n.field FROM has n JOIN has o ON o.stream = n.stream AND o.idx = n.idx - 1 AND o.field = n.field WHERE o.type <> n.type),
cell AS (SELECT l.stream, l.idx, i.rid, l.field, string_agg(el || '=' || CASE WHEN json_type(v) = 'OBJECT' THEN list_sort(list_transform(json_keys(v), lambda k: k || ':' || json_extract(v, '$."' || k || '"')::VARCHAR))::VARCHAR ELSE v::VARCHAR END, chr(30) ORDER BY el) AS v FROM leaf l JOIN ids i USING (stream, idx, ln) GROUP BY ALL),
shared AS (SELECT n.stream, n.idx, n.rid FROM ids n JOIN ids o ON o.stream = n.stream AND o.idx = n.idx - 1 AND o.rid = n.rid),
pair AS (SELECT a.stream, a.idx, r.field AS old_field, a.field AS new_field, s.rid FROM added a JOIN removed r USING (stream, idx) JOIN shared s USING (stream, idx)),
same AS (SELECT p.stream, p.idx, old_field, new_field FROM pair p LEFT JOIN cell o ON o.stream = p.stream AND o.idx = p.idx - 1 AND o.rid = p.rid AND o.field = old_field LEFT JOIN cell n ON n.stream = p.stream AND n.idx = p.idx AND n.rid = p.rid AND n.field = new_field
  GROUP BY ALL HAVING bool_and(o.v IS NOT DISTINCT FROM n.v) AND count(n.v) > 0),
renamed AS (SELECT * FROM same QUALIFY dense_rank() OVER (PARTITION BY stream, idx, new_field ORDER BY old_field) = dense_rank() OVER (PARTITION BY stream, idx, old_field ORDER BY new_field)),
change AS (SELECT stream, idx, 'renamed' AS change, old_field AS field, new_field FROM renamed
  UNION ALL SELECT stream, idx, 'type_changed', field, '' FROM retyped
  UNION ALL SELECT stream, idx, 'added', field, '' FROM added a WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.stream = a.stream AND r.idx = a.idx AND r.new_field = a.field)
  UNION ALL SELECT stream, idx, 'removed', field, '' FROM removed a WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.stream = a.stream AND r.idx = a.idx AND r.old_field = a.field))
SELECT stream, file_seq, change, field, new_field FROM change JOIN files USING (stream, idx)""",
    "p6_found": _PERSONS + f""", garment AS (SELECT * FROM (SELECT record_id, no, unnest(l) AS g, generate_subscripts(l, 1) AS piece FROM (SELECT record_id, no, {_objects("(p->'clothing')")} AS l FROM person)) WHERE json_type(g) = 'OBJECT'),
rows AS (SELECT record_id, 'person' AS child, no AS person_no, 0 AS clothing_no, no AS pos, coalesce(p->>'person_id', '') AS value FROM person
UNION ALL SELECT record_id, 'clothing', no, piece, piece, coalesce(g->>'clothing_garment', '') FROM garment
UNION ALL {_leaves("item", "parts", "items", "0", "0")} UNION ALL {_leaves("accessory", "person", "(p->'accessories')", "no", "0")} UNION ALL {_leaves("activity", "person", "(p->'activities')", "no", "0")}
UNION ALL {_leaves("clothing_color", "garment", "(g->'clothing_color')", "no", "piece")})
SELECT record_id, child, CAST(person_no AS INTEGER) AS person_no, CAST(clothing_no AS INTEGER) AS clothing_no, CAST(pos AS INTEGER) AS pos, value FROM rows""",
    "p6_persons": _PERSONS + """SELECT record_id, concat(record_id, '/person:', no) AS pk, CAST(record_id AS VARCHAR) AS parent_pk, CAST(no AS INTEGER) AS person_no, 0 AS clothing_no, CAST(no AS INTEGER) AS pos, coalesce(p->>'person_id', '') AS value,
  p->>'age_range' AS age_range, p->>'body_type' AS body_type, p->>'gender_presentation' AS gender_presentation, p->>'pose' AS pose, p->>'skin_tone' AS skin_tone FROM person""",
}
