"""Queries of the record-quality operators: orphans, small files, drift and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.functions.naming import quoted
from profloom.operators import compaction, drift, orphans, rejects
from profloom.plans import Query, table
from profloom.runtime import cut_lineage, shared_path, shuffle_partitions


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.profile_orphans(*(table(spark, sf_dir, t) for t in ("image", "nuclei", "ph3")))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p1_found(spark, sf_dir))


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of ph3 to nuclei whose key may be null in part, under each match semantics."""
    key = ["TableNumber", "ImageNumber", "ObjectNumber"]
    nuclei, ph3 = table(spark, sf_dir, "nuclei"), table(spark, sf_dir, "ph3")
    known = orphans.parent_states(nuclei.where("TableNumber IS NOT NULL AND ImageNumber IS NOT NULL AND ObjectNumber IS NOT NULL"), key, "loaded_at", "removed_at")
    marks = orphans.earliest_children(ph3, key, ["Parent_Nuclei", "Location_Center_X"], "loaded_at").select(
        F.col("TableNumber").alias("t"), F.col("ImageNumber").alias("i"), F.col("ObjectNumber").alias("o"), F.col("loaded_at").alias("at"),
        F.when(F.col("Parent_Nuclei") > 0, F.col("Parent_Nuclei")).alias("ref"),
        # where the place of an object isn't known, neither is its image
        F.when(F.col("Location_Center_X").isNotNull() & ~F.isnan("Location_Center_X"), F.col("ImageNumber")).alias("image"),
    )
    found = None
    for match in orphans.MATCHES:
        own = orphans.find_orphans(marks, known, [("t", "TableNumber"), ("image", "ImageNumber"), ("ref", "ObjectNumber")], "at", match)
        own = own.select(F.lit(match).alias("match"), F.col("t").alias("table_number"), F.col("i").alias("image_number"), F.col("o").alias("object_number"), "state")
        found = own if found is None else found.unionByName(own)
    return found


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.dropped_records(compaction.small_file_records(table(spark, sf_dir, "nuclei_file")))


def p2_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated table, read back from the files that the published manifest names."""
    out = shared_path(spark, "compacted")
    records = cut_lineage(compaction.small_file_records(table(spark, sf_dir, "nuclei_file")))
    compaction.publish(records, out, shuffle_partitions(spark))
    return compaction.read_published(spark, out)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "image_file")).select("file_id", "field_name", "change")


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf_dir, "image_file"))


def p4_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each column of the consistent table its type and how many values it holds."""
    df = drift.consistent_table(table(spark, sf_dir, "image_file")).drop("file_id")
    counted = df.agg(*(F.count(F.col(quoted(n))).alias(n) for n in df.columns))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type"), F.col(quoted(n)).alias("n_values")) for n, t in df.dtypes)))
    return counted.select(rows.alias("c")).select("c.*")


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, rejects.Layout]:
    layout = rejects.read_layout(table(spark, sf_dir, "raw_field"), table(spark, sf_dir, "experiment_key"))
    return rejects.split_rows(table(spark, sf_dir, "raw_row"), layout), layout


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(_raw(spark, sf_dir)[0])


def p5_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.loaded(*_raw(spark, sf_dir), "image")


def p5_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rejects.loaded(*_raw(spark, sf_dir), "experiment")
    return rows.select("raw_id", F.col("Key").alias("setting"), F.col("Value").alias("setting_value"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_report, p1_matches, p2_found, p2_compact, p4_found, p4_table, p4_columns, p5_found, p5_image, p5_experiment)
}

_P1 = """
WITH marks AS (
  SELECT TableNumber AS t, ImageNumber AS i, ObjectNumber AS o, min(loaded_at) AS seen, arg_min(Parent_Nuclei, loaded_at) AS ref
  FROM ph3 GROUP BY ALL),
objects AS (
  SELECT TableNumber AS t, ImageNumber AS i, ObjectNumber AS o, min(loaded_at) FILTER (removed_at IS NULL) AS live
  FROM nuclei GROUP BY ALL),
images AS (
  SELECT TableNumber AS t, ImageNumber AS i, min(loaded_at) FILTER (removed_at IS NULL) AS live FROM image GROUP BY ALL),
refs AS (
  SELECT 'ph3' AS child_name, 'image' AS parent_name, m.t, m.i, m.o, m.seen, p.t IS NOT NULL AS there, p.live
  FROM marks m LEFT JOIN images p ON m.t = p.t AND m.i = p.i
  UNION ALL
  SELECT 'nuclei', 'image', m.t, m.i, m.o, m.live, p.t IS NOT NULL, p.live
  FROM objects m LEFT JOIN images p ON m.t = p.t AND m.i = p.i WHERE m.live IS NOT NULL
  UNION ALL
  SELECT 'ph3', 'nuclei', m.t, m.i, m.o, m.seen, p.t IS NOT NULL, p.live
  FROM marks m LEFT JOIN objects p ON m.t = p.t AND m.i = p.i AND m.ref = p.o WHERE m.ref <> 0),
found AS (
  SELECT child_name, parent_name, t AS table_number, i AS image_number, o AS object_number,
    CASE WHEN NOT there THEN 'missing' WHEN live IS NULL THEN 'removed' WHEN live > seen THEN 'late' END AS state,
    strftime(seen, '%Y-%m') AS period
  FROM refs)
"""

_P2 = r"""
WITH files AS (
  SELECT file_id, table_number, string_split(regexp_replace(regexp_replace(coalesce(body, ''), '^\x{FEFF}', ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines
  FROM nuclei_file),
numbered AS (SELECT file_id, table_number, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM files),
filled AS (SELECT *, string_split(replace(line, '"', ''), ',') AS f FROM numbered WHERE trim(line, ' ' || chr(9)) <> ''),
heads AS (SELECT file_id, min(line_no) AS head_no, arg_min(f, line_no) AS h FROM filled GROUP BY file_id),
records AS (
  SELECT file_id, line_no, table_number,
    try_cast(f[list_position(h, 'ImageNumber')] AS DOUBLE) AS i, try_cast(f[list_position(h, 'ObjectNumber')] AS DOUBLE) AS o,
    try_cast(f[list_position(h, 'c0')] AS DOUBLE) AS c
  FROM filled JOIN heads USING (file_id) WHERE line_no > head_no AND len(f) >= len(h))
"""

_P4 = r"""
WITH RECURSIVE f AS (
  SELECT file_id, series_id, row_number() OVER (PARTITION BY series_id ORDER BY exported_at, file_id) AS n,
    string_split(regexp_replace(regexp_replace(coalesce(body, ''), '^\x{FEFF}', ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines
  FROM image_file),
l AS (SELECT file_id, series_id, n, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM f),
c AS (
  SELECT file_id, series_id, n, k, list_transform(regexp_extract_all(',' || line, ',("([^"]|"")*"|[^",]*)', 1),
    lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS v
  FROM l WHERE line <> ''),
h AS (SELECT file_id, min(k) AS head, arg_min(v, k) AS names FROM c GROUP BY file_id),
fields AS (SELECT DISTINCT file_id, series_id, n, unnest(names) AS field FROM f JOIN h USING (file_id)),
raw_cells AS (
  SELECT c.file_id, series_id, n, unnest(names) AS field, unnest(list_resize(v, len(names))) AS x, v[list_position(names, 'ImageNumber')] AS image
  FROM c JOIN h USING (file_id) WHERE k > head),
cells AS (
  SELECT *, CASE WHEN trim(coalesce(x, '')) = '' THEN 0 WHEN regexp_full_match(x, '-?[0-9]+') THEN 1
      WHEN regexp_full_match(x, '-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]') THEN 2 ELSE 3 END AS kind
  FROM raw_cells),
kinds AS (SELECT fields.*, coalesce(max(kind), 0) AS kind FROM fields LEFT JOIN cells USING (file_id, series_id, n, field) GROUP BY ALL),
texts AS (
  SELECT series_id, n, field, image, any_value(CASE WHEN kind = 0 THEN '' WHEN kind < 3 THEN 'n' || CAST(x AS DOUBLE) ELSE 't' || x END) AS text
  FROM cells GROUP BY ALL),
came AS (SELECT a.file_id, a.series_id, a.n, a.field FROM fields a WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM fields b WHERE b.series_id = a.series_id AND b.n = a.n - 1 AND b.field = a.field)),
gone AS (SELECT a.file_id, a.series_id, a.n, b.field FROM f a JOIN fields b ON b.series_id = a.series_id AND b.n = a.n - 1
  WHERE NOT EXISTS (SELECT 1 FROM fields d WHERE d.series_id = a.series_id AND d.n = a.n AND d.field = b.field)),
renames AS (
  SELECT came.file_id, came.series_id, came.n, came.field AS new, gone.field AS old
  FROM came JOIN gone USING (file_id, series_id, n)
  JOIN texts x ON x.series_id = came.series_id AND x.n = came.n AND x.field = came.field
  JOIN texts y ON y.series_id = came.series_id AND y.n = came.n - 1 AND y.field = gone.field AND y.image = x.image
  GROUP BY ALL HAVING bool_and(x.text = y.text) AND bool_or(x.text <> '')),
links AS (
  SELECT k.*, coalesce(r.old, CASE WHEN k.n > 1 AND came.field IS NULL THEN k.field END) AS before
  FROM kinds k LEFT JOIN renames r ON r.file_id = k.file_id AND r.new = k.field LEFT JOIN came ON came.file_id = k.file_id AND came.field = k.field),
walk(file_id, series_id, n, field, kind, known, retyped) AS (
  SELECT file_id, series_id, n, field, kind, kind, false FROM links WHERE before IS NULL
  UNION ALL
  SELECT a.file_id, a.series_id, a.n, a.field, a.kind, CASE WHEN a.kind > 0 THEN a.kind ELSE w.known END, a.kind > 0 AND w.known > 0 AND a.kind <> w.known
  FROM walk w JOIN links a ON a.series_id = w.series_id AND a.n = w.n + 1 AND a.before = w.field)
SELECT file_id, new AS field_name, 'renamed' AS change FROM renames
UNION ALL SELECT file_id, field, 'added' FROM came WHERE (file_id, field) NOT IN (SELECT (file_id, new) FROM renames)
UNION ALL SELECT file_id, field, 'removed' FROM gone WHERE (file_id, field) NOT IN (SELECT (file_id, old) FROM renames)
UNION ALL SELECT file_id, field, 'retyped' FROM walk WHERE retyped"""

_FIELD = r'("([^"]|"")*"|[^",\r\n]*)'

_P5 = rf"""
WITH cleaned AS (SELECT raw_id, file_kind, regexp_replace(raw, '\r$', '') AS r FROM raw_row),
quoted AS (SELECT *, regexp_full_match(r, '{_FIELD}(,{_FIELD})*') AS fine FROM cleaned),
cut AS (SELECT *, CASE WHEN fine THEN list_transform(regexp_extract_all(',' || r, ',{_FIELD}', 1),
    lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS f FROM quoted),
widths AS (SELECT file_kind, count(*) AS n FROM raw_field GROUP BY file_kind),
counted AS (SELECT c.*, coalesce(len(f) = n, false) AS whole FROM cut c LEFT JOIN widths w ON c.file_kind = w.file_kind),
cells AS (
  SELECT raw_id, f[d.field_no] AS x, may_be_blank, CASE WHEN d.value_form = 'by_key' THEN coalesce(k.value_form, 'text') ELSE d.value_form END AS form
  FROM counted c JOIN raw_field d ON c.file_kind = d.file_kind LEFT JOIN experiment_key k ON c.f[1] = k.key_name WHERE fine AND whole),
wrong AS (
  SELECT DISTINCT raw_id FROM cells WHERE CASE
    WHEN x = '' THEN NOT may_be_blank
    WHEN regexp_matches(x, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{{FFFD}}]') THEN true
    WHEN form = 'whole' THEN NOT (regexp_full_match(x, '-?[0-9]+') AND try_cast(x AS BIGINT) IS NOT NULL)
    WHEN form = 'number' THEN NOT regexp_full_match(x, '-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]')
    WHEN form = 'version' THEN NOT regexp_full_match(x, '[0-9]+(\.[0-9]+){{1,3}}')
    WHEN form = 'channel' THEN x NOT IN ('Grayscale', 'Color')
    WHEN form = 'moment' THEN NOT (regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')
      AND x >= '0001' AND substr(x, 12, 2) < '24' AND try_cast(x AS TIMESTAMP) IS NOT NULL)
    ELSE false END),
reasons AS (
  SELECT raw_id, CASE WHEN NOT fine THEN 'quoting' WHEN NOT whole THEN 'columns' WHEN raw_id IN (SELECT raw_id FROM wrong) THEN 'value' END AS reason
  FROM counted)
"""

SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT * FROM found WHERE state IS NOT NULL",
    "p1_report": _P1 + "SELECT child_name, parent_name, state, period, count(*) AS n_orphans FROM found WHERE state IS NOT NULL GROUP BY ALL",
    "p1_matches": """
WITH marks AS (
  SELECT t, i, o, seen, CASE WHEN p > 0 THEN p END AS ref, CASE WHEN x IS NOT NULL AND CAST(x AS VARCHAR) <> 'nan' THEN i END AS image
  FROM (SELECT TableNumber AS t, ImageNumber AS i, ObjectNumber AS o, min(loaded_at) AS seen, arg_min_null(Parent_Nuclei, loaded_at) AS p, arg_min_null(Location_Center_X, loaded_at) AS x FROM ph3 GROUP BY ALL)),
objects AS (
  SELECT TableNumber AS t, ImageNumber AS i, ObjectNumber AS o, min(loaded_at) FILTER (removed_at IS NULL) AS live FROM nuclei
  WHERE TableNumber IS NOT NULL AND ImageNumber IS NOT NULL AND ObjectNumber IS NOT NULL GROUP BY ALL),
parents AS (
  SELECT 7 AS mask, t, i, o, live FROM objects UNION ALL SELECT 6, t, i, NULL, min(live) FROM objects GROUP BY t, i UNION ALL SELECT 5, t, NULL, o, min(live) FROM objects GROUP BY t, o
  UNION ALL SELECT 3, NULL, i, o, min(live) FROM objects GROUP BY i, o UNION ALL SELECT 4, t, NULL, NULL, min(live) FROM objects GROUP BY t
  UNION ALL SELECT 2, NULL, i, NULL, min(live) FROM objects GROUP BY i UNION ALL SELECT 1, NULL, NULL, o, min(live) FROM objects GROUP BY o),
refs AS (SELECT *, 4 * CAST(t IS NOT NULL AS INTEGER) + 2 * CAST(image IS NOT NULL AS INTEGER) + CAST(ref IS NOT NULL AS INTEGER) AS mask FROM marks),
states AS (
  SELECT r.*, CASE WHEN p.mask IS NULL THEN 'missing' WHEN live IS NULL THEN 'removed' WHEN live > seen THEN 'late' END AS state
  FROM refs r LEFT JOIN parents p ON r.mask = p.mask AND r.t IS NOT DISTINCT FROM p.t AND r.image IS NOT DISTINCT FROM p.i AND r.ref IS NOT DISTINCT FROM p.o WHERE r.mask > 0)
SELECT 'simple' AS match, t AS table_number, i AS image_number, o AS object_number, state FROM states WHERE mask = 7 AND state IS NOT NULL
UNION ALL SELECT 'partial', t, i, o, state FROM states WHERE state IS NOT NULL
UNION ALL SELECT 'full', t, i, o, CASE WHEN mask < 7 THEN 'missing' ELSE state END FROM states WHERE mask < 7 OR state IS NOT NULL""",
    "p2_found": _P2 + "SELECT file_id, line_no FROM records QUALIFY row_number() OVER (PARTITION BY table_number, i, o, c ORDER BY file_id, line_no) > 1",
    "p2_compact": _P2 + "SELECT DISTINCT table_number, i AS image_number, o AS object_number, c AS c0 FROM records",
    "p4_found": _P4,
    "p4_columns": _P4[: _P4.index("texts AS (")].rstrip().removesuffix(",") + """
SELECT min(field) AS column_name, CASE coalesce(max(c.kind), 0) WHEN 1 THEN 'bigint' WHEN 2 THEN 'double' ELSE 'string' END AS data_type, count(*) FILTER (c.kind > 0) AS n_values
FROM fields LEFT JOIN cells c USING (file_id, series_id, n, field) GROUP BY lower(field)""",
    "p5_found": _P5 + "SELECT raw_id, reason FROM reasons WHERE reason IS NOT NULL",
    "p5_image": _P5 + """
SELECT raw_id, CAST(nullif(f[1], '') AS BIGINT) AS ImageNumber, nullif(f[2], '') AS Metadata_Plate, nullif(f[3], '') AS Metadata_Well,
  CAST(nullif(f[4], '') AS BIGINT) AS Channel_DNA, CAST(nullif(f[5], '') AS DOUBLE) AS Count_Cells, CAST(nullif(f[6], '') AS DOUBLE) AS ExecutionTime_01Images,
  nullif(f[7], '') AS FileName_DNA, CAST(nullif(f[8], '') AS TIMESTAMP) AS Acquired_At
FROM counted JOIN reasons USING (raw_id) WHERE reason IS NULL AND file_kind = 'image'""",
    "p5_experiment": _P5 + """
SELECT raw_id, nullif(f[1], '') AS setting, nullif(f[2], '') AS setting_value
FROM counted JOIN reasons USING (raw_id) WHERE reason IS NULL AND file_kind = 'experiment'""",
}
