"""Queries of the general problems: busy periods and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavemill.operators.nested import CHILD_LISTS, CONTENT_KEYS, metadata_children, metadata_libraries, metadata_projects
from wavemill.operators.occupancy import band_occupancy
from wavemill.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return band_occupancy(table(spark, folder, "annotations"), table(spark, folder, "captures"), table(spark, folder, "bands"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return metadata_children(table(spark, folder, "project_metadata"))


def p5_projects(spark: SparkSession, folder: str) -> DataFrame:
    return metadata_projects(table(spark, folder, "project_metadata"))


def p5_libraries(spark: SparkSession, folder: str) -> DataFrame:
    return metadata_libraries(table(spark, folder, "project_metadata"))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_projects": p5_projects, "p5_libraries": p5_libraries}

_P1 = """
WITH c AS (SELECT stem, max(n_samples) AS n FROM captures GROUP BY stem),
i AS (
  SELECT DISTINCT a.stem, b.band_id, c.n, greatest(a.sample_start, 0) AS s,
         CASE WHEN coalesce(a.sample_count, 0) = 0 THEN c.n ELSE least(a.sample_start + a.sample_count, c.n) END AS e
  FROM annotations a JOIN c ON a.stem = c.stem JOIN bands b
    ON least(a.freq_lower_hz, a.freq_upper_hz) < b.band_upper_hz AND greatest(a.freq_lower_hz, a.freq_upper_hz) > b.band_lower_hz
  WHERE a.freq_lower_hz IS NOT NULL AND a.freq_upper_hz IS NOT NULL AND NOT isnan(a.freq_lower_hz) AND NOT isnan(a.freq_upper_hz)
    AND a.sample_start IS NOT NULL AND coalesce(a.sample_count, 0) >= 0
),
m AS (SELECT *, max(e) OVER (PARTITION BY stem, band_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE s < e),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY stem, band_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
busy AS (SELECT stem, band_id, n, k, min(s) AS s, max(e) AS e FROM g GROUP BY ALL),
around AS (SELECT *, lag(e, 1, 0) OVER w AS before, lead(s) OVER w AS after FROM busy WINDOW w AS (PARTITION BY stem, band_id ORDER BY s))
SELECT stem, band_id, 'busy' AS seg_kind, s AS seg_start, e AS seg_stop FROM busy
UNION ALL SELECT stem, band_id, 'gap', before, s FROM around WHERE before < s
UNION ALL SELECT stem, band_id, 'gap', e, n FROM around WHERE after IS NULL AND e < n
"""

#: Entries with content, by number, and the value of an element: text, or a number, or what an object has under a key.
_ENTRY = f"""r AS (SELECT record_id, arg_min(raw_json, (ingested_at, raw_json)) AS t FROM project_metadata WHERE record_id IS NOT NULL GROUP BY 1),
j AS (SELECT record_id, TRY_CAST(t AS JSON) AS j FROM r WHERE t IS NOT NULL),
l AS (SELECT record_id, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [j] END AS l FROM j WHERE j IS NOT NULL),
e AS (SELECT record_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS entry_no FROM l),
c AS (SELECT record_id, CAST(entry_no AS INT) AS entry_no, k AS content, json_extract(e, '$.' || k) AS x FROM e, (SELECT unnest({CONTENT_KEYS!r}) AS k) WHERE json_type(e) = 'OBJECT' AND json_exists(e, '$.' || k))"""


def _text(c: str) -> str:
    return f"nullif(regexp_replace(CASE WHEN json_type({c}) = 'VARCHAR' THEN json_extract_string({c}, '$') WHEN json_type({c}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST({c} AS VARCHAR) END, '^[\\s\\p{{Z}}\\x{{FEFF}}]+|[\\s\\p{{Z}}\\x{{FEFF}}]+$', '', 'g'), '')"


def _elements(c: str) -> str:
    return f"CASE coalesce(json_type({c}), 'NULL') WHEN 'ARRAY' THEN CAST({c} AS JSON[]) WHEN 'NULL' THEN [] ELSE [{c}] END"


_P5 = f"""WITH {_ENTRY}, a AS ({" UNION ALL ".join(f"SELECT record_id, entry_no, content, '{n}' AS child_kind, '{key}' AS key, json_extract(x, '$.{'.'.join(at)}') AS v FROM c" for n, (at, key) in CHILD_LISTS.items())}),
b AS (SELECT * EXCLUDE (v), {_elements('v')} AS v FROM a WHERE v IS NOT NULL),
d AS (SELECT * EXCLUDE (v), unnest(v) AS v, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos FROM b),
o AS (SELECT *, CASE WHEN json_type(v) = 'OBJECT' THEN json_extract(v, '$.' || key) ELSE v END AS own FROM d),
f AS (SELECT record_id, entry_no, child_kind, pos, {_text('own')} AS child_value, list_position({CONTENT_KEYS!r}, content) AS rank FROM o)
SELECT record_id, entry_no, child_kind, pos, child_value FROM f WHERE child_value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id, entry_no, child_kind, pos ORDER BY rank) = 1"""

#: The same as a common table to go on from.
_P5_ROWS = "WITH p5 AS (" + _P5 + ")"

_PLACES = "coalesce(len({}), 0)"
_P5_PROJECTS = f"""WITH {_ENTRY}, f AS (SELECT *, json_extract(x, '$.name') AS a, json_extract(x, '$.version') AS b, json_extract(x, '$.holoscan_sdk.minimum_required_version') AS m, json_extract(x, '$.authors') AS authors, json_extract(x, '$.tags') AS tags FROM c)
SELECT record_id, entry_no, content, {_text('a')} AS name, {_text('b')} AS version, {_text('m')} AS minimum_required_version, {_PLACES.format(_elements('authors'))} AS n_authors, {_PLACES.format(_elements('tags'))} AS n_tags FROM f"""
_P5_LIBRARIES = f"""WITH {_ENTRY}, l2 AS (SELECT record_id, entry_no, content, CAST(json_extract(x, '$.dependencies.libraries') AS JSON[]) AS v FROM c WHERE json_type(json_extract(x, '$.dependencies.libraries')) = 'ARRAY'),
u AS (SELECT * EXCLUDE (v), unnest(v) AS v, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos FROM l2), n AS (SELECT *, json_extract(v, '$.name') AS a, json_extract(v, '$.version') AS b FROM u)
SELECT record_id, entry_no, content, pos, {_text('a')} AS name, {_text('b')} AS version FROM n"""

ORACLE = {"p1_found": _P1, "p5_found": _P5, "p5_projects": _P5_PROJECTS, "p5_libraries": _P5_LIBRARIES}
