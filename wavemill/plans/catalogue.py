"""The metadata catalogue, order of evaluation reports, and path timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.functions.scalar import semver
from wavemill.operators.nested import CONTENT_KEYS, metadata_projects
from wavemill.plans.registry import Registry
from wavemill.sources.tables import table
from wavemill.sources.traces import operator_latency

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_ENTRIES = f"""r AS (SELECT DISTINCT ON (record_id) record_id, TRY_CAST(raw_json AS JSON) AS j FROM project_metadata ORDER BY record_id, ingested_at),
e AS (SELECT record_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [j] END) AS e FROM r WHERE j IS NOT NULL AND json_type(j) IN ('ARRAY', 'OBJECT')),
c AS (SELECT record_id, k AS content, json_extract(e, '$.' || k) AS x FROM e, (SELECT unnest({CONTENT_KEYS!r}) AS k) WHERE json_type(e) = 'OBJECT' AND json_exists(e, '$.' || k))"""


@query(f"WITH {_ENTRIES} SELECT content, regexp_extract(json_extract_string(x, '$.version'), '^\\s*[vV]?(\\d+)', 1) AS major, count(*) AS n, count(DISTINCT record_id) AS n_records FROM c GROUP BY 1, 2")
def catalogue_versions(spark, folder):
    """How often each major version occurs per kind of entry."""
    p = metadata_projects(table(spark, folder, "project_metadata"))
    return p.groupBy("content", F.split(semver(F.col("version")), r"\.")[0].alias("major")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("n_records"))


@query(f"""WITH {_ENTRIES} SELECT record_id, content, name IS NOT NULL AND name <> '' AS has_name, coalesce(regexp_matches(version, '^\\d+\\.\\d+\\.\\d+$'), FALSE) AS good_version, n_authors > 0 AS has_authors FROM (SELECT record_id, content, json_extract_string(x, '$.name') AS name, json_extract_string(x, '$.version') AS version,
CASE json_type(json_extract(x, '$.authors')) WHEN 'ARRAY' THEN json_array_length(json_extract(x, '$.authors')) WHEN 'NULL' THEN 0 ELSE CASE WHEN json_exists(x, '$.authors') THEN 1 ELSE 0 END END AS n_authors FROM c)""")
def catalogue_validation(spark, folder):
    """Which required fields each entry lacks."""
    p = metadata_projects(table(spark, folder, "project_metadata"))
    return p.select("record_id", "content", F.col("name").isNotNull().alias("has_name"), F.coalesce(F.col("version").rlike(r"^\d+\.\d+\.\d+$"), F.lit(False)).alias("good_version"), (F.col("n_authors") > 0).alias("has_authors"))


@query("""WITH t AS (SELECT DISTINCT sample_id, cell_index, latency_ms FROM latency_samples WHERE latency_ms >= 0 AND NOT isnan(latency_ms)), u AS (SELECT detector, CAST(round(latency_ms * 1000) AS BIGINT) AS us FROM t JOIN latency_cells USING (cell_index))
SELECT 'rx' AS op, NULL AS next_op, count(*) AS n, 5.0 AS mean_us, 5::BIGINT AS most_us FROM u UNION ALL SELECT 'rx', detector, count(*), 2.0, 2 FROM u GROUP BY detector UNION ALL SELECT detector, NULL, count(*), round(avg(us), 4), max(us) FROM u GROUP BY detector""")
def operator_edges(spark, folder):
    """Mean and longest time in each operator and on each edge of the paths."""
    t = table(spark, folder, "latency_samples").where("latency_ms >= 0 and not isnan(latency_ms)").select("sample_id", "cell_index", "latency_ms").distinct()
    t = t.join(table(spark, folder, "latency_cells").select("cell_index", "detector"), "cell_index")
    start, us = F.col("sample_id") * 1000, F.round(F.col("latency_ms") * 1000).cast("long")
    ops = F.array(
        F.struct(F.lit("rx").alias("op"), start.alias("recv_us"), (start + 5).alias("pub_us")),
        F.struct(F.col("detector").alias("op"), (start + 7).alias("recv_us"), (start + 7 + us).alias("pub_us")),
    )
    return operator_latency(t.select(ops.alias("ops"))).select("op", "next_op", "n", F.round("mean_us", 4).alias("mean_us"), "most_us")


@query("""WITH o AS (SELECT o_custkey, o_orderpriority, o_orderdate FROM orders) SELECT o_custkey, o_orderpriority, count(*) AS n, CAST(min(o_orderdate) AS VARCHAR)[:10] || ' to ' || CAST(max(o_orderdate) AS VARCHAR)[:10] AS dates, string_agg(DISTINCT CAST(o_orderdate AS VARCHAR)[:10], ',' ORDER BY CAST(o_orderdate AS VARCHAR)[:10]) AS every_date FROM o GROUP BY 1, 2""")
def summaries_with_dates(spark, folder):
    """One row per distinct summary with the range of its dates, and all of them."""
    o = table(spark, folder, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.collect_set(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("days"))  # as many as there are days
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select("o_custkey", "o_orderpriority", "n", F.concat_ws(" to ", day("a"), day("b")).alias("dates"), F.array_join(F.sort_array("days"), ",").alias("every_date"))


@query("""SELECT label, kind, count(*) AS n, coalesce(list_position(['LTE', 'ZC', 'QPSK', 'BPSK', 'OFDM_A'], label), 999)::INT AS place FROM (SELECT DISTINCT stem, ann_idx, coalesce(label, 'UNLABELED') AS label, coalesce(kind, 'annotation') AS kind FROM annotations) GROUP BY 1, 2""")
def canonical_order(spark, folder):
    """Class counts with each class's place in a set order, unknown classes last."""
    a = table(spark, folder, "annotations").select("stem", "ann_idx", F.coalesce("label", F.lit("UNLABELED")).alias("label"), F.coalesce("kind", F.lit("annotation")).alias("kind")).distinct()
    known = F.array(*[F.lit(x) for x in ("LTE", "ZC", "QPSK", "BPSK", "OFDM_A")])
    place = F.array_position(known, F.col("label")).cast("int")
    return a.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.when(place == 0, 999).otherwise(place)).orderBy("place", "label")
