"""Queries of the training-data problems, and their SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import harm
from wavemill.llm import percentiles as pct
from wavemill.llm.leaks import find_leaks
from wavemill.llm.mixing import mix, records
from wavemill.llm.runs import collapse_runs
from wavemill.llm.splits import capture_groups, capture_splits, split_deviation
from wavemill.sources.tables import table


#: Where the tokenizer files are unless ``spark.wavemill.tokenizers`` says otherwise.
TOKENIZERS = "/opt/tokenizers"


def _runs(spark: SparkSession, folder: str, penalty: float = math.inf) -> DataFrame:
    return collapse_runs(table(spark, folder, "snippets"), ["stem", "channel"], ["frame_number", "orig_sample_start"], "orig_sample_start", "orig_sample_count", "annotations", penalty=penalty)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).where("n_events >= 2").select("stem", "channel", "first_sample", "last_sample")


def p2_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder)


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a price on spread, so that slow drifts fall into runs of near-identical events."""
    return _runs(spark, folder, 2.0)


LATENCY_PCTS, SHARE_PCTS = [50, 90, 99], [25, 50, 75]
# A share's percentile is a case above these.
SHARE_LIMITS = {"coverage": 0.30, "box_iou": 0.50}


def _latencies(spark: SparkSession, folder: str, groups: list[str]) -> DataFrame:
    return pct.sorted_values(table(spark, folder, "latency_samples"), groups, "latency_ms", ["sample_id"], F.col("latency_ms") >= 0)


def _shares(spark: SparkSession, folder: str) -> DataFrame:
    """Both shares of every detection, sorted by metric, detector and class."""
    long = table(spark, folder, "region_metrics").select(
        "detector", "file_stem", "frame_number", "ann_idx",
        F.concat("detector", F.lit("/"), "signal_class").alias("group_key"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("share")) for m in SHARE_LIMITS])),
    )
    return pct.sorted_values(long, ["metric", "group_key"], "share", ["detector", "file_stem", "frame_number", "ann_idx"], F.col("share").between(0, 1))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    budgets = table(spark, folder, "latency_cells").groupBy("cell_index").agg(F.max("frame_budget_ms").alias("most"))
    slow = pct.percentiles(_latencies(spark, folder, ["cell_index"]), ["cell_index"], LATENCY_PCTS).join(budgets, "cell_index").where("value > most")
    slow = slow.select(F.lit("latency_ms").alias("metric"), F.col("cell_index").cast("string").alias("group_key"), "pct")
    most = F.create_map(*[F.lit(x) for kv in SHARE_LIMITS.items() for x in kv])
    high = pct.percentiles(_shares(spark, folder), ["metric", "group_key"], SHARE_PCTS).where(F.col("value") > most[F.col("metric")])
    return slow.unionByName(high.select("metric", "group_key", "pct"))


def p3_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Interpolated percentiles per cell."""
    return pct.quantiles(_latencies(spark, folder, ["cell_index"]), ["cell_index"], LATENCY_PCTS).select("cell_index", "pct", "n", F.round("value", 6).alias("value"))


def p3_days_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Each day reduced by itself, then all days put together."""
    days = pct.reduced(_latencies(spark, folder, ["cell_index", "run_day"]), ["cell_index", "run_day"])
    return pct.merged_percentiles(days, ["cell_index"], LATENCY_PCTS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    together = capture_groups(table(spark, folder, "captures"), table(spark, folder, "regions"))
    return together.where("component <> stem").select(F.col("component").alias("group_stem"), "stem")


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    return capture_splits(table(spark, folder, "captures"), table(spark, folder, "regions"))


def p4_deviation(spark: SparkSession, folder: str) -> DataFrame:
    """What each split has of each label and of all regions."""
    return split_deviation(table(spark, folder, "captures"), table(spark, folder, "regions"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks(spark, folder).where("distance = 0").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Also passages with one word changed, left out or put in."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The largest mixture in which each source makes up its share. The setting ``spark.wavemill.tokenizers`` names the folder of tokenizer files."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), spark.conf.get("spark.wavemill.tokenizers", TOKENIZERS), strict=True)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p7_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the mixture, each as often as it is taken."""
    return records(table(spark, folder, "documents"), p7_mix(spark, folder))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return harm.scored(table(spark, folder, "documents"), table(spark, folder, "doc_labels"), table(spark, folder, "term_list"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).where(F.col("score") >= harm.THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return harm.rates(p8_scores(spark, folder))


QUERIES = {
    "p2_found": p2_found,
    "p2_runs": p2_runs,
    "p2_segments": p2_segments,
    "p3_found": p3_found,
    "p3_quantiles": p3_quantiles,
    "p3_days_merged": p3_days_merged,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p4_deviation": p4_deviation,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_records": p7_records,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

_RUNS = """
WITH s AS (SELECT * FROM snippets WHERE orig_sample_start IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY stem, channel, frame_number, orig_sample_start ORDER BY received_at) = 1),
g AS (SELECT stem, channel, frame_number, orig_sample_start AS start, orig_sample_start + coalesce(orig_sample_count, 0) AS stop,
        list_sort(list_transform(list_filter(coalesce(annotations, []), lambda a: a IS NOT NULL), lambda a: {'f': a.freq_lower_hz, 'l': upper(regexp_replace(coalesce(a.label, 'UNLABELED'), '^\\s+|\\s+$', '', 'g'))})) AS sig FROM s),
p AS (SELECT *, lag(sig) OVER w AS prev FROM g WINDOW w AS (PARTITION BY stem, channel ORDER BY frame_number NULLS FIRST, start)),
n AS (SELECT *, CASE WHEN len(sig) > 0 AND len(sig) = len(prev)
        AND list_bool_and(list_transform(list_zip(sig, prev), lambda z: z[1].l = z[2].l AND abs(z[1].f - z[2].f) <= 2000)) THEN 0 ELSE 1 END AS new FROM p),
r AS (SELECT *, sum(new) OVER (PARTITION BY stem, channel ORDER BY frame_number NULLS FIRST, start ROWS UNBOUNDED PRECEDING) AS k FROM n),
runs AS (SELECT stem, channel, k, arg_min(start, (coalesce(frame_number, -1), start)) AS first_sample, arg_max(start, (coalesce(frame_number, -1), start)) AS last_sample,
           arg_max(stop, (coalesce(frame_number, -1), start)) AS stop, count(*) AS n FROM r GROUP BY ALL)
"""

_LATENCY = "l AS (SELECT DISTINCT sample_id, cell_index, latency_ms AS v FROM latency_samples WHERE latency_ms >= 0 AND NOT isnan(latency_ms)), r AS (SELECT cell_index, v, row_number() OVER (PARTITION BY cell_index ORDER BY v) AS k, count(*) OVER (PARTITION BY cell_index) AS n FROM l)"

def _plain(c: str) -> str:
    """SQL of a capture's plain name."""
    s = f"regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '^.*[/\\\\]', '')"
    s = f"regexp_replace(lower({s}), '\\.sigmf([-_ ]?(meta|data))?$', '')"
    return f"regexp_replace(regexp_replace({s}, '[\\s\\-_.]+', '_', 'g'), '^_+|_+$', '', 'g')"


#: Wide forms of the printable ASCII characters, and those.
_WIDE, _ASCII = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(map(chr, range(0x21, 0x7F)))


def _words(c: str) -> str:
    """SQL of a text's words, spelling aside."""
    s = f"translate(regexp_replace({c}, '[\\p{{Cf}}\\x{{034F}}\\x{{115F}}\\x{{1160}}\\x{{3164}}\\x{{FFA0}}]', '', 'g'), '{_WIDE}', '{_ASCII.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_extract_all(replace(strip_accents(lower(nfc_normalize({s}))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


ORACLE = {
    "p6_found": f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), i AS (SELECT item_id, {_words('text')} AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS x FROM d), iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS x FROM i)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (x)
""",
    "p4_found": f"""
WITH RECURSIVE caps AS (SELECT DISTINCT stem, {_plain('stem')} AS p FROM captures WHERE stem IS NOT NULL),
raw AS (SELECT DISTINCT coalesce(stem, regexp_replace(frame_id, '#[^#]*$', '')) AS s, time_group FROM regions WHERE time_group IS NOT NULL AND time_group <> 0),
e AS (SELECT caps.stem, 't:' || time_group AS e FROM raw JOIN caps ON caps.p = {_plain('raw.s')}
      UNION SELECT stem, 's:' || split_part(stem, '_attenuation_dB_', 1) FROM caps WHERE contains(stem, '_attenuation_dB_')),
pairs AS (SELECT DISTINCT a.stem AS x, b.stem AS y FROM e a JOIN e b USING (e)),
reach AS (SELECT x, y FROM pairs UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON pairs.x = reach.y)
SELECT min(y) AS group_stem, x AS stem FROM reach GROUP BY x HAVING min(y) <> x
""",
    "p2_found": _RUNS + "SELECT stem, channel, first_sample, last_sample FROM runs WHERE n >= 2",
    "p2_runs": _RUNS + "SELECT stem, channel, first_sample, last_sample, n AS n_events, stop - first_sample AS duration_samples FROM runs",
    "p3_found": f"""
WITH {_LATENCY},
m AS (SELECT DISTINCT file_stem, frame_number, ann_idx, detector || '/' || signal_class AS g, coverage, box_iou FROM region_metrics),
u AS (SELECT 'coverage' AS metric, g, coverage AS v, 0.30 AS most FROM m UNION ALL SELECT 'box_iou', g, box_iou, 0.50 FROM m),
s AS (SELECT metric, g, v, most, row_number() OVER (PARTITION BY metric, g ORDER BY v) AS k, count(*) OVER (PARTITION BY metric, g) AS n FROM u WHERE NOT isnan(v) AND v BETWEEN 0 AND 1 AND g IS NOT NULL)
SELECT 'latency_ms' AS metric, CAST(r.cell_index AS VARCHAR) AS group_key, p.pct FROM r JOIN latency_cells c ON r.cell_index = c.cell_index, (VALUES (50), (90), (99)) p(pct)
WHERE r.k = (p.pct * r.n + 99) // 100 AND r.v > c.frame_budget_ms
UNION ALL SELECT metric, g, p.pct FROM s, (VALUES (25), (50), (75)) p(pct) WHERE k = (p.pct * n + 99) // 100 AND v > most
""",
    "p3_quantiles": f"""
WITH {_LATENCY} SELECT cell_index, pct, max(n) AS n, round(max(CASE WHEN k = lo THEN v END) + (max(CASE WHEN k = least(lo + 1, n) THEN v END) - max(CASE WHEN k = lo THEN v END)) * (max(pct * (n - 1) % 100) / 100.0), 6) AS value
FROM (SELECT r.*, p.pct, (p.pct * (n - 1)) // 100 + 1 AS lo FROM r, (VALUES (50), (90), (99)) p(pct)) GROUP BY cell_index, pct
""",
    "p3_days_merged": f"WITH {_LATENCY} SELECT cell_index, pct, n, v AS value FROM r, (VALUES (50), (90), (99)) p(pct) WHERE k = (pct * n + 99) // 100",
}
