"""Queries of the language-model operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profloom.llm import bpe, packing, quantiles, spans
from profloom.plans import table
from profloom.runtime import materialize

THRESHOLDS = {10: 300.0, 50: 850.0, 90: 1300.0}


def _wells(spark: SparkSession, sf_dir: str, percents: list[int]) -> DataFrame:
    return quantiles.well_percentiles(table(spark, sf_dir, "ph3"), table(spark, sf_dir, "image"), percents)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wells whose percentiles are above the thresholds, one row per well and percentile."""
    hits = F.array_compact(F.array(*(F.when(F.col(f"p{p}") > x, F.lit(p).cast("bigint")) for p, x in THRESHOLDS.items())))
    return _wells(spark, sf_dir, list(THRESHOLDS)).select("metadata_plate", "metadata_well", F.explode(hits).alias("pct"))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wells(spark, sf_dir, [10, 25, 50, 75, 90, 99])


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of wells from summaries that are stored by day and merged afterwards."""
    groups = ["metadata_plate", "metadata_well"]
    stored = materialize(quantiles.daily_summaries(table(spark, sf_dir, "ph3"), table(spark, sf_dir, "image")), "daily")
    return quantiles.percentiles(quantiles.merge_parts(stored, "day", groups), groups, [10, 50, 90]).drop("gap")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_report(p7_pack(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


def p8_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return spans.shared_amounts(documents, spans.shared_spans(documents))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_percentiles, p3_daily, p6_ids, p6_counts, p7_pack, p7_containers, p8_found, p8_amounts)}

_P3 = """
WITH objects AS (
  SELECT TableNumber, ImageNumber, ObjectNumber, min(Location_Center_X) AS x FROM ph3
  WHERE Location_Center_X IS NOT NULL AND NOT isnan(Location_Center_X) GROUP BY ALL),
wells AS (SELECT TableNumber, ImageNumber, max(Metadata_Plate) AS metadata_plate, max(Metadata_Well) AS metadata_well FROM image GROUP BY ALL),
ranked AS (
  SELECT metadata_plate, metadata_well, x, row_number() OVER (PARTITION BY metadata_plate, metadata_well ORDER BY x) AS r,
    count(*) OVER (PARTITION BY metadata_plate, metadata_well) AS n
  FROM objects JOIN wells USING (TableNumber, ImageNumber) WHERE metadata_plate IS NOT NULL AND metadata_well IS NOT NULL)"""


def _exact(percents: list[int], gap: str = "") -> str:
    """The percentiles themselves; the operator's are these for groups of up to 1/eps values, as all are at scale 0.01."""
    found = ", ".join(f"max(x) FILTER (r = greatest(1, (n * {p} + 99) // 100)) AS p{p}" for p in percents)
    return f"{_P3} SELECT metadata_plate, metadata_well, max(n) AS n, {gap}{found} FROM ranked GROUP BY ALL"


# Runs of 200 characters by their start; those that also stand in another record are joined where they overlap or touch.
_P8 = """
WITH runs AS (SELECT doc_id, i, md5(substr(text, i + 1, 200)) AS run FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS i FROM documents WHERE length(text) >= 200)),
several AS (SELECT run FROM runs GROUP BY run HAVING min(doc_id) <> max(doc_id)),
shared AS (SELECT doc_id, i FROM runs JOIN several USING (run)),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS new FROM shared WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM marked),
found AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM numbered GROUP BY doc_id, stretch)"""

SQL: dict[str, str] = {
    "p3_found": _P3 + """,
wanted AS (SELECT * FROM (VALUES (10, 300.0), (50, 850.0), (90, 1300.0)) t(pct, least))
SELECT metadata_plate, metadata_well, CAST(pct AS BIGINT) AS pct
FROM ranked, wanted WHERE r = (n * pct + 99) // 100 AND x > least""",
    "p3_percentiles": _exact([10, 25, 50, 75, 90, 99], "CAST(least(max(n) - 1, 1) AS BIGINT) AS gap, "),
    "p3_daily": _exact([10, 50, 90]),
    "p8_found": _P8 + " SELECT doc_id, span_start, span_end FROM found",
    "p8_amounts": _P8 + """
SELECT d.doc_id, coalesce(length(text), 0) AS n_text_chars, CAST(coalesce(sum(span_end - span_start), 0) AS BIGINT) AS shared_chars, count(span_start) AS n_spans
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id, text""",
}
