"""Queries p4_: percentiles of the reports' measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.radix import STATE_LEVELS, combine_states, digit_states, long_form, radix_select, state_percentiles
from plumbline.session import materialize
from plumbline.sources.tables import clean_path, extension_of, project_of, records, table

MEASURES = ["lines", "max_depth", "imports"]
PROBS = [0.25, 0.5, 0.75, 0.9, 0.99]
BITS = sum(STATE_LEVELS)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports once each under project and once under extension; a report without a path
    belongs to the group null of both."""
    m = records(table(spark, sf_dir, "metrics").select("report_id", "path", "run_ts", *MEASURES), "report_id")
    path = clean_path(F.col("path"))
    groups = F.array(
        F.struct(F.lit("project").alias("grouping"), project_of(path).alias("name")), F.struct(F.lit("extension").alias("grouping"), extension_of(path).alias("name"))
    )
    return m.select(F.to_date("run_ts").alias("day"), *MEASURES, F.explode(groups).alias("g")).select("g.grouping", "g.name", "day", *MEASURES)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digit_states(long_form(_reports(spark, sf_dir), ["grouping", "name", "day"], MEASURES), ["grouping", "name", "day"], BITS)


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per day and, with day null, over all days by combining the days' states.
    Both are selected at once, digit by digit."""
    days = materialize(_states(spark, sf_dir), "states")
    every = combine_states(days, ["grouping", "name"]).withColumn("day", F.lit(None).cast("date")).withColumn("whole", F.lit(True))
    both = materialize(days.withColumn("whole", F.lit(False)).unionByName(every), "states")
    return state_percentiles(both, ["grouping", "name", "day", "whole"], PROBS).drop("whole")


def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles over all days, by selection down to the last digit."""
    return radix_select(materialize(long_form(_reports(spark, sf_dir), ["grouping", "name"], MEASURES), "values"), ["grouping", "name"], PROBS)


QUERIES = {"p4_percentiles": percentiles, "p4_day_states": _states, "p4_exact_percentiles": exact_percentiles}

_ROWS = r"""
WITH m AS (SELECT report_id, any_value(run_ts) AS run_ts, any_value(lines) AS lines, any_value(max_depth) AS max_depth, any_value(imports) AS imports,
  regexp_replace(regexp_replace(regexp_replace(any_value(path), '[\\/]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') AS path
  FROM metrics WHERE report_id IS NOT NULL GROUP BY report_id),
g AS (SELECT 'project' AS "grouping", split_part(path, '/', 1) AS name, * FROM m
  UNION ALL SELECT 'extension', nullif(regexp_extract(path, '[^/]\.([^./]+)$', 1), ''), * FROM m),
v AS (SELECT "grouping", name, CAST(run_ts AS DATE) AS day, 'lines' AS measure, lines AS x FROM g UNION ALL
  SELECT "grouping", name, CAST(run_ts AS DATE), 'max_depth', max_depth FROM g UNION ALL
  SELECT "grouping", name, CAST(run_ts AS DATE), 'imports', imports FROM g),
"""
_PROBS = ", ".join(f"{p}::DOUBLE" for p in PROBS)
_FLOOR = "CASE WHEN x < 8192 THEN CAST(x AS DOUBLE) ELSE floor(x / pow(2.0, floor(log2(x)) - 12)) * pow(2.0, floor(log2(x)) - 12) END"


def _sql(rows: str, value: str) -> str:
    return _ROWS + f"""r AS ({rows}),
k AS (SELECT *, row_number() OVER (PARTITION BY "grouping", name, day, measure ORDER BY x) AS rn, count(*) OVER (PARTITION BY "grouping", name, day, measure) AS n FROM r WHERE x IS NOT NULL),
q AS (SELECT *, unnest([{_PROBS}]) AS p FROM k)
SELECT "grouping", name, {"day, " if "day" in value else ""}measure, p, min({value.replace("day", "")}) AS value, n FROM q WHERE rn >= greatest(ceil(p * n), 1) GROUP BY "grouping", name, day, measure, p, n"""


# the leading 24 bits of a whole number as a double
_DIGIT = """CASE WHEN x = 0 THEN 0 ELSE ((floor(log2(x))::BIGINT + 1023) * 4503599627370496 + ((x / pow(2.0, floor(log2(x))) - 1) * 4503599627370496)::BIGINT) >> 40 END"""

SQL = {
    "p4_day_states": _ROWS.rstrip().rstrip(",") + f''' SELECT "grouping", name, day, measure, {_DIGIT} AS digit, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY ALL''',
    "p4_percentiles": _sql("SELECT * FROM v UNION ALL SELECT \"grouping\", name, CAST(NULL AS DATE), measure, x FROM v", _FLOOR + "day"),
    "p4_exact_percentiles": _sql("SELECT \"grouping\", name, 0 AS day, measure, x FROM v", "CAST(x AS DOUBLE)"),
}
