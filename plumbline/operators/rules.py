"""Thresholds, issues and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.languages import settings_extension
from plumbline.session import fenced

# Limits where nothing else is said, and the rules.
DEFAULTS = {"max_lines": 400, "max_depth": 6, "max_imports": 25, "max_repetition": 15.0, "min_duplicate_lines": 4}
RULES = ["max-lines", "max-imports", "max-repetition", "max-depth"]


def severity_column(rule: str) -> str:
    return f"sev_{rule.replace('-', '_')}"


def limits_by_extension(thresholds: DataFrame) -> dict[str, dict[str, float | None]]:
    """Limits by extension of the small dimension thresholds(ext, limits...): one row for an
    extension, and one named `default`. Of several rows the smallest values count."""
    rows = thresholds.where("ext IS NOT NULL").groupBy("ext").agg(*[F.min(c).alias(c) for c in DEFAULTS]).collect()
    return {r.ext: {c: r[c] for c in DEFAULTS} for r in rows}


def with_limits(files: DataFrame, thresholds: DataFrame) -> DataFrame:
    """files(ext, ...) with the limits for their extension, else those of the row `default`,
    else the built-in ones."""
    limits = limits_by_extension(thresholds)
    base = limits.get("default", {})
    key = settings_extension(F.col("ext"))

    def limit(c: str, built_in: float) -> Column:
        kind = "double" if isinstance(built_in, float) else "bigint"
        other = F.lit(built_in if base.get(c) is None else base[c]).cast(kind)
        own = {e: v[c] for e, v in limits.items() if v[c] is not None and e != "default"}
        out = None
        for e, v in sorted(own.items()):
            out = F.when(key == e, F.lit(v).cast(kind)) if out is None else out.when(key == e, F.lit(v).cast(kind))
        return (other if out is None else out.otherwise(other)).alias(c)

    return files.select(*[c for c in files.columns if c not in DEFAULTS], *[limit(c, v) for c, v in DEFAULTS.items()])


def _percent(x: Column) -> Column:
    return F.format_string("%.1f", F.bround(x, 1))


def _severity(columns: list[str], severities: dict[str, str] | None, rule: str) -> Column:
    """The severity in a file's own column, else that of the dictionary, else error."""
    given = (severities or {}).get(rule, (severities or {}).get(rule.replace("-", "_"), "error"))
    return F.coalesce(F.col(severity_column(rule)), F.lit(given)) if severity_column(rule) in columns else F.lit(given)


def with_issues(measured: DataFrame, severities: dict[str, str] | None = None, depth: bool = True) -> DataFrame:
    """measured(lines, imports, repetition, depths, disabled, limits...) with `issues`, an
    array of (rule, message, severity, line), and `passed`, whether none is an error. A value
    at the limit is no issue; there is one issue for every line that is too deep, with its
    line. Severities are those of severity_column, where measured has them. depth=False
    leaves lines out, as the cross-file results have none. Within the row."""

    def issue(rule: str, message: Column, line: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), message.alias("message"), _severity(measured.columns, severities, rule).alias("severity"), line.cast("int").alias("line"))

    allowed = lambda rule: ~F.array_contains("disabled", rule)
    found = lambda rule, cond, message: F.when(cond & allowed(rule), issue(rule, message, F.lit(None)))
    whole = F.array(
        found("max-lines", F.col("lines") > F.col("max_lines"), F.format_string("File too long: %d lines (max %d)", "lines", "max_lines")),
        found("max-imports", F.col("imports") > F.col("max_imports"), F.format_string("Too many imports: %d (max %d)", "imports", "max_imports")),
        found("max-repetition", F.col("repetition") > F.col("max_repetition"), F.concat(F.lit("High code repetition: "), _percent(F.col("repetition")), F.lit("% (max "), _percent(F.col("max_repetition")), F.lit("%)"))),
    )
    issues = F.filter(whole, lambda x: x.isNotNull())
    if depth:
        deep = F.filter(F.transform("depths", lambda x, i: F.struct((i + 1).alias("line"), x.alias("depth"))), lambda x: x["depth"] > F.col("max_depth"))
        each = F.transform(deep, lambda x: issue("max-depth", F.format_string("Excessive nesting: %d levels (max %d)", x["depth"], F.col("max_depth")), x["line"]))
        issues = F.concat(issues, F.when(allowed("max-depth"), each).otherwise(F.slice(each, 1, 0)))
    df = measured.withColumn("issues", issues)
    return fenced(df.withColumn("passed", ~F.exists("issues", lambda x: x["severity"] == "error")), "issues", "passed")


def issue_table(judged: DataFrame) -> DataFrame:
    """(path, rule, message, severity, line) of with_issues' rows."""
    return judged.select("path", F.explode_outer("issues").alias("i")).where("i IS NOT NULL").select("path", "i.*")


def exit_code(judged: DataFrame) -> DataFrame:
    """One row: (ok, code); code is 1 if any file fails, 0 if none does or there is none."""
    failed = F.count_if(~F.col("passed")) > 0
    return judged.agg((~failed).alias("ok"), failed.cast("int").alias("code"))
