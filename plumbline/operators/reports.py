"""Reports: rankings, summaries, JSON and editor diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.languages import LANGUAGES, Language, pick
from plumbline.operators.rules import issue_table
from plumbline.operators.scan import DISABLE_TAG


def ranked(judged: DataFrame) -> DataFrame:
    """Passed files first, then most issues, then longest, then by path."""
    return judged.orderBy(F.desc("passed"), F.desc(F.size("issues")), F.desc("lines"), "path")


def summary(judged: DataFrame) -> DataFrame:
    """One row: (total, passed, failed, ok); ok is what an exit code would say."""
    agg = judged.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"))
    return agg.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), (F.col("total") == F.col("passed")).alias("ok"))


def quiet(judged: DataFrame) -> DataFrame:
    """(path, status, messages) of the files with issues."""
    listed = F.array_sort(F.transform("issues", lambda x: F.struct(F.coalesce(x["line"], F.lit(0)).alias("l"), x["rule"].alias("r"), x["message"].alias("m"))))
    messages = F.array_join(F.transform(listed, lambda x: x["m"]), ", ")
    return judged.where(F.size("issues") > 0).select("path", F.when(F.col("passed"), "WARNING").otherwise("BITTER").alias("status"), messages.alias("messages"))


def quiet_summary(judged: DataFrame) -> DataFrame:
    """The line that closes a quiet report, (total, passed, failed); no row if no file has
    an issue."""
    agg = judged.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(F.size("issues") > 0).alias("_with"))
    return agg.where("_with > 0").select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"))


def also_in(others: Column, more: Column) -> Column:
    """Other places of a block as text: path:line, ..., and how many more there are."""
    listed = F.array_join(F.transform(others, lambda x: F.concat(x["path"], F.lit(":"), x["line"].cast("string"))), ", ")
    return F.concat(listed, F.when(more > 0, F.format_string(" and %d more", more)).otherwise(""))


def head_lines(text: Column, n: int = 3) -> Column:
    """The first lines of a text, as a report on a terminal shows a block."""
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, n), "\n")


def problems(judged: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """(path, line, message): issues, at line 1 where they have none, and repeated blocks of
    details(path, line, others, more, ...)."""
    rows = issue_table(judged).select("path", F.coalesce("line", F.lit(1)).alias("line"), "message")
    if details is None:
        return rows
    return rows.unionByName(details.select("path", "line", F.concat(F.lit("Duplicate found. Also in: "), also_in(F.col("others"), F.col("more"))).alias("message")))


def json_report(rows: DataFrame) -> DataFrame:
    """(path, report): the problems of a file as JSON, an object for one and an array for
    more, as the report file has them, in the order of paths."""
    listed = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "message"))).alias("p"))
    return listed.select("path", F.when(F.size("p") == 1, F.to_json(F.get("p", F.lit(0)))).otherwise(F.to_json("p")).alias("report")).orderBy("path")


def full_reports(judged: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """(path, lines, imports, max_depth, repetition, passed, issues, duplicates, deep_lines):
    everything known about a file, in one row."""
    deep = F.filter(F.transform("depths", lambda x, i: F.struct((i + 1).alias("line"), x.alias("depth"))), lambda x: x["depth"] > F.col("max_depth"))
    deep = F.when(~F.array_contains("disabled", "max-depth"), deep).otherwise(F.slice(deep, 1, 0))
    rows = judged.select("path", "lines", "imports", F.col("depth").alias("max_depth"), "repetition", "passed", "issues", deep.alias("deep_lines"))
    if details is None:
        return rows
    each = details.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "content", "others", "more"))).alias("duplicates"))
    return rows.join(each, "path", "left").withColumn("duplicates", F.coalesce("duplicates", F.slice("duplicates", 1, 0)))


def diagnostics(judged: DataFrame, details: DataFrame | None = None, severity: str = "warning") -> DataFrame:
    """(path, start_line, end_line, end_column, rule, severity, message, related), lines from
    0: file issues on the first line, deep lines on their own, repeated blocks of details on
    theirs, with the other places as related information. The severity is always the same,
    whatever the settings say."""
    line = F.coalesce(F.col("line") - 1, F.lit(0))
    rows = issue_table(judged).select("path", line.alias("start_line"), line.alias("end_line"), "rule", "message", F.lit(None).cast("string").alias("related"))
    if details is not None:
        first = F.col("line") - 1
        # as text.lines() counts: a last line that is empty is none
        last = first + F.size(F.split(F.regexp_replace("content", "\n\\z", ""), "\n", -1)) - 1
        message = F.format_string("Code duplication detected! (repeated in %d other places)", F.size("others") + F.col("more"))
        rows = rows.unionByName(details.select("path", first.alias("start_line"), last.alias("end_line"), F.lit("max-repetition").alias("rule"), message.alias("message"), also_in(F.col("others"), F.col("more")).alias("related")))
    return rows.select("path", "start_line", "end_line", F.lit(80).alias("end_column"), "rule", F.lit(severity).alias("severity"), "message", "related")


def quick_fixes(diagnosed: DataFrame, ext: Column, languages: Sequence[Language] = LANGUAGES) -> DataFrame:
    """(path, rule, edit): the line that, put on top, disables a rule in a file."""
    comment = F.coalesce(pick(ext, lambda x: x.line, languages), F.lit("//"))
    return diagnosed.select("path", "rule", F.concat(comment, F.lit(f" {DISABLE_TAG} "), F.col("rule"), F.lit("\n")).alias("edit")).distinct()


def within_roots(paths: DataFrame, roots: list[str]) -> DataFrame:
    """paths(path) under any of the roots, by whole components; all if there are none."""
    if not roots:
        return paths
    cond = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        cond = cond | (F.col("path") == r) | F.col("path").startswith(r + "/")
    return paths.where(cond)
