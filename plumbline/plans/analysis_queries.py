"""Queries over source files, each with the same computation in SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import plumbline
from plumbline.functions.languages import LANGUAGES, Language, catalog, pick
from plumbline.functions.lexing import normalize_whitespace, strip_comments
from plumbline.operators import reports, rules, scan
from plumbline.operators import repetition as rep
from plumbline.operators.config import apply_settings, config_errors, parse_settings, resolve_settings
from plumbline.session import materialize, shared_folder
from plumbline.sources import sinks
from plumbline.sources.tables import clean_path, extension_of, first_rows, table
from plumbline.sources.tree import read_tree
from plumbline.streaming.debounce import debounce, to_analyse

EXCLUDED = ["vendor", "dist", "target", "node_modules", "build"]
#: A language that is not built in, as a user would add it.
PROSE = Language("Prose", ("txt", "md"), "%", ("<!--", "-->"), ("include",), 2)
WARNINGS = {"max-repetition": "warning"}


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.source_files(table(spark, sf_dir, "files"))


# directives put on top of added copies of files, as the tables hold none: by file_id modulo 5
DIRECTIVES = {
    0: f"// {scan.IGNORE_TAG}\n",
    1: f"// {scan.DISABLE_TAG.upper()} Max-Lines max-depth */\n// {scan.DISABLE_TAG} max-depth other\n",
    2: "//\n" * 10 + f"// {scan.IGNORE_TAG} {scan.DISABLE_TAG} max-repetition\n",
}


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files, and copies of them below directed/ with directives on top."""
    rows = table(spark, sf_dir, "files")
    path = clean_path(F.col("path"))
    known = extension_of(path).isin(scan.supported()) & F.col("content").isNotNull()
    rows = first_rows(rows, path, known).select("file_id", path.alias("path"), extension_of(path).alias("ext"), scan.directory_of(path).alias("dir"), "content")
    k, top = F.pmod("file_id", F.lit(5)), F.lit(None)
    for value, text in DIRECTIVES.items():
        top = F.when(k == value, text).otherwise(top)
    copies = rows.where(top.isNotNull()).withColumn("content", F.concat(top, "content")).withColumn("path", F.concat(F.lit("directed/"), "path")).withColumn("dir", F.concat(F.lit("directed/"), "dir"))
    return rows.unionByName(copies).drop("file_id")


def _scanned(files: DataFrame) -> DataFrame:
    return scan.scan_lines(scan.directed(files))


def _lines(spark, d) -> DataFrame:
    return scan.line_table(_scanned(_files(spark, d)))


def _measured(files: DataFrame, spark, d) -> DataFrame:
    return rules.with_limits(scan.measured(_scanned(files)), table(spark, d, "thresholds")).withColumn("window", F.col("min_duplicate_lines"))


def _numbers(spark, d) -> DataFrame:
    return rep.with_local_repetition(_measured(_files(spark, d), spark, d))


def _stored(spark, d) -> DataFrame:
    return materialize(_numbers(spark, d), "scan")


def _windows(spark, d) -> DataFrame:
    return rep.windows(_measured(_files(spark, d), spark, d))


def _judged(spark, d, files=_files) -> DataFrame:
    return rules.with_issues(rep.with_local_repetition(_measured(files(spark, d), spark, d)), WARNINGS)


def lines_explode(spark, d):
    return _lines(spark, d).select("path", "line")


def line_count(spark, d):
    return _scanned(_files(spark, d)).select("path", F.size("lines").cast("long").alias("lines"))


def line_depth(spark, d):
    return _lines(spark, d).select("path", "line", "depth")


def deep_lines(spark, d):
    return _lines(spark, d).where("depth > 3").select("path", "line", "depth")


def import_count(spark, d):
    return scan.measured(_scanned(_files(spark, d))).select("path", "imports")


def code_lines(spark, d):
    return _lines(spark, d).where("code <> ''").select("path", "line", "code")


def line_hash_groups(spark, d):
    rows = _lines(spark, d).where("code <> ''")
    each = rows.groupBy("code", "path").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("code").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files")).where("n > 1")


def windows_ngram(spark, d):
    return _windows(spark, d).select("path", "start_line", "end_line", "window")


def dup_groups_file(spark, d):
    groups = _windows(spark, d).groupBy("path", "chunk").agg(F.count(F.lit(1)).alias("members"), F.min("start_line").alias("first_line"))
    return groups.where("members > 1").select("path", "first_line", "members")


def dup_groups_project(spark, d):
    groups = _windows(spark, d).groupBy("chunk").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("path", "start_line")).alias("f"))
    return groups.where("members > 1").select(F.col("f.path").alias("first_path"), F.col("f.start_line").alias("first_line"), "members")


def _rounded(df):
    return df.select("path", F.round("repetition", 6).alias("repetition"))


def repetition_local(spark, d):
    return _rounded(_numbers(spark, d))


def _across(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(measures within files, windows, measures with the repetition across files)."""
    s = _stored(spark, d)
    w = materialize(rep.windows(s), "windows")
    return s, w, rep.with_global_repetition(s, rep.group_members(w))


def _judged_across(spark, d) -> DataFrame:
    return rules.with_issues(_across(spark, d)[2], WARNINGS, depth=False)


def repetition_global(spark, d):
    return _rounded(_across(spark, d)[2])


def duplicates_local(spark, d):
    s = _stored(spark, d)
    rows = rep.with_snippets(rep.group_members(materialize(rep.windows(s), "windows"), True), _files(spark, d), s)
    return rows.select("path", F.col("start_line").alias("line"), "members", "first_line", "content")


def duplicates_project(spark, d):
    s = _stored(spark, d)
    rows = rep.with_snippets(rep.group_members(materialize(rep.windows(s), "windows")), _files(spark, d), s)
    return rows.select("path", F.col("start_line").alias("line"), "members", "first_path", "first_line", "content")


def duplicate_places(spark, d):
    """Every member of every group, with the group's first place: all other places of a block
    without a limit, in a form that does not grow with the square of a group."""
    return rep.group_members(materialize(_windows(spark, d), "windows")).select("first_path", "first_line", "path", F.col("start_line").alias("line"))


def _listed(details: DataFrame) -> DataFrame:
    return details.select("path", "line", "content", reports.also_in(F.col("others"), F.col("more")).alias("also_in"))


def inspect_details(spark, d):
    s = _stored(spark, d)
    return _listed(rep.local_details(materialize(rep.windows(s), "windows"), _files(spark, d), s))


def cross_file_details(spark, d):
    """Repeated blocks of inspection across files: a place with a copy in its own file does
    not list those in others."""
    s, w, _ = _across(spark, d)
    local = materialize(rep.local_details(w, _files(spark, d), s), "local")
    return _listed(local.unionByName(rep.cross_file_details(w, _files(spark, d), s, local)))


def cross_file_report(spark, d):
    judged = _judged_across(spark, d)
    return judged.select("path", "lines", "imports", F.round("repetition", 6).alias("repetition"), F.size("issues").cast("long").alias("issues"), "passed")


def report_terminal(spark, d):
    """Repeated blocks as a terminal shows them: the first lines of each."""
    return inspect_details(spark, d).select("path", "line", reports.head_lines(F.col("content")).alias("head"), "also_in")


def file_metrics(spark, d):
    return _numbers(spark, d).select("path", "ext", "lines", "imports", F.col("depth").alias("max_depth"), F.round("repetition", 6).alias("repetition"))


def filter_supported(spark, d):
    return _files(spark, d).select("path", "ext")


def filter_exclude(spark, d):
    return _files(spark, d).where(~scan.is_excluded(F.col("path"), EXCLUDED)).select("path")


def directive_ignore(spark, d):
    return _directed(spark, d).select("path", scan.is_ignored(F.col("content")).alias("ignored"))


def directive_line(spark, d):
    lines = _directed(spark, d).select("path", F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))
    return lines.where(scan.is_line_ignored(F.col("line"))).select("path", (F.col("i") + 1).alias("line"))


def directive_disable(spark, d):
    return _directed(spark, d).select("path", F.explode(scan.disabled_rules(F.col("content"))).alias("rule"))


def lang_catalog(spark, d):
    return catalog(spark).select("name", "ext", "line_comment", "block_open", "block_close", F.array_join("import_keywords", ",").alias("imports"), "indent_size")


def lang_join(spark, d):
    return _files(spark, d).select("ext", pick(F.col("ext"), lambda x: x.name).alias("language")).groupBy("language", "ext").agg(F.count(F.lit(1)).alias("files"))


def _prose(spark, d) -> DataFrame:
    """The subjects as files of an added language, with a comment and an include each."""
    text = F.concat(F.lit("include "), "subject", F.lit(" % "), "subject", F.lit("\n  <!-- "), "title", F.lit("\n --> end\n    % only\n"), "title")
    return table(spark, d, "subjects").select(F.concat("subject", F.lit(".md")).alias("path"), F.lit("md").alias("ext"), text.alias("content"))


def lang_added(spark, d):
    return scan.line_table(scan.scan_lines(_prose(spark, d), [*LANGUAGES, PROSE])).drop("ext")


def strip_added(spark, d):
    return _prose(spark, d).select("path", strip_comments(F.col("content"), F.col("ext"), True, languages=[*LANGUAGES, PROSE]).alias("content"))


def thresholds_resolved(spark, d):
    return rules.with_limits(_files(spark, d).select("path", "ext"), table(spark, d, "thresholds"))


def issues(spark, d):
    return rules.issue_table(rules.with_issues(_numbers(spark, d), depth=False))


def issues_depth(spark, d):
    m = _numbers(spark, d).withColumn("max_depth", F.lit(3))
    return rules.issue_table(rules.with_issues(m)).where("rule = 'max-depth'").select("path", "rule", "message", "severity", "line")


def issues_disabled(spark, d):
    return rules.issue_table(_judged(spark, d, _directed))


def issues_cross_file(spark, d):
    return rules.issue_table(_judged_across(spark, d))


def verdicts(spark, d):
    return _judged(spark, d).select("path", F.size("issues").cast("long").alias("issues"), "passed")


def verdicts_directed(spark, d):
    return _judged(spark, d, _directed).select("path", F.size("issues").cast("long").alias("issues"), "passed")


def project_summary(spark, d):
    return reports.summary(_judged(spark, d))


def gate(spark, d):
    return rules.exit_code(_judged(spark, d))


def gate_empty(spark, d):
    """The result for a project without files of a known language."""
    return rules.exit_code(_judged(spark, d).where("ext = 'none'"))


def report_ranked(spark, d):
    return reports.ranked(_judged(spark, d)).select("path", "passed", F.size("issues").cast("long").alias("issues"), "lines")


def report_quiet(spark, d):
    return reports.quiet(_judged(spark, d))


def report_quiet_summary(spark, d):
    return reports.quiet_summary(_judged(spark, d))


def _inspected(spark, d) -> tuple[DataFrame, DataFrame]:
    """(judged, repeated blocks of files that do not disable the rule)."""
    s = _stored(spark, d)
    kept = s.where(~F.array_contains("disabled", "max-repetition"))
    return rules.with_issues(s, WARNINGS), rep.local_details(materialize(rep.windows(kept), "windows"), _files(spark, d), kept)


def report_problems(spark, d):
    return reports.problems(*_inspected(spark, d))


def report_json(spark, d):
    return reports.json_report(reports.problems(*_inspected(spark, d)))


def report_json_file(spark, d):
    """The report written as a file and read back."""
    folder = f"{shared_folder(spark).rstrip('/')}/plumbline-report-{uuid.uuid4().hex}"
    sinks.write_json_report(report_json(spark, d), folder)
    read = spark.read.text(folder)
    return materialize(read.select(F.get_json_object("value", "$.path").alias("path"), F.regexp_extract("value", r'^\{"path":"(?:[^"\\]|\\.)*","report":(.*)\}$', 1).alias("report")), "report")


def report_full(spark, d):
    """Full reports written as JSON and read back, by the sizes of their lists."""
    folder = f"{shared_folder(spark).rstrip('/')}/plumbline-reports-{uuid.uuid4().hex}"
    full = reports.full_reports(*_inspected(spark, d))
    sinks.write_reports(full, folder)
    read = spark.read.schema(full.schema).json(folder)
    size = lambda c: F.size(F.coalesce(F.col(c), F.slice(F.col(c), 1, 0))).cast("long").alias(c)
    return materialize(read.select("path", "lines", "imports", "max_depth", F.round("repetition", 6).alias("repetition"), "passed", F.greatest(size("issues"), F.lit(0).cast("long")).alias("issues"), F.greatest(size("duplicates"), F.lit(0).cast("long")).alias("duplicates"), F.greatest(size("deep_lines"), F.lit(0).cast("long")).alias("deep_lines")), "reports")


def lsp_diagnostics(spark, d):
    return reports.diagnostics(*_inspected(spark, d))


def lsp_quickfix(spark, d):
    return reports.quick_fixes(reports.diagnostics(_judged(spark, d)), extension_of(F.col("path")))


def lsp_root_filter(spark, d):
    rows = table(spark, d, "files").select(clean_path(F.col("path")).alias("path")).where("path IS NOT NULL").distinct()
    return reports.within_roots(rows, ["zelbre-matinzel/src", "kolforol-kinnor8"])


def strip_aggressive(spark, d):
    return _files(spark, d).select("path", strip_comments(F.col("content"), F.col("ext"), True).alias("content"))


def strip_conservative(spark, d):
    return _files(spark, d).select("path", strip_comments(F.col("content"), F.col("ext"), False).alias("content"))


def strip_rewrite(spark, d):
    """Stripped texts written to a new table and read back."""
    folder = f"{shared_folder(spark).rstrip('/')}/plumbline-stripped-{uuid.uuid4().hex}"
    sinks.write_stripped(_files(spark, d), folder, aggressive=True)
    return spark.read.parquet(folder).select("path", "content")


def _braced(spark, d) -> DataFrame:
    """Every file as jsx, with comments in braces and before braces put around it."""
    text = F.concat(F.lit("f(<a>{ /* one\n two */ }</a>);\n{ g(); /* c */ }\n/* d */\n"), "content", F.lit("\nconst b = { /* x */ y: 1 /* z */\n };\n"))
    return _files(spark, d).select(F.concat("path", F.lit(".jsx")).alias("path"), F.lit("jsx").alias("ext"), text.alias("content"))


def strip_jsx(spark, d):
    return _braced(spark, d).select("path", strip_comments(F.col("content"), F.col("ext"), True).alias("content"))


def strip_jsx_literal(spark, d):
    return _braced(spark, d).select("path", strip_comments(F.col("content"), F.col("ext"), True, literal=True).alias("content"))


def strip_literal(spark, d):
    return _files(spark, d).select("path", strip_comments(F.col("content"), F.col("ext"), False, literal=True).alias("content"))


def normalize_ws(spark, d):
    rows = first_rows(table(spark, d, "documents"), F.col("doc_id"))
    return rows.select("doc_id", normalize_whitespace(F.regexp_replace("text", " ", " ")).alias("text"))


def src_scan(spark, d):
    """This package's own sources, read as a tree."""
    tree = read_tree(spark, os.path.dirname(os.path.abspath(plumbline.__file__)))
    return scan.measured(scan.scan_lines(tree)).select("path", "lines", "imports", F.col("depth").alias("max_depth"))


def utf8_gate(spark, d):
    """Files as bytes, every third with a byte that is no UTF-8 at its end."""
    rows = table(spark, d, "files")
    path = clean_path(F.col("path"))
    rows = first_rows(rows, path, F.col("content").isNotNull()).select(path.alias("path"), "file_id", F.encode("content", "utf-8").alias("content"))
    tail = F.when(F.pmod("file_id", F.lit(3)) == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    return scan.utf8_gate(rows.withColumn("content", F.concat("content", tail))).select("path", "flawed")


# settings put into directories, as the tables hold none: by the smallest file_id at or below
# modulo 13; the ones that are not valid in directories of depth 3 or more only
SETTINGS = {
    0: '{"thresholds": {"global": {"max_lines": 60, "max_depth": 3}, "overrides": {"rs": {"max_imports": 2}, "cpp": {"max_depth": 2}}, "severities": {"max_lines": "warning"}}}',
    1: '{"exclude": ["old", "copy"], "thresholds": {"global": {"max_lines": 400, "max_repetition": 20.0}, "overrides": {"rs": {"max_lines": 50}, "js": {"max_lines": 40, "min_duplicate_lines": 3}}}}',
    2: '{"cross_file_repetition": true, "exclude": [], "thresholds": {"global": {"min_duplicate_lines": 6}, "severities": {"max-lines": "error", "max-depth": "warning", "max_imports": "warning"}}}',
    3: '{"unknown": 1}',
    4: "no json",
    5: '{"thresholds": {"global": {"max_imports": 4, "max_repetition": 5.5}}}',
}
BROKEN = (3, 4)


def _settings(spark, d) -> DataFrame:
    path = clean_path(F.col("path"))
    rows = table(spark, d, "files").where(extension_of(path).isin(scan.supported()) & F.col("content").isNotNull()).select(F.col("file_id").alias("id"), F.split(path, "/").alias("parts"))
    up = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", 1, i), "/"))
    dirs = rows.select("id", F.explode(up).alias("dir")).groupBy("dir").agg(F.pmod(F.min("id"), F.lit(13)).alias("k"))
    deep = F.size(F.split("dir", "/")) >= 3
    body = F.lit(None)
    for k, text in SETTINGS.items():
        body = F.when((F.col("k") == k) & (deep if k in BROKEN else F.lit(True)), text).otherwise(body)
    return materialize(parse_settings(dirs.select("dir", body.alias("body")).where("body IS NOT NULL")), "settings")


def cfg_parse(spark, d):
    return _settings(spark, d).select("dir", "depth", "valid", F.array_join("exclude", ",").alias("exclude"), "cross_file", *rules.DEFAULTS)


def cfg_resolve(spark, d):
    merged, _ = resolve_settings(_settings(spark, d), _files(spark, d).select("dir").distinct())
    return merged.where("NOT broken").drop("broken").withColumn("exclude", F.array_join("exclude", ","))


def cfg_errors(spark, d):
    return config_errors(_settings(spark, d), _files(spark, d).select("dir"))


def cfg_thresholds(spark, d):
    return apply_settings(_files(spark, d).select("path", "ext", "dir"), _settings(spark, d)).select("path", "ext", "cross_file", *rules.DEFAULTS)


def cfg_verdicts(spark, d):
    """Verdicts with the limits, exclusions and severities of every file's directory."""
    m = apply_settings(scan.measured(_scanned(_files(spark, d))), _settings(spark, d)).withColumn("window", F.col("min_duplicate_lines"))
    return rules.with_issues(rep.with_local_repetition(m)).select("path", F.size("issues").cast("long").alias("issues"), "passed")


def _edits(spark, d):
    kind = F.when(F.col("event_type") == "view", "open").otherwise("change")
    return table(spark, d, "events").select(F.col("user_id").alias("uri"), "ts", "event_id", kind.alias("kind"))


def stream_debounce(spark, d):
    return debounce(_edits(spark, d), "6 hours").select("uri", "ts")


def stream_open(spark, d):
    return to_analyse(_edits(spark, d), "6 hours").select("uri", "ts", "kind")


QUERIES = {
    f.__name__: f
    for f in (
        lines_explode, line_count, line_depth, deep_lines, import_count, code_lines, line_hash_groups, windows_ngram, dup_groups_file, dup_groups_project,
        repetition_local, repetition_global, duplicates_local, duplicates_project, duplicate_places, inspect_details, cross_file_details, cross_file_report, report_terminal,
        file_metrics, filter_supported, filter_exclude, directive_ignore, directive_line, directive_disable, lang_catalog, lang_join, lang_added, strip_added, thresholds_resolved,
        issues, issues_depth, issues_disabled, issues_cross_file, verdicts, verdicts_directed, project_summary, gate, gate_empty, report_ranked, report_quiet, report_quiet_summary,
        report_json, report_json_file, report_full, report_problems, lsp_diagnostics, lsp_quickfix, lsp_root_filter, strip_aggressive, strip_conservative, strip_rewrite, strip_jsx,
        strip_jsx_literal, strip_literal, normalize_ws, src_scan, utf8_gate, cfg_parse, cfg_resolve, cfg_errors, cfg_thresholds, cfg_verdicts, stream_debounce, stream_open,
    )
}

from plumbline.plans.analysis_sql import SQL  # noqa: E402,F401
