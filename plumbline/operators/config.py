"""Hierarchical settings: one JSON text per directory, merged from the root to the leaf,
and applied to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.languages import settings_extension
from plumbline.operators.rules import DEFAULTS, RULES, severity_column
from plumbline.operators.scan import is_excluded
from plumbline.session import materialize, small

# Directories left out where a settings file does not say, and its keys.
DEFAULT_EXCLUDE = ["node_modules", "vendor", "dist", "target", "__pycache__", "build", ".git"]
TOP_KEYS = ["$schema", "exclude", "thresholds", "cross_file_repetition"]
THRESHOLD_KEYS = ["global", "overrides", "severities"]

_LIMITS = "max_lines bigint, max_depth bigint, max_imports bigint, max_repetition double, min_duplicate_lines bigint"
_SCHEMA = (
    f"exclude array<string>, cross_file_repetition boolean, thresholds struct<global:struct<{_LIMITS.replace(' ', ':').replace(',:', ',')}>,"
    f"overrides:map<string,struct<{_LIMITS.replace(' ', ':').replace(',:', ',')}>>,severities:map<string,string>>"
)


def parse_settings(rows: DataFrame) -> DataFrame:
    """(dir, depth, valid, exclude, cross_file, global, overrides, severities) of rows(dir, body).

    A text that is no JSON object, has an unknown key, a severity other than error and
    warning, or a block size below 1 is not valid and has no settings. Severities may be
    spelled with - or _."""
    keys = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    known = lambda c, names: F.size(F.array_except(keys(c), F.array(*map(F.lit, names)))) == 0
    part = lambda path: F.get_json_object("body", path)
    parsed = rows.withColumn("s", F.from_json("body", _SCHEMA))
    sev = F.map_from_entries(F.array_distinct(F.transform(F.map_entries("s.thresholds.severities"), lambda e: F.struct(F.replace(e["key"], F.lit("_"), F.lit("-")).alias("key"), e["value"].alias("value")))))
    block = F.coalesce(F.col("s.thresholds.global.min_duplicate_lines"), F.lit(1)) >= 1
    valid = F.json_object_keys("body").isNotNull() & F.col("s").isNotNull() & known(F.col("body"), TOP_KEYS) & known(part("$.thresholds"), THRESHOLD_KEYS) & known(part("$.thresholds.global"), list(DEFAULTS)) & block
    valid = F.coalesce(valid & F.coalesce(F.forall(F.map_values("s.thresholds.severities"), lambda x: x.isin("error", "warning")), F.lit(True)), F.lit(False))
    kept = lambda c: F.when(F.col("valid"), c)
    exclude = F.coalesce("s.exclude", F.array(*map(F.lit, DEFAULT_EXCLUDE)))
    return parsed.withColumn("valid", valid).select(
        "dir", _depth(F.col("dir")).alias("depth"), "valid", kept(exclude).alias("exclude"), kept(F.coalesce("s.cross_file_repetition", F.lit(False))).alias("cross_file"),
        *[kept(F.nullif(F.col(f"s.thresholds.global.{c}"), F.lit(v).cast("double" if isinstance(v, float) else "bigint"))).alias(c) for c, v in DEFAULTS.items()],
        kept(F.col("s.thresholds.overrides")).alias("overrides"), kept(sev).alias("severities"),
    )


def _depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def ancestors(dirs: DataFrame) -> DataFrame:
    """(target, dir, depth): every directory with itself and all above it; '' is the root."""
    parts = F.split("dir", "/")
    n = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    up = F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = dirs.select("dir").distinct().select(F.col("dir").alias("target"), F.explode(up).alias("dir"))
    return rows.withColumn("depth", _depth(F.col("dir")))


def resolve_settings(settings: DataFrame, dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, overrides) of every directory of dirs(dir) that has settings at or above it.

    merged: (dir, broken, exclude, cross_file, limits..., severity of each rule). broken says
    that the settings of the directory or of one above are not valid, in which case nothing
    else counts. A limit is the one nearest to the directory that is not the built-in
    default, else null; exclusions add up from the root to the leaf; cross_file is on if it
    is anywhere. overrides: (dir, ext, limits...), of which the nearest one for an extension
    counts as a whole."""
    rows = ancestors(dirs).join(small(settings.drop("depth")), "dir")
    nearest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c)
    columns = [severity_column(r) for r in RULES]
    sev = rows.select("*", *[F.try_element_at("severities", F.lit(r)).alias(c) for r, c in zip(RULES, columns)])
    lists = F.transform(F.array_sort(F.collect_list(F.struct("depth", "exclude"))), lambda x: x["exclude"])
    merged = sev.groupBy("target").agg(F.bool_or(~F.col("valid")).alias("broken"), F.flatten(lists).alias("exclude"), F.bool_or("cross_file").alias("cross_file"), *[nearest(c) for c in [*DEFAULTS, *columns]])
    each = rows.where("valid").select("target", "depth", F.explode("overrides").alias("ext", "limits"))
    overrides = each.groupBy("target", "ext").agg(F.max_by("limits", "depth").alias("l")).select(F.col("target").alias("dir"), "ext", "l.*")
    return merged.withColumnRenamed("target", "dir"), overrides


def config_errors(settings: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, files): the directories whose settings are not valid, and how many of files(dir,
    ...) lie in or below them. These files are not analysed."""
    broken = settings.where("NOT valid").select("dir")
    counts = files.groupBy(F.col("dir").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    below = ancestors(counts.select(F.col("target").alias("dir"))).join(small(broken), "dir").join(counts, "target").groupBy("dir").agg(F.sum("n").alias("files"))
    return broken.join(below, "dir", "left").select("dir", F.coalesce("files", F.lit(0)).alias("files"))


def apply_settings(files: DataFrame, settings: DataFrame) -> DataFrame:
    """files(path, ext, dir, ...) with the limits, cross_file and severities that hold for
    them: the override for the extension, else the merged limit of the directory, else the
    built-in one. Files at or below a directory with settings that are not valid, and files
    whose path holds an exclusion, are left out; see config_errors.

    Settings are resolved for distinct directories. files should have no texts, which a
    join with many directories would shuffle."""
    merged, overrides = resolve_settings(settings, files.select("dir").distinct())
    merged, overrides = materialize(merged, "merged"), materialize(overrides, "overrides")
    return settings_of_files(files, merged, overrides)


def settings_of_files(files: DataFrame, merged: DataFrame, overrides: DataFrame) -> DataFrame:
    """apply_settings with the results of resolve_settings."""
    limits, columns = list(DEFAULTS), [severity_column(r) for r in RULES]
    over = overrides.select("dir", F.col("ext").alias("_key"), *[F.col(c).alias(f"_o_{c}") for c in limits])
    held = merged.select("dir", "broken", F.col("exclude").alias("_exclude"), "cross_file", *limits, *columns)
    rows = files.withColumn("_key", settings_extension(F.col("ext"))).join(small(held), "dir", "left").join(small(over), ["dir", "_key"], "left")
    rows = rows.where(~F.coalesce("broken", F.lit(False)) & ~is_excluded(F.col("path"), F.col("_exclude")))
    resolved = [F.coalesce(f"_o_{c}", c, F.lit(v)).alias(c) for c, v in DEFAULTS.items()]
    return rows.select(*[c for c in files.columns if c not in limits], *resolved, F.coalesce("cross_file", F.lit(False)).alias("cross_file"), *columns)
