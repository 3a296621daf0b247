"""Writers. None of them writes in place: a path that exists is an error unless mode says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.languages import LANGUAGES, Language
from plumbline.functions.lexing import strip_comments


def write_json_report(reported: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """reports.json_report's rows as JSON lines {"path": ..., "report": ...}, report being an
    object or an array; files are ordered by path, and so are the lines in each."""
    line = F.concat(F.lit('{"path":'), F.to_json(F.array("path")).substr(F.lit(2), F.length(F.to_json(F.array("path"))) - 2), F.lit(',"report":'), F.col("report"), F.lit("}"))
    reported.orderBy("path").select(line.alias("value")).write.mode(mode).text(path)


def write_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """reports.full_reports' rows as JSON lines."""
    reports.write.mode(mode).option("compression", "gzip").json(path)


def write_stripped(files: DataFrame, path: str, aggressive: bool = False, languages: Sequence[Language] = LANGUAGES, mode: str = "errorifexists") -> None:
    """files(path, ext, content) with their comments removed, as a new table."""
    files.select("path", "ext", strip_comments(F.col("content"), F.col("ext"), aggressive, languages=languages).alias("content")).write.mode(mode).parquet(path)
