"""Source trees and single files as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.languages import LANGUAGES, Language, supported
from plumbline.operators.config import ancestors
from plumbline.operators.scan import directory_of, utf8_gate
from plumbline.session import materialize, small
from plumbline.sources.tables import extension_of


#: Fixed value: the name of a settings file.
SETTINGS = ".swtrc"


#: Bytes of file contents that a task holds at once, besides one file.
HELD = 16 << 20


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of the files below root, relative to it. Names that begin with a dot are
    hidden and left out; those with an underscore, which Spark's own readers hide, are not.
    One level of directories after the other is listed on the executors."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for d in batch.column("dir").to_pylist():
                found = [x for x in system.get_file_info(fs.FileSelector("/".join(x for x in (base.rstrip("/"), d) if x))) if not x.base_name.startswith(".")]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([f"{d}/{x.base_name}" if d else x.base_name for x in found], pa.string()),
                    "size": pa.array([x.size if x.type == fs.FileType.File else None for x in found], pa.int64()),
                })

    level, files = spark.createDataFrame([("",)], "dir string"), None
    while True:
        found = materialize(level.mapInArrow(listed, "path string, size long"), "listed")
        here = found.where("size IS NOT NULL")
        files = here if files is None else files.unionByName(here)
        level = found.where("size IS NULL").select(F.col("path").alias("dir"))
        if level.isEmpty():
            return files
        level = level.repartition(spark.sparkContext.defaultParallelism)


def read_tree(spark: SparkSession, root: str, exclude: list[str] = (), languages: Sequence[Language] = LANGUAGES, ignore: bool = False) -> DataFrame:
    """(path, ext, dir, content, flawed) of the supported files below root; paths are relative
    to it.

    Extensions and exclusions are decided on the path, before any content is read. Small
    files that are not valid UTF-8 are left out. With ignore, so are files that the ignore
    files at and above their directory name; see read_ignored."""
    directory = directory_of(F.col("path"))
    rows = list_tree(spark, root).where(extension_of(F.col("path")).isin(supported(languages))).select("path")
    for pattern in exclude:
        rows = rows.where(~F.col("path").contains(pattern))
    if ignore:
        rows = rows.join(small(read_ignored(rows.select("path", directory.alias("dir")), root)), "path", "left_anti")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        paths, contents, held = [], [], 0
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            with system.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                contents.append(f.read())
            paths.append(path)
            held += len(contents[-1])
            if held >= HELD:
                yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())})
                paths, contents, held = [], [], 0
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())})

    contents = rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(read, "path string, content binary")
    return utf8_gate(contents).select("path", extension_of(F.col("path")).alias("ext"), directory.alias("dir"), "content", "flawed")


def ignore_patterns(text: str) -> list[tuple[bool, str]]:
    """(negated, regular expression on the path below the file's directory) for the lines of
    an ignore file: blank lines and comments are none; a slash at the start or inside ties
    a pattern to the directory; one at the end means directories; * and ? stop at slashes,
    ** does not."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        folder, tied = line.endswith("/"), "/" in line.rstrip("/")
        parts = re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\])", line.strip("/"))
        known = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        body = "".join(known.get(p) or (p.replace("[!", "[^") if p.startswith("[") and p.endswith("]") else re.escape(p)) for p in parts)
        out.append((negated, ("" if tied else "(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?")))
    return out


def is_named(path: str, files: dict[str, str]) -> bool:
    """Whether the ignore files, by directory, leave a path out: of all patterns that fit,
    from the root down and line by line, the last decides."""
    named = False
    for d in ["", *("/".join(path.split("/")[:i]) for i in range(1, path.count("/") + 1))]:
        below = path[len(d) + 1 :] if d else path
        for negated, pattern in ignore_patterns(files.get(d, "")):
            if re.fullmatch(pattern, below):
                named = not negated
    return named


def read_ignored(paths: DataFrame, root: str, name: str = ".gitignore") -> DataFrame:
    """(path) of paths(path, dir) that ignore files leave out. An ignored directory cannot be
    opened again by a pattern below it only if a pattern names what lies in it."""
    found = read_settings(paths, root, name)
    each = ancestors(paths).join(small(found), "dir").groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("dir", "body"))).alias("files"))
    rows = paths.join(small(each.withColumnRenamed("target", "dir")), "dir").select("path", "files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("path").to_pylist(), batch.column("files").to_pylist())
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, files in pairs if is_named(p, dict(files))], pa.string())})

    return rows.mapInArrow(run, "path string")


def read_settings(dirs: DataFrame, root: str, name: str = SETTINGS) -> DataFrame:
    """(dir, body) of the settings files in the directories of dirs(dir), relative to root,
    and in all above them. Spark's readers skip hidden names, so every directory is asked
    for its file; this runs on the executors, for distinct directories only."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            found, bodies = [], []
            for d in batch.column("dir").to_pylist():
                try:
                    with system.open_input_stream("/".join(x for x in (base.rstrip("/"), d, name) if x)) as f:
                        bodies.append(f.read().decode("utf-8", "replace"))
                    found.append(d)
                except FileNotFoundError:
                    pass
            yield pa.RecordBatch.from_pydict({"dir": pa.array(found, pa.string()), "body": pa.array(bodies, pa.string())})

    return ancestors(dirs).select("dir").distinct().mapInArrow(fetch, "dir string, body string")
