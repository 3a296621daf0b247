"""Where source files come from: written by hand, generated, minified, vendored, or data.

Belief propagation over directory trees. What is seen of a file is a handful of levels:
markers in its comments by their place (never in strings), how dense its text is, how much
of it is literals, lines that count up, its name, its report's repetition and lines, and
how many of its long lines also stand in files of other projects that are known as
third-party copies. What is seen of a directory is the kind of its name. Labels are
inferred jointly: a file depends on its directory and that on its parent, by
compatibilities that say how likely a child has which label; directories that only lead to
another one are one place with it. As the graph is a forest, one pass of messages up and
one down give exact marginals; each level is an aggregation by directory, so a project
with a third of all files is no single task.

How likely a level is under a label, and the compatibilities, are fitted to the data by
expectation maximization: the marginals of one propagation, summed over all files and
directories, give the tables of the next. The starting tables below count as WEIGHT
observations of each label, so that they decide where there is little data only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import fenced, materialize
from plumbline.sources.tables import clean_path, project_of

LABELS = ["handwritten", "generated", "minified", "vendored", "blob"]
_K = len(LABELS)

# How likely a subdirectory, or a file, has a label (columns, as LABELS) below
# a directory (rows), to start with. Single files stray more than directories do.
BELOW = [
    [0.900, 0.030, 0.020, 0.035, 0.015],
    [0.030, 0.940, 0.010, 0.010, 0.010],
    [0.300, 0.020, 0.600, 0.030, 0.050],
    [0.020, 0.010, 0.010, 0.950, 0.010],
    [0.300, 0.020, 0.030, 0.030, 0.620],
]
INSIDE = [
    [0.800, 0.090, 0.030, 0.060, 0.020],
    [0.120, 0.850, 0.010, 0.010, 0.010],
    [0.300, 0.020, 0.600, 0.030, 0.050],
    [0.080, 0.010, 0.010, 0.890, 0.010],
    [0.300, 0.020, 0.030, 0.030, 0.620],
]
PRIOR = [0.85, 0.05, 0.03, 0.05, 0.02]

# How likely each level is under each label (rows, as LABELS), to start with.
_MARKED = [0.001, 0.001, 0.004, 0.994]  # at an end of the file, near one, inside, nowhere
SEEN = {
    "generated marker": [_MARKED, [0.45, 0.08, 0.05, 0.42], _MARKED, [0.01, 0.002, 0.004, 0.984], _MARKED],
    "third-party marker": [_MARKED, _MARKED, [0.05, 0.01, 0.004, 0.936], [0.35, 0.05, 0.03, 0.57], _MARKED],
    # no, partly, wholly
    "dense": [[0.969, 0.0305, 0.0005], [0.980, 0.019, 0.001], [0.12, 0.03, 0.85], [0.975, 0.020, 0.005], [0.950, 0.030, 0.020]],
    "literals": [[0.969, 0.0305, 0.0005], [0.980, 0.015, 0.005], [0.980, 0.015, 0.005], [0.980, 0.0195, 0.0005], [0.12, 0.03, 0.85]],
    # no, of much repetition by its report, counts up, counts up wholly
    "repetition": [[0.950, 0.0390, 0.0105, 0.0005], [0.50, 0.15, 0.05, 0.30], [0.940, 0.040, 0.010, 0.010], [0.950, 0.0390, 0.0105, 0.0005], [0.890, 0.060, 0.025, 0.025]],
    # any, of generated files, of minified files
    "name": [[0.985, 0.002, 0.013], [0.695, 0.300, 0.005], [0.580, 0.010, 0.410], [0.965, 0.005, 0.030], [0.985, 0.002, 0.013]],
    # hardly any, some, most of its long lines
    "copied": [[0.970, 0.029, 0.001], [0.985, 0.014, 0.001], [0.980, 0.010, 0.010], [0.450, 0.100, 0.450], [0.985, 0.010, 0.005]],
    # any, of a few lines only by its report, where the text could not be read
    "short": [[0.970, 0.030], [0.970, 0.030], [0.650, 0.350], [0.970, 0.030], [0.960, 0.040]],
}
# any, and those of the lists below
DIRECTORY = [
    [0.4450, 0.5300, 0.0005, 0.0120, 0.0005, 0.0120],
    [0.3500, 0.0900, 0.5500, 0.0040, 0.0010, 0.0050],
    [0.6000, 0.0900, 0.0010, 0.3000, 0.0020, 0.0070],
    [0.4000, 0.0900, 0.0010, 0.0050, 0.5000, 0.0040],
    [0.5500, 0.0900, 0.0010, 0.0050, 0.0040, 0.3500],
]
#: Observations of each label that the starting tables count as, and the least chance of any level.
WEIGHT, LEAST = 200.0, 1e-4

# Whole directory names that tools and package managers use, in lower case.
GENERATED_DIRS = ["generated", "generated-sources", "generated_sources", "__generated__", "autogen", "codegen", "gen", "obj", "target"]
VENDOR_DIRS = ["vendor", "third_party", "third-party", "thirdparty", "3rdparty", "deps", "pods", "godeps", "_workspace", "node_modules", "bower_components", "external", "extern", "contrib", "jspm_packages", "carthage"]
MINIFIED_DIRS = ["dist", "static", "public"]
BLOB_DIRS = ["data", "assets", "fixtures", "resources"]
SOURCE_DIRS = ["src", "lib", "app", "core", "pkg", "internal", "modules", "tools", "tests", "test", "main", "source", "include", "cmd", "scripts", "examples"]
# Endings of file names (before or with the extension) that tools give.
GENERATED_NAME = r"(?i)([._]pb2?|[._-](g|gen|generated|autogen|designer)|OuterClass)\.[A-Za-z0-9]+$"
MINIFIED_NAME = r"(?i)[.-](min|bundle|prod)\.[A-Za-z0-9]+$"

# Wordings of markers, in lower case.
_GENERATED = re.compile(
    r"@generated|<auto-?generated|^\W*auto-?generated|(?:file|code|is|was|been) (?:is |was |has been )?(?:automatically |auto-?)?generated|^\W*generated (?:by|from)|machine[- ](?:written|generated)|do not (?:edit|modify)|not survive|manual edits|edits? (?:will be|are) (?:lost|overwritten)"
    r"|(?:changes?|edits?) (?:will|would) be lost|automatisch (?:erzeugt|generiert)|nicht von hand|produit par un outil|ne pas modifier|généré"
)
_VENDORED = re.compile(
    r"copied from the \S+ project|imported from \S+@|send fixes upstream|upstream (?:revision|commit|version)|distributed by the \S+ authors|\(c\) the \S+ contributors|file is part of \S+\.?$|third[- ]party copy"
)
_COMMENT = re.compile(r"^\s*(?://|#(?!\s*include|!)|--|/\*|\*|;|<!--|%)")
_NUMBER = re.compile(r"\d+")
_LITERAL = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|\b\d[\w.]*\b")
#: Code lines between a marker and the nearer end of its file from which on it is inside.
NEAR = 16
#: How long a code line has to be to identify a file.
KEY_LENGTH = 24
#: Steps of one in a row that a count takes at least.
COUNT = 16


def _place(hits: list[int], before: list[int], n: int) -> int:
    """Level of markers, given the code lines before each line and in all."""
    if not hits:
        return 3
    gap = min(min(before[i], n - before[i]) for i in hits)
    return 0 if gap == 0 else 1 if gap < NEAR else 2


def counting(code: list[str]) -> int:
    """Whether lines that differ in a number which goes up by one run through a text, and
    whether next to all of its lines are repeated apart from numbers. Lines that come again
    as they are do not count up."""
    last: dict[str, list[int]] = {}
    steps: dict[str, int] = {}
    most = 0
    for x in code:
        if found := _NUMBER.findall(x):
            shape, numbers = _NUMBER.sub("#", x), [int(n[-18:]) for n in found]
            up = any(b == a + 1 for a, b in zip(last.get(shape, ()), numbers))
            steps[shape] = steps.get(shape, 0) + 1 if up else 0
            most = max(most, steps[shape])
            last[shape] = numbers
    if most < COUNT:
        return 0
    return 3 if len({_NUMBER.sub("#", x) for x in code}) < 0.15 * len(code) else 2


def text_levels(text: str) -> tuple[list[int], list[int]]:
    """Levels of the first five of SEEN (-1: cannot be told), and the hashes of the file's
    distinct long code lines. The whole text is looked at."""
    lines = [x for x in text.replace("\r\n", "\n").split("\n") if x.strip()]
    size = sum(map(len, lines))
    if not size:
        return [-1] * 5, []
    before, code, notes = [], [], []
    for i, x in enumerate(lines):
        before.append(len(code))
        if _COMMENT.match(x):
            notes.append((i, x.lower()))
        else:
            code.append(x.strip())
    marks = [_place([i for i, x in notes if m.search(x)], before, len(code)) for m in (_GENERATED, _VENDORED)]
    body = "\n".join(code)
    chars = max(1, len(body))
    blanks = body.count(" ") + body.count("\t")
    long = [len(x) for x in lines if len(x) > 160]
    others = sum(len(x) <= 160 and not _COMMENT.match(x) for x in lines)
    literal = sum(map(len, _LITERAL.findall(body))) / max(1, len(body) - blanks)
    # one odd line may hold most of a text, so that lines count as well as characters
    dense = 0 if sum(long) <= 0.85 * size else 2 if blanks < 0.12 * chars and len(long) >= others else 1
    plain = body.count("(") < 0.002 * chars
    rows = sum(map(_mostly_literal, code))
    # a table opens and closes with a line of its own
    data = 0 if literal <= 0.65 else 2 if plain and len(code) - rows <= max(2, rows) else 1
    lead = {x for x in code if len(x) >= KEY_LENGTH}
    # a table of literals has long lines and few blanks, too, and may count
    levels = [*marks, 0 if data == 2 else dense, data, 0 if data == 2 else counting(code)]
    return levels, np.array([hash_line(x) for x in lead], np.uint64).view(np.int64).tolist()


def _mostly_literal(line: str) -> bool:
    return sum(map(len, _LITERAL.findall(line))) > 0.5 * (len(line) - line.count(" "))


def hash_line(line: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        levels, keys = [], []
        for text in batch.column("content").to_pylist():
            s, k = text_levels(text) if text is not None else ([-1] * 5, [])
            levels.append(s)
            keys.append(k)
        cols = {"file_id": batch.column("file_id"), "path": batch.column("path"), "levels": pa.array(levels, pa.list_(pa.int32())), "keys": pa.array(keys, pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_pydict(cols)


@dataclass(frozen=True)
class Tables:
    """Chances of levels under labels, and of labels of children below labels of parents."""

    seen: tuple[np.ndarray, ...]
    directory: np.ndarray
    below: np.ndarray
    inside: np.ndarray
    prior: np.ndarray


def _rows(table) -> np.ndarray:
    t = np.array(table, float)
    return t / t.sum(-1, keepdims=True)


START = Tables(tuple(_rows(t) for t in SEEN.values()), _rows(DIRECTORY), _rows(BELOW), _rows(INSIDE), _rows(PRIOR))


# Expressions are spelled out as SQL, which is built at once and not call by call.
def _each(pattern: str) -> list[str]:
    """The pattern for every label, whose number stands in for #."""
    return [pattern.replace("#", str(i)) for i in range(_K)]


def _total(pattern: str, weights: np.ndarray) -> str:
    return " + ".join(f"{w:.17g}D * {x}" for w, x in zip(weights, _each(pattern)))


def _scaled(df: DataFrame, source: str, target: str) -> DataFrame:
    """df with target0.. = exp(source0.. - their maximum `target`top). Steps of their own
    keep the generated code small."""
    df = df.selectExpr("*", f"greatest({', '.join(_each(f'{source}#'))}) AS {target}top")
    return df.selectExpr("*", *_each(f"exp({source}# - {target}top) AS {target}#"))


def _message(df: DataFrame, source: str, target: str, table: np.ndarray) -> DataFrame:
    """df with target0..: for each row of table the log of the sum over its columns times
    exp(source)."""
    df = _scaled(df, source, "_e")
    sums = [f"ln({_total('_e#', row)}) + _etop AS {target}{y}" for y, row in enumerate(table)]
    return df.selectExpr("*", *sums).drop("_etop", *_each("_e#"))


def _logs(chances: np.ndarray, level: str) -> str:
    return f"get(array({', '.join(f'{x:.17g}D' for x in np.log(chances))}), {level})"


def _seen(tables: tuple[np.ndarray, ...]) -> list[str]:
    """Log likelihood f0.. of `levels` under each label; a level of -1 says nothing."""
    return [" + ".join(f"coalesce({_logs(t[label], f'get(levels, {i})')}, 0D)" for i, t in enumerate(tables)) + f" AS f{label}" for label in range(_K)]


def _pair_sums(df: DataFrame, parent: str, child: str, table: np.ndarray) -> np.ndarray:
    """Expected number of pairs of labels, summed over edges with the beliefs parent0.. and
    child0.. (logs, each without what the other sent)."""
    df = _scaled(_scaled(df, parent, "_p"), child, "_c")
    pairs = [(y, x) for y in range(_K) for x in range(_K)]
    df = df.selectExpr(*[f"{table[y][x]:.17g}D * _p{y} * _c{x} AS j{i}" for i, (y, x) in enumerate(pairs)])
    df = df.selectExpr("*", " + ".join(f"j{i}" for i in range(len(pairs))) + " AS total")
    row = df.selectExpr(*[f"sum(j{i} / total)" for i in range(len(pairs))]).first()
    return np.array([x or 0.0 for x in row]).reshape(_K, _K)


def _level_sums(df: DataFrame, level: str, tables: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Expected number of each level under each label, of df(r0.., ...); level is an array."""
    rows = df.selectExpr(f"posexplode({level}) AS (i, level)", *_each("r#")).where("level >= 0")
    sums = [np.zeros_like(t) for t in tables]
    for x in rows.groupBy("i", "level").agg(*[F.expr(e) for e in _each("sum(r#) AS r#")]).collect():
        sums[x.i][:, x.level] = [x[c] for c in _each("r#")]
    return sums


def _marginals(df: DataFrame, logs: str) -> DataFrame:
    df = _scaled(df, logs, "_m")
    df = df.selectExpr("*", " + ".join(_each("_m#")) + " AS _msum")
    return df.selectExpr("*", *_each("_m# / _msum AS r#")).drop("_mtop", "_msum", *_each("_m#"))


class _Forest:
    """files(file_id, path, dir, levels) and dirs(dir, parent, depth, levels)."""

    def __init__(self, files: DataFrame, dirs: DataFrame):
        self.files, self.dirs = files, dirs
        self.deepest = dirs.agg(F.max("depth")).first()[0] or 0

    def propagate(self, t: Tables) -> tuple[DataFrame, DataFrame]:
        """(files, dirs) with the logs f0.. of what is seen, c0.. of what the parent believes
        without it, and j0.. of both together."""
        own = self.files.selectExpr("file_id", "path", "dir", "levels", *_seen(t.seen))
        own = materialize(_message(own, "f", "m", t.inside), "files")
        total = [F.expr(e) for e in _each("sum(m#) AS m#")]
        sent = own.where("dir IS NOT NULL").groupBy("dir").agg(*total)
        names = [f"coalesce(m{i}, 0D) + aggregate(levels, 0D, (a, x) -> a + {_logs(row, 'x')}) AS b{i}" for i, row in enumerate(t.directory)]
        dirs = materialize(self.dirs.join(sent, "dir", "left").selectExpr("dir", "parent", "depth", "levels", *names), "dirs")

        # b: what is seen at and below a directory; u: what it sends to its parent
        levels: dict[int, DataFrame] = {}
        for depth in range(self.deepest, 0, -1):
            level = dirs.where(F.col("depth") == depth)
            if depth < self.deepest:
                below = levels[depth + 1].groupBy(F.col("parent").alias("dir")).agg(*[F.expr(e) for e in _each("sum(u#) AS u#")])
                level = level.join(below, "dir", "left").selectExpr("dir", "parent", "depth", "levels", *_each("b# + coalesce(u#, 0D) AS b#"))
            levels[depth] = materialize(_message(level, "b", "u", t.below), "up")
        every = last = None
        prior = [f"{x:.17g}D" for x in np.log(t.prior)]
        for depth in range(1, self.deepest + 1):
            level = levels[depth]
            if depth == 1:
                level = level.selectExpr("*", *[f"{p} AS c{i}" for i, p in enumerate(prior)], *[f"{p} AS d{i}" for i, p in enumerate(prior)])
            else:
                above = last.selectExpr("dir AS parent", *_each("j# AS p#"))
                level = _message(level.join(above, "parent").selectExpr("*", *_each("p# - u# AS c#")), "c", "d", t.below.T)
            last = materialize(level.selectExpr("dir", "depth", "levels", *_each("b#"), *_each("c#"), *_each("b# + d# AS j#")), "down")
            every = last if every is None else every.unionByName(last)
        if every is None:
            every = dirs.selectExpr("dir", "depth", "levels", *_each("b#"), *_each("b# AS c#"), *_each("b# AS j#"))

        joined = own.join(every.selectExpr("dir", *_each("j# AS p#")), "dir", "left").selectExpr("*", *_each("p# - m# AS c#"))
        joined = _message(joined, "c", "d", t.inside.T)
        both = [f"f{i} + coalesce(d{i}, {p}) AS j{i}" for i, p in enumerate(prior)]
        files = joined.selectExpr("file_id", "path", "dir", "levels", *_each("f#"), *_each("c#"), *both)
        return materialize(files, "marginals"), every

    def fit(self, t: Tables) -> Tables:
        """The tables that the marginals under t suggest, START counting as WEIGHT rows."""
        files, dirs = self.propagate(t)
        blend = lambda sums, start: _rows(np.maximum(_rows(sums + WEIGHT * start), LEAST))
        seen = _level_sums(_marginals(files, "j"), "levels", t.seen)
        names = _marginals(dirs, "j").selectExpr("explode(levels) AS level", *_each("r#"))
        directory = _level_sums(names, "array(level)", (t.directory,))[0]
        inside = _pair_sums(files.where("dir IS NOT NULL"), "c", "f", t.inside)
        below = _pair_sums(dirs.where("depth > 1"), "c", "b", t.below)
        roots = _marginals(dirs.where("depth = 1"), "j").selectExpr(*_each("sum(r#)")).first()
        prior = np.array([x or 0.0 for x in roots])
        return Tables(tuple(blend(s, x) for s, x in zip(seen, START.seen)), blend(directory, START.directory), blend(below, START.below), blend(inside, START.inside), blend(prior, START.prior))


def file_labels(files: DataFrame, reports: DataFrame | None = None, rounds: int = 1) -> DataFrame:
    """(file_id, path, label, confidence) of every file of files(file_id, path, content).

    reports(file_id, lines, repetition, run_ts) is optional; the latest report of a file
    counts. `rounds` is how often the tables are fitted. Null content leaves a file to its
    name, its report and its surroundings, a null path (or one without a directory) leaves
    it to its text. Resent rows count once; rows with a null file_id are left out; other
    columns are not looked at; an empty table gives no rows. Ties between labels go to the
    first of LABELS."""
    seen = files.where("file_id IS NOT NULL").select(F.col("file_id").cast("long"), "path", "content")
    seen = seen.mapInArrow(_evidence, "file_id long, path string, levels array<int>, keys array<long>").dropDuplicates(["file_id"])
    path = clean_path(F.col("path"))
    seen = materialize(seen.withColumn("path", path).withColumn("dir", F.nullif(F.regexp_replace("path", "/?[^/]*$", ""), F.lit(""))), "evidence")

    # third-party copies: long lines that files of several projects share, some of them known
    in_vendor = F.coalesce(F.exists(F.split(F.lower("dir"), "/"), lambda x: x.isin(VENDOR_DIRS)), F.lit(False))
    known = (in_vendor | F.col("levels")[1].isin(0, 1)).cast("long")
    keyed = seen.select("file_id", project_of(F.col("path")).alias("project"), known.alias("known"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("project").alias("p"), F.max("project").alias("q"), F.count(F.lit(1)).alias("n"), F.sum("known").alias("votes"))
    shared = shared.where("p <> q AND votes > 0 AND votes >= 0.15 * n").select("key")
    copies = keyed.join(shared, "key", "left_semi").groupBy("file_id").agg(F.count(F.lit(1)).alias("copied"))

    own = seen.join(copies, "file_id", "left")
    if reports is not None:
        latest = reports.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max_by("repetition", "run_ts").alias("repetition"), F.max_by("lines", "run_ts").alias("lines"))
        own = own.join(latest, "file_id", "left")
    else:
        own = own.withColumn("repetition", F.lit(None).cast("double")).withColumn("lines", F.lit(None).cast("long"))
    name = F.regexp_extract("path", "[^/]*$", 0)
    part = F.coalesce(F.col("copied"), F.lit(0)) / F.size("keys")
    unknown = F.lit(-1)
    counts, repeats = F.get("levels", F.lit(4)), F.when(F.col("repetition") > 25, 1).when(F.col("repetition").isNotNull(), 0)
    more = [
        F.when(counts > 0, counts).otherwise(F.coalesce(repeats, counts)),
        F.when(name.isNull(), unknown).when(name.rlike(GENERATED_NAME), 1).when(name.rlike(MINIFIED_NAME), 2).otherwise(0),
        F.when(F.size("keys") == 0, unknown).when(part >= 0.4, 2).when(part >= 0.1, 1).otherwise(0),
        F.when((counts >= 0) | F.col("lines").isNull(), unknown).when(F.col("lines") <= 4, 1).otherwise(0),
    ]
    own = materialize(own.select("file_id", "path", "dir", F.concat(F.slice("levels", 1, 4), F.array(*more)).alias("levels")), "levels")

    # the places of the tree are directories that hold files or branch; one that only leads to
    # another is one place with it, so that the depth is that of the branching
    parts = F.split("dir", "/")
    depth = F.size(parts)
    above = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    held = own.where("dir IS NOT NULL").select("dir").distinct()
    every = held.select(F.explode(above(depth)).alias("at"), "dir").groupBy("at").agg(F.max(F.col("at") == F.col("dir")).alias("holds"))
    every = materialize(every.select(F.col("at").alias("dir"), "holds"), "directories")
    branches = every.where(F.instr("dir", "/") > 0).groupBy(F.regexp_replace("dir", "/[^/]*$", "").alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    places = materialize(every.join(branches, "dir", "left").where("holds OR n > 1").select("dir"), "places")
    up = places.where(depth > 1).select("dir", F.explode(above(depth - 1)).alias("up")).join(places.withColumnRenamed("dir", "up"), "up")
    nearest = up.groupBy("dir").agg(F.max_by("up", F.length("up")).alias("parent"), F.count(F.lit(1)).alias("n"))
    dirs = places.join(nearest, "dir", "left")
    taken = F.coalesce(F.size(F.split("parent", "/")), F.lit(0))
    kind = lambda name: F.coalesce(*[F.when(F.lower(name).isin(names), i) for i, names in enumerate((SOURCE_DIRS, GENERATED_DIRS, MINIFIED_DIRS, VENDOR_DIRS, BLOB_DIRS), 1)], F.lit(0))
    names = F.slice(parts, taken + 1, depth)
    dirs = dirs.select("dir", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("depth"), "parent", F.transform(names, kind).alias("levels"))
    forest = _Forest(own, materialize(dirs, "tree"))

    tables = START
    for _ in range(rounds):
        tables = forest.fit(tables)
    joint = _marginals(forest.propagate(tables)[0], "j")
    joint = joint.selectExpr("file_id", "path", *_each("r#"), f"greatest({', '.join(_each('r#'))}) AS confidence")
    label = F.coalesce(*[F.when(F.col(f"r{i}") == F.col("confidence"), F.lit(x)) for i, x in enumerate(LABELS)])
    return fenced(joint.select("file_id", "path", label.alias("label"), "confidence"), "label", "confidence")
