"""Scanning source files: lines, depth, imports and comment-free code lines, in one row per
file and without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.languages import LANGUAGES, Language, pick, supported
from plumbline.functions.lexing import code_text, let, masked_text, raw_text, scanner_tokens
from plumbline.sources.tables import clean_path, extension_of, first_rows

# The directives, and in how many first lines they are looked for.
IGNORE_TAG, IGNORE_LINES = "@sweetignore", 10
DISABLE_TAG, DISABLE_LINES = "@swt-disable", 20
# Fixed value: the characters of the Unicode property White_Space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Text files below this size have to be valid UTF-8 to be analysed.
SMALL_BYTES = 16 * 1024


def directory_of(path: Column) -> Column:
    """The directory of a path; '' is the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def source_files(files: DataFrame, languages: Sequence[Language] = LANGUAGES) -> DataFrame:
    """(path, ext, dir, content) of a file-based table files(path, content, ...) for the
    files of the languages, each path once. ext and dir are those of the path. Files without
    a path or content are left out. Contents are not shuffled; see first_rows."""
    path = clean_path(F.col("path"))
    known = extension_of(path).isin(supported(languages)) & F.col("content").isNotNull()
    rows = first_rows(files, path, known).select(path.alias("path"), "content")
    return rows.select("path", extension_of(F.col("path")).alias("ext"), directory_of(F.col("path")).alias("dir"), "content")


def utf8_gate(files: DataFrame) -> DataFrame:
    """files(path, content BINARY) without small files that are not valid UTF-8; larger ones
    are kept with the invalid parts replaced and `flawed` set. content becomes a string."""
    valid = F.is_valid_utf8(F.col("content"))
    kept = files.where(valid | (F.length("content") >= SMALL_BYTES))
    return kept.withColumn("flawed", ~valid).withColumn("content", F.make_valid_utf8(F.col("content")))


def first_lines(content: Column, n: int) -> Column:
    return F.slice(F.split(content, "\n", -1), 1, n)


def is_ignored(content: Column) -> Column:
    return F.exists(first_lines(content, IGNORE_LINES), lambda x: x.contains(IGNORE_TAG))


def is_line_ignored(line: Column) -> Column:
    """Whether a single line carries the directive. Nothing in the analysis asks for it."""
    return line.contains(IGNORE_TAG)


def disabled_rules(content: Column) -> Column:
    """Distinct lower-cased words after the first directive of each of the first lines."""

    def words(x: Column) -> Column:
        at = F.instr(F.lower(x), DISABLE_TAG)
        rest = F.when(at > 0, F.substring(x, at + len(DISABLE_TAG), F.length(x))).otherwise("")
        return F.filter(F.split(F.lower(rest), r"(?U)\s+"), lambda w: w != "")

    return F.array_distinct(F.flatten(F.transform(first_lines(content, DISABLE_LINES), words)))


def directed(files: DataFrame) -> DataFrame:
    """files without those that say to be ignored, with `disabled`, the rules they disable."""
    return files.where(~is_ignored(F.col("content"))).withColumn("disabled", disabled_rules(F.col("content")))


def is_excluded(path: Column, patterns: list[str] | Column) -> Column:
    """Whether any pattern, of a list or of an array column, occurs anywhere in the path."""
    if isinstance(patterns, Column):
        return F.coalesce(F.exists(patterns, lambda p: path.contains(p)), F.lit(False))
    out = F.lit(False)
    for p in patterns:
        out = out | path.contains(p)
    return out


def scan_lines(files: DataFrame, languages: Sequence[Language] = LANGUAGES) -> DataFrame:
    """files(path, ext, content, ...) with `lines`, an array of (depth, is_import, code) for
    every line in order. Depth is leading white space by the indent size, code is the line
    without comments and outer blanks. Where files has `flawed` (see utf8_gate), lines with
    replaced bytes are no imports."""
    ext = F.col("ext")
    line, block = pick(ext, lambda x: x.line, languages), pick(ext, lambda x: x.block and x.block[0], languages)
    keywords = F.coalesce(pick(ext, lambda x: x.imports, languages), F.array().cast("array<string>"))
    indent = F.coalesce(pick(ext, lambda x: x.indent, languages), F.lit(4))
    flawed = F.coalesce(F.col("flawed"), F.lit(False)) if "flawed" in files.columns else None
    df = files.withColumn("_tokens", scanner_tokens(F.col("content"), ext, languages))
    t = F.col("_tokens")
    # the three views of a line side by side; what differs by language is bound once
    views = let(
        F.struct(line.alias("line"), block.alias("block")),
        lambda o: F.arrays_zip(*[F.split(v(t, o["line"], o["block"]), "\n", -1).alias(n) for n, v in (("mask", masked_text), ("code", code_text), ("raw", raw_text))]),
    )
    df = df.withColumn("_views", F.filter(views, lambda z: z["mask"].isNotNull()))
    n = F.size("_views")
    df = df.withColumn("_views", F.when(F.element_at("_views", -1)["mask"] == "", F.slice("_views", 1, n - 1)).otherwise(F.col("_views")))

    def parts(z: Column) -> Column:
        # regular expressions only where the mark of an earlier line's token stands
        raw = z["raw"]
        after = F.regexp_replace(F.regexp_extract(raw, "\x03([^\x03]*)$", 1), r"(?U)^\s+", "")
        marked = F.when(after != "", after).otherwise(F.regexp_replace(F.replace(raw, F.lit("\x03"), F.lit("")), r"(?U)^\s+", ""))
        return F.struct(
            F.when(z["mask"].startswith("\x03"), F.substring(z["mask"], 2, 1 << 30)).otherwise(z["mask"]).alias("mask"),
            F.when(raw.contains("\x03"), marked).otherwise(F.ltrim(raw, F.lit(SPACES))).alias("tested"),
            F.btrim(F.coalesce(z["code"], F.lit("")), F.lit(" \t\r\n\f\x02")).alias("code"),
        )

    def lead(z: Column) -> Column:
        return F.struct((F.length(z["mask"]) - F.length(F.ltrim(z["mask"], F.lit(" \t")))).alias("blanks"), z["mask"].alias("mask"), z["tested"].alias("tested"), z["code"].alias("code"))

    def one(z: Column, o: Column) -> Column:
        blanks = z["blanks"]
        tabs = F.when(z["mask"].contains("\t"), blanks - F.length(F.replace(F.left(z["mask"], blanks), F.lit("\t"), F.lit("")))).otherwise(0)
        is_import = F.exists(o["keywords"], lambda k: z["tested"].startswith(k))
        return F.struct(
            F.when(blanks > 0, F.floor((blanks + tabs * (o["indent"] - 1)) / o["indent"]).cast("int")).otherwise(0).alias("depth"),
            (is_import & ~(flawed & z["tested"].contains("�")) if flawed is not None else is_import).alias("is_import"),
            z["code"].alias("code"),
        )

    lines = let(F.struct(keywords.alias("keywords"), indent.alias("indent")), lambda o: F.transform(F.transform(F.transform("_views", parts), lead), lambda z: one(z, o)))
    return df.withColumn("lines", lines).drop("_tokens", "_views")


def line_table(scanned: DataFrame) -> DataFrame:
    """(path, ext, line, depth, is_import, code) from scan_lines; line counts from 1."""
    # an inner explode would have the optimizer test first whether there are lines, by scanning twice
    rows = scanned.select("path", "ext", F.posexplode_outer("lines").alias("i", "l")).where("i IS NOT NULL")
    return rows.select("path", "ext", (F.col("i") + 1).alias("line"), "l.*")


def measured(scanned: DataFrame) -> DataFrame:
    """scan_lines' rows without texts: lines, imports and depth as numbers, `depths` of all
    lines, and the places `at` and hashes `hashes` of the lines that hold code."""
    kept = [c for c in scanned.columns if c not in ("content", "lines")]
    df = scanned.select(
        *kept, F.size("lines").cast("long").alias("lines"), F.size(F.filter("lines", lambda x: x["is_import"])).cast("long").alias("imports"),
        F.transform("lines", lambda x: x["depth"]).alias("depths"), F.array_compact(F.transform("lines", lambda x, i: F.when(x["code"] != "", i + 1))).alias("at"),
        F.transform(F.filter("lines", lambda x: x["code"] != ""), lambda x: F.xxhash64(x["code"])).alias("hashes"),
    )
    return df.withColumn("depth", F.coalesce(F.array_max("depths"), F.lit(0)).cast("long"))
