"""Repeated blocks of code lines, within files and across the collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import materialize, small

#: Other places of a repeated block that reports list; the rest is counted.
PLACES = 10


def _chunks() -> Column:
    """(chunk, i): the hash and the first code line (from 1) of every window of a row with
    window and hashes. Windows below 1 are an error."""
    w = F.when(F.col("window") < 1, F.raise_error(F.lit("the window has to be at least 1"))).otherwise(F.col("window")).cast("int")
    starts = F.when(F.size("hashes") >= w, F.sequence(F.lit(1), F.size("hashes") - w + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.xxhash64(w, F.slice("hashes", i, w)).alias("chunk"), i.alias("i")))


def windows(rows: DataFrame) -> DataFrame:
    """(path, start_line, end_line, window, chunk): every run of `window` consecutive code lines of
    rows(path, at, hashes, window), as scan.measured gives them. Equal chunks mean equal
    code. Cut within the row, so nothing is shuffled."""
    # the lines go into the window, as every row of the explosion would carry the array of all
    lines = lambda c: F.struct(F.get("at", c["i"] - 1).alias("start_line"), F.get("at", (c["i"] + F.col("window") - 2).cast("int")).alias("end_line"), c["chunk"].alias("chunk"))
    each = rows.select("path", "window", F.explode_outer(F.transform(_chunks(), lines)).alias("c")).where("c IS NOT NULL")
    return each.select("path", "c.start_line", "c.end_line", F.col("window").cast("int").alias("window"), "c.chunk")


def with_local_repetition(rows: DataFrame) -> DataFrame:
    """rows(lines, hashes, window, ...) with `repetition`: per cent of a file's lines in
    blocks it repeats itself. Windows are sorted within the row, so nothing is shuffled."""
    df = rows.withColumn("_sorted", F.array_sort(_chunks()))
    same = lambda x, j: F.coalesce(F.get("_sorted", j)["chunk"] == x["chunk"], F.lit(False))
    again = F.filter("_sorted", lambda x, j: same(x, j - 1) | same(x, j + 1))
    df = df.withColumn("_starts", F.array_sort(F.transform(again, lambda x: x["i"])))
    # a window adds what the next one does not cover
    w = F.col("window").cast("int")
    new = F.transform("_starts", lambda x, j: F.least(w, F.coalesce(F.get("_starts", j + 1) - x, w)))
    covered = F.aggregate(new, F.lit(0), lambda a, x: a + x)
    share = F.when(F.col("lines") > 0, covered / F.col("lines") * 100.0).otherwise(F.lit(0.0))
    return df.withColumn("repetition", share).drop("_sorted", "_starts")


def group_members(window_rows: DataFrame, within_file: bool = False) -> DataFrame:
    """(path, start_line, chunk, members, first_path, first_line): the windows whose chunk
    occurs more than once anywhere (or in their own file), each once, with the size and the
    first member of its group. A group is counted by aggregation and joined back, never
    collected."""
    keys = ["path", "chunk"] if within_file else ["chunk"]
    groups = window_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("path", "start_line")).alias("first")).where("members > 1")
    joined = window_rows.select("path", "start_line", "chunk").join(groups, keys)
    return joined.select("path", "start_line", "chunk", "members", F.col("first.path").alias("first_path"), F.col("first.start_line").alias("first_line"))


def with_other_places(members: DataFrame, within_file: bool = False, limit: int = PLACES) -> DataFrame:
    """members with `others`, the first `limit` other places (path, line) of the group in
    order, and `more`, how many there are beyond. The first places of a group are found by
    rank, so that a group is never collected; with group_members all are at hand."""
    keys = ["path", "chunk"] if within_file else ["chunk"]
    by = W.partitionBy(*keys).orderBy("path", "start_line")
    first = members.select("path", "start_line", "chunk").withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= limit + 1)
    place = F.struct("path", F.col("start_line").alias("line"))
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list(place)).alias("_places"))
    rows = members.join(first, keys)
    others = F.slice(F.filter("_places", lambda x: (x["path"] != F.col("path")) | (x["line"] != F.col("start_line"))), 1, limit)
    rows = rows.withColumn("others", others)
    return rows.withColumn("more", F.col("members") - 1 - F.size("others")).drop("_places")


def with_global_repetition(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows(path, lines, window, repetition, ...) with `repetition` replaced, where a file has
    a member of any group, by the share of physical lines start .. start + window - 1, at
    most 100."""
    starts = members.groupBy("path").agg(F.array_sort(F.collect_set("start_line")).alias("_starts"))
    w = F.col("window").cast("int")
    new = F.transform("_starts", lambda x, j: F.least(w, F.coalesce(F.get("_starts", j + 1) - x, w)))
    share = F.least(F.aggregate(new, F.lit(0), lambda a, x: a + x) / F.col("lines") * 100.0, F.lit(100.0))
    joined = rows.join(starts, "path", "left")
    return joined.withColumn("repetition", F.when(F.col("_starts").isNotNull() & (F.col("lines") > 0), share).otherwise(F.col("repetition"))).drop("_starts")


def with_snippets(members: DataFrame, files: DataFrame, windows_of: DataFrame) -> DataFrame:
    """members with `content`, the `window` physical lines from the start on. A block whose
    snippet would end on the last line is left out, as the bound is strict.

    files(path, content) is read again rather than carried through the search: the members
    of each file are put together and come to the content of their file, by broadcast if
    they are small."""
    names = [c for c in members.columns if c != "path"]
    held = members.join(windows_of.select("path", F.col("window").cast("int").alias("_window")), "path")
    held = materialize(held.groupBy("path").agg(F.collect_list(F.struct("_window", *names)).alias("_members")), "members")
    text = F.split(F.regexp_replace(F.regexp_replace("content", "\r\n", "\n"), "\n\\z", ""), "\n", -1)
    rows = files.select("path", "content").join(small(held), "path").select("path", text.alias("_text"), "_members")
    rows = rows.select("path", "_text", F.explode("_members").alias("m")).select("path", "_text", "m.*")
    rows = rows.where((F.col("start_line") + F.col("_window") <= F.size("_text")) & (F.col("start_line") > 0))
    return rows.withColumn("content", F.array_join(F.slice("_text", F.col("start_line"), F.col("_window")), "\n")).drop("_text", "_window")


def local_details(window_rows: DataFrame, files: DataFrame, windows_of: DataFrame, limit: int = PLACES) -> DataFrame:
    """(path, line, content, others, more): for blocks that a file repeats, each place with
    its text and the other places in the same file; see with_other_places."""
    members = with_other_places(group_members(window_rows, True), True, limit).select("path", "start_line", "others", "more")
    return with_snippets(members, files, windows_of).select("path", F.col("start_line").alias("line"), "content", "others", "more")


def cross_file_details(window_rows: DataFrame, files: DataFrame, windows_of: DataFrame, local: DataFrame | None = None, limit: int = PLACES) -> DataFrame:
    """(path, line, content, others, more): each place of the blocks that occur more than once
    anywhere. Places that stand in local (path, line, ...) have their copies there already
    and are left out."""
    members = group_members(window_rows)
    members = with_other_places(members, False, limit).select("path", "start_line", "others", "more")
    if local is not None:
        members = members.join(local.select("path", F.col("line").alias("start_line")).distinct(), ["path", "start_line"], "left_anti")
    return with_snippets(members, files, windows_of).select("path", F.col("start_line").alias("line"), "content", "others", "more")
