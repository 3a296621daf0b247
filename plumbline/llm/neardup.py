"""Near-duplicate records: chosen-path similarity join.

Each record is a set of shingles. In every repetition a record picks some of its shingles
by a hash that all records share, so that two records pick the same one with a chance that
grows with their overlap; records with the same pick share a bucket. Buckets above `limit`
are split again by picks that depend on the path so far, as long as there are any, small
ones are compared by brute force on 1-bit minwise sketches, and what passes is checked on
the sets themselves. As many repetitions run as bring the chance of finding a pair at the
threshold to the target recall.

Equal sets are one class throughout, so copies never meet in a bucket. Should buckets
still be large after all levels, they are compared in blocks, each pair of blocks in a task
of its own, so that nothing is lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.spans import mix64
from plumbline.session import materialize

#: Bits of a sketch, in words of 64.
WORDS = 3
#: Standard deviations below the expected agreement at the threshold that still pass: of a
#: million pairs at the threshold, three or four do not.
SLACK = 4.5

#: Shingles that are split at once.
CHUNK = 1 << 20

_WORD = re.compile(r"[A-Za-z0-9_]+")


def _combine(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + p, 5)
    return out


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and distinct, sorted shingle hashes of each row of a column of strings (words
    are lower-cased runs of A-Z, a-z, 0-9 and _) or of arrays of integers (a shingle with
    a null is left out)."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        words, sizes = [], []
        for text in column.to_pylist():
            found = _WORD.findall(text)
            words += found
            sizes.append(len(found))
        words = " ".join(words).lower().split(" ") if words else []
        values = pd.util.hash_array(np.array(words, object), categorize=True) if words else np.zeros(0, np.uint64)
        valid = None
    else:
        flat = column.flatten()
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        values = mix64(flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), 3)
        valid = np.asarray(flat.is_valid()) if flat.null_count else None
    record = np.repeat(np.arange(len(column)), np.asarray(sizes, np.int64))
    n = max(0, len(values) - width + 1)
    shingles = _combine([values[i : i + n] for i in range(width)])
    keep = record[:n] == record[len(record) - n :] if n else np.zeros(0, bool)
    if valid is not None:
        for i in range(width):
            keep = keep & valid[i : i + n]
    record, shingles = record[:n][keep], shingles[keep]
    order = np.lexsort((shingles, record))
    record, shingles = record[order], shingles[order]
    new = np.ones(len(record), bool)
    new[1:] = (record[1:] != record[:-1]) | (shingles[1:] != shingles[:-1])
    record, shingles = record[new], shingles[new]
    return np.searchsorted(record, np.arange(len(column) + 1)), shingles


def _sketches(starts: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """1-bit minwise sketches, WORDS unsigned words a row; rows must not be empty."""
    out = np.zeros((len(starts) - 1, WORDS), np.uint64)
    multipliers = mix64(np.arange(64 * WORDS), 77) | np.uint64(1)
    for j, a in enumerate(multipliers):
        least = np.minimum.reduceat(shingles * a, starts[:-1])
        out[:, j // 64] |= ((least >> np.uint64(24)) & np.uint64(1)) << np.uint64(j % 64)
    return out


def _picked(shingles: np.ndarray, share: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Which shingles are picked, each with the given chance, by a hash of shingle and seed."""
    return (mix64(shingles ^ seed, 21) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def _describe(width: int, picks: float, repeats: int):
    """One row a record: set key, sketch and the buckets of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sh = shingle_sets(batch.column("seq"), width)
            size = np.diff(starts)
            rows = np.flatnonzero(size)
            if not len(rows):
                continue
            starts, size = np.append(starts[:-1][rows], len(sh)), size[rows]
            record = np.repeat(np.arange(len(rows)), size)
            sums = [np.add.reduceat(mix64(sh, 31 + i), starts[:-1]).view(np.int64) for i in (0, 1)]
            which, buckets = [], []
            for r in range(repeats):
                hit = np.flatnonzero(_picked(sh, (picks / size)[record], np.uint64(mix64(np.array([r]), 41)[0])))
                which.append(record[hit])
                buckets.append(mix64(sh[hit], 1000 + r))
            which, buckets = np.concatenate(which), np.concatenate(buckets)
            order = np.argsort(which, kind="stable")
            lists = pa.ListArray.from_arrays(np.searchsorted(which[order], np.arange(len(rows) + 1)).astype(np.int32), pa.array(buckets[order].view(np.int64)))
            sk = _sketches(starts, sh).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"rec_id": batch.column("rec_id").take(pa.array(rows)), "size": size.astype(np.int32), "s1": sums[0], "s2": sums[1], "sketch": pa.FixedSizeListArray.from_arrays(sk.ravel(), WORDS).cast(pa.list_(pa.int64())), "buckets": lists}
            )

    return run


def _split(width: int, picks: float):
    """Buckets of the next level for each record and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sh = shingle_sets(batch.column("seq"), width)
            paths = batch.column("buckets")
            count = paths.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            path, record = paths.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(batch.num_rows), count)
            ids, size = batch.column("rec_id").to_numpy(), np.diff(starts)
            # a row for every path and shingle of its record, some paths at a time
            ends = np.cumsum(size[record])
            at = 0
            while at < len(record):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                own = size[record[at:to]]
                which = np.repeat(np.arange(at, to), own)
                place = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own) + starts[record[which]]
                hit = _picked(sh[place] ^ path[which], picks / size[record[which]], np.uint64(0))
                out = mix64(sh[place[hit]] ^ path[which[hit]], 51).view(np.int64)
                yield pa.RecordBatch.from_pydict({"bucket": out, "rec_id": ids[record[which[hit]]]})
                at = to

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sh = shingle_sets(batch.column("seq"), width)
            yield pa.RecordBatch.from_pydict({"rec_id": batch.column("rec_id"), "shingles": pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(sh.view(np.int64)))})

    return run


def _alike(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of which rows of two sketch tables may reach the threshold."""
    agree = 64 * WORDS - sum(np.bitwise_count(a[:, None, w] ^ b[None, :, w]).astype(np.int16) for w in range(WORDS))
    p = (1 + threshold) / 2
    least = 64 * WORDS * p - SLACK * np.sqrt(64 * WORDS * p * (1 - p))
    small, large = np.minimum(sa[:, None], sb[None, :]), np.maximum(sa[:, None], sb[None, :])
    return (agree >= least) & (small >= threshold * large)


def _compare(threshold: float):
    """Pairs within buckets. A row is a bucket with two lists of members; where both are
    the same block, each pair counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            sides = []
            for side in ("left", "right"):
                column = batch.column(side)
                flat = column.flatten()
                edge = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
                sketch = flat.field("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
                sides.append((edge, flat.field("rec_id").to_numpy(), flat.field("size").to_numpy(), sketch))
            (ea, ia, na, ka), (eb, ib, nb, kb) = sides
            same = batch.column("same").to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                a, b = slice(ea[i], ea[i + 1]), slice(eb[i], eb[i + 1])
                if same[i]:
                    b, right = a, (ia, na, ka)
                else:
                    right = (ib, nb, kb)
                x, y = np.nonzero(_alike(ka[a], right[2][b], na[a], right[1][b], threshold))
                p, q = ia[a][x], right[0][b][y]
                if same[i]:
                    p, q = p[p < q], q[p < q]
                out_a.append(np.minimum(p, q))
                out_b.append(np.maximum(p, q))
            if out_a:
                pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
                yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def repetitions(threshold: float, picks: float, recall: float) -> int:
    """Repetitions after which a pair at the threshold has shared a pick with chance recall.
    Of a record's picks, `picks` on average, the share that the other has picked as well is
    that of its shingles that are common, 2 t / (1 + t) for sets of equal size."""
    return max(1, math.ceil(-math.log(1 - recall) / (picks * 2 * threshold / (1 + threshold))))


def similar_classes(
    records: DataFrame, width: int = 5, threshold: float = 0.8, picks: float = 4.0, recall: float = 0.9999, levels: int = 8, limit: int = 200
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records(rec_id, seq), seq being text or an array of integers.

    members: (rec_id, class_id), one row per record that has a shingle; records with equal
    shingle sets are one class, named by its smallest id. links: (a, b, similarity) for
    the pairs of classes a < b whose Jaccard similarity is at least threshold. Rows with a
    null id or seq, empty texts and records shorter than `width` elements are in neither;
    resent rows count once; other columns are not looked at; an empty table gives none.

    Of pairs at the threshold at least about the share `recall` is found; it gives the number
    of repetitions (see repetitions), and more similar pairs are found more often. No bucket
    is cut: those above `limit` are split, and after `levels` levels compared in blocks."""
    repeats = repetitions(threshold, picks, recall)
    src = records.where("rec_id IS NOT NULL AND seq IS NOT NULL").select("rec_id", "seq")
    described = src.mapInArrow(_describe(width, picks, repeats), "rec_id long, size int, s1 long, s2 long, sketch array<long>, buckets array<long>")
    described = materialize(described, "described")
    classes = described.groupBy("size", "s1", "s2").agg(F.min("rec_id").alias("class_id"))
    members = materialize(described.join(classes, ["size", "s1", "s2"]).select("rec_id", "class_id").distinct(), "members")
    leaders = members.where("rec_id = class_id").select("rec_id")
    info = materialize(described.join(leaders, "rec_id", "left_semi").drop("s1", "s2").dropDuplicates(["rec_id"]), "info")

    rows = info.select(F.explode("buckets").alias("bucket"), "rec_id")
    found = []
    for level in range(1, levels + 1):
        count = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # exploded rows are more than the optimizer thinks, so none of these may be broadcast
        counted = materialize(rows.join(count.hint("merge"), "bucket"), "buckets")
        member = F.struct("rec_id", "size", "sketch")
        near = counted.where(F.col("n") <= limit).join(info.select("rec_id", "size", "sketch").hint("merge"), "rec_id")
        near = near.groupBy("bucket").agg(F.collect_list(member).alias("left"))
        found.append(near.select("left", F.array().cast(near.schema["left"].dataType).alias("right"), F.lit(True).alias("same")))
        big = counted.where(F.col("n") > limit)
        if big.isEmpty():
            break
        if level < levels:
            # a split must not lose what the repetitions found, so it picks more
            paths = big.groupBy("rec_id").agg(F.collect_set("bucket").alias("buckets"))
            rows = src.join(paths.hint("merge"), "rec_id").dropDuplicates(["rec_id"]).mapInArrow(_split(width, 2 * picks), "bucket long, rec_id long")
            rows = materialize(rows.distinct(), "split")
            continue
        # blocks of about `limit` members; every pair of blocks once
        blocks = F.ceil(F.col("n") / limit)
        big = big.join(info.select("rec_id", "size", "sketch").hint("merge"), "rec_id").withColumn("block", F.pmod(F.xxhash64("rec_id", "bucket"), blocks))
        other = F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")))
        tiles = big.select("*", other.alias("o")).select(
            "bucket", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), (F.col("block") <= F.col("o")).alias("first"), member.alias("m")
        )
        tiles = tiles.groupBy("bucket", "x", "y").agg(
            F.collect_list(F.when(F.col("first"), F.col("m"))).alias("left"), F.collect_list(F.when(~F.col("first"), F.col("m"))).alias("right")
        )
        found.append(tiles.select("left", "right", (F.col("x") == F.col("y")).alias("same")))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = materialize(pairs.mapInArrow(_compare(threshold), "a long, b long").distinct(), "pairs")

    wanted = pairs.select(F.col("a").alias("rec_id")).unionByName(pairs.select(F.col("b").alias("rec_id"))).distinct()
    sets = src.join(wanted.hint("merge"), "rec_id", "left_semi").dropDuplicates(["rec_id"]).mapInArrow(_sets(width), "rec_id long, shingles array<long>")
    sets = materialize(sets, "sets")
    side = lambda c: sets.select(F.col("rec_id").alias(c), F.col("shingles").alias(f"{c}s"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    common = F.size(F.array_intersect("as", "bs"))
    similarity = common / (F.size("as") + F.size("bs") - common)
    return members, both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b) of all records that are in one class or in linked classes."""
    m = lambda c, i: members.select(F.col("class_id").alias(c), F.col("rec_id").alias(i))
    copies = m("c", "id_a").join(m("c", "id_b"), "c").where("id_a < id_b")
    linked = links.select("a", "b").join(m("a", "p"), "a").join(m("b", "q"), "b")
    linked = linked.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    return copies.select("id_a", "id_b").unionByName(linked)


def record_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(rec_id, class_id, copies, links): one row per record; copies and links count the
    other records of its class and those of the classes linked with it."""
    size = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    ends = links.select(F.col("a").alias("class_id"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("class_id"), F.col("a").alias("o")))
    linked = ends.join(size.withColumnRenamed("class_id", "o"), "o").groupBy("class_id").agg(F.sum("n").alias("links"))
    return members.join(size, "class_id").join(linked, "class_id", "left").select(
        "rec_id", "class_id", (F.col("n") - 1).alias("copies"), F.coalesce("links", F.lit(0)).alias("links")
    )
