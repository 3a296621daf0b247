"""Long exact spans shared between records.

Relative Lempel-Ziv parsing against an index of reference blocks. A record is cut into
phrases: maximal runs of `span`-element windows that have the same smallest k-gram hash
(their anchor). The anchor depends on the window's content alone, so two equal windows are
always in phrases with the same anchor, and only the blocks that hold a phrase's anchor can
hold any of its windows. So every record is parsed against every block that it can have a
factor in, and the blocks are spread over the cluster by anchor.

A reference block is up to BLOCK elements of distinct phrases, with all phrases of its
anchors. Its index is a suffix array with the ranks of all doubled prefixes, which give the
exact length that two suffixes have in common. At every position the longest factor that
begins there and stands in another record is the one with the next suffix of another
record, above or below in the array. A phrase is parsed greedily: the factor at the first
position that has one of at least `span` elements is consumed, and the parse goes on at its
boundary, where the windows that reach over it are checked, too. A phrase that the index
has from another record as a whole is one factor without being parsed. Factors are put
back to the places of their phrases, and those that touch or overlap in a record make up a
span. As every window is in a phrase and each is inside a factor or checked at a boundary,
the result is exact: a position is reported if and only if it lies in a window that another
record has, too.

Nothing is compared in pairs: lookups between blocks are aggregations (smallest and
largest record of a key) that combine on the map side, so that boilerplate which stands in
a third of all records costs one row per task. Phrases are told apart by 128 bits of two
independent polynomial hashes, their parts by the elements themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.session import materialize

#: Elements that are hashed at once; a longer record is cut into overlapping parts.
PART = 1 << 20
#: Longest phrase in windows; runs in periodic text are cut there.
PHRASE = 512
#: Elements of phrases in a reference block.
BLOCK = 1 << 20

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer, elementwise."""
    z = x.astype(np.uint64) + np.uint64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[which] = have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


class Rolling:
    """Hashes of any stretch of a sequence in constant time."""

    def __init__(self, elements: np.ndarray, which: int):
        up, self.down = _power(which, len(elements) + 1)
        self.sums = np.zeros(len(elements) + 1, np.uint64)
        np.cumsum(mix64(elements, 11 + which) * up[: len(elements)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _parts(starts: np.ndarray, elements: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts concatenated records into parts of at most PART elements: (record index,
    offset in the record, first element in the part) of each piece, and the elements."""
    pieces, size = [], 0
    for r in range(len(starts) - 1):
        a, b = int(starts[r]), int(starts[r + 1])
        at = a
        while b - at >= span:
            end = min(b, at + PART)
            if size + end - at > PART and pieces:
                yield _joined(pieces, elements)
                pieces, size = [], 0
            pieces.append((r, at - a, at, end))
            size += end - at
            if end == b:
                break
            at = end - span + 1
    if pieces:
        yield _joined(pieces, elements)


def _joined(pieces: list[tuple[int, int, int, int]], elements: np.ndarray):
    p = np.array(pieces, np.int64)
    first = np.concatenate([[0], np.cumsum(p[:, 3] - p[:, 2])])
    idx = np.arange(first[-1]) + np.repeat(p[:, 2] - first[:-1], p[:, 3] - p[:, 2])
    return p[:, 0], p[:, 1], first, idx


def phrases(starts: np.ndarray, elements: np.ndarray, valid: np.ndarray | None, span: int, gram: int, seed: int) -> Iterator[dict[str, np.ndarray]]:
    """Phrases of concatenated records; record r is elements[starts[r]:starts[r + 1]].
    Windows that hold an element that isn't valid are in no phrase."""
    for rec, base, first, idx in _parts(starts, elements, span):
        e = elements[idx]
        n = len(e)
        one, two = Rolling(e, 0), Rolling(e, 1)
        anchors = sliding_min(mix64(one.all(gram), seed), span - gram + 1)
        m = n - span + 1
        piece = np.repeat(np.arange(len(rec)), np.diff(first))
        good = piece[:m] == piece[span - 1 :]
        if valid is not None:
            bad = np.concatenate([[0], np.cumsum(~valid[idx])])
            good &= bad[span:] == bad[:m]
        new = np.ones(m, bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (piece[1:m] != piece[: m - 1]) | (good[1:] != good[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, m))
        if (size > PHRASE).any():
            cuts = -(-size // PHRASE)
            k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            left = np.repeat(size, cuts) - k * PHRASE
            at, size = np.repeat(at, cuts) + k * PHRASE, np.minimum(left, PHRASE)
        keep = good[at]
        at, size = at[keep], size[keep]
        p = piece[at]
        yield {
            "rec": rec[p], "start": base[p] + at - first[p], "windows": size, "anchor": anchors[at].view(np.int64),
            "h1": mix64(one.of(at, size + span - 1), seed).view(np.int64), "h2": mix64(two.of(at, size + span - 1), seed).view(np.int64),
        }


def sequence_pieces(df: DataFrame, key: str, pos: str, value: str, span: int, piece: int = 1 << 16) -> DataFrame:
    """(rec_id, base, seq) from rows (key, pos, value): arrays of the values in order of
    pos. A record is one row per `piece` positions, each with the span-1 values after it,
    so that no record, however long, has to fit into one row. Resent rows count once; rows
    with a null key or pos are left out."""
    at = F.col(pos).cast("long")
    rows = df.where(F.col(key).isNotNull() & F.col(pos).isNotNull()).select(F.col(key).alias("rec_id"), at.alias("pos"), F.col(value).cast("long").alias("value"))
    base = (F.col("pos") - F.pmod("pos", F.lit(piece))).alias("base")
    early = (F.pmod("pos", F.lit(piece)) < span - 1) & (F.col("pos") >= piece)
    both = rows.select("*", F.explode(F.when(early, F.array(base, base - piece)).otherwise(F.array(base))).alias("base"))
    seq = F.transform(F.array_sort(F.collect_set(F.struct("pos", "value"))), lambda x: x["value"])
    return both.groupBy("rec_id", "base").agg(seq.alias("seq"))


def text_pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_id, base, seq) of a table of texts; null keys and texts are left out."""
    kept = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return kept.select(F.col(key).cast("long").alias("rec_id"), F.lit(0).cast("long").alias("base"), F.col(text).alias("seq"))


def _elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Starts, elements and validity of a column of strings or of arrays of integers."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        texts = column.to_pylist()
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=starts[1:])
        return starts, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), None
    flat = column.flatten()
    starts = np.zeros(len(column) + 1, np.int64)
    np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False), out=starts[1:])
    valid = np.asarray(flat.is_valid()) if flat.null_count else None
    return starts, flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), valid


def _emit_phrases(span: int, gram: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bases = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rec_id", "base"))
            for p in phrases(*_elements(batch.column("seq")), span, gram, seed):
                r = p.pop("rec")
                out = {"rec_id": ids[r], "base": bases[r], "start": bases[r] + p.pop("start"), "windows": p.pop("windows").astype(np.int32)} | p
                yield pa.RecordBatch.from_pydict(out)

    return run


def _windows(column: pa.Array, windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset and both hashes of every window of every snippet."""
    starts, elements, _ = _elements(column)
    row = np.repeat(np.arange(len(windows)), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[row] + offset
    return row, offset, Rolling(elements, 0).of(at, span), Rolling(elements, 1).of(at, span)


class Index:
    """A suffix array over texts that end in elements of their own, and common lengths."""

    def __init__(self, elements: np.ndarray):
        n = len(elements)
        rank = np.unique(elements, return_inverse=True)[1].astype(np.int64)
        self.ranks = [rank.astype(np.int32)]
        order = np.argsort(rank, kind="stable")
        while n and rank[order[-1]] < n - 1:
            step = 1 << (len(self.ranks) - 1)
            key = rank << 32
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            self.ranks.append(rank.astype(np.int32))
        self.suffixes = order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many elements the suffixes at a and b have in common."""
        n, total = len(self.suffixes), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            x, y = a + total, b + total
            inside = (x < n) & (y < n)
            total += ((rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]) & inside).astype(np.int64) << k
        return total


def _least_since(values: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Minimum of values from the start of each one's run on; run counts up."""
    far = np.int64(1) << 40
    return np.minimum.accumulate(values - run * far) + run * far


def longest_factors(index: Index, owner: np.ndarray) -> np.ndarray:
    """For every position the length of the longest factor from there that begins at a
    position of another owner as well; owner -1 is another than any."""
    at = index.suffixes
    n = len(at)
    if n < 2:
        return np.zeros(n, np.int64)
    own = owner[at]
    common = np.concatenate([[0], index.common(at[:-1], at[1:]), [0]])
    new = np.ones(n, bool)
    new[1:] = (own[1:] != own[:-1]) | (own[1:] < 0)
    run = np.cumsum(new)
    above = _least_since(common[:-1], run)
    below = _least_since(common[1:][::-1], (run[-1] - run)[::-1])[::-1]
    out = np.empty(n, np.int64)
    out[at] = np.maximum(above, below)
    return out


def parse(first: np.ndarray, size: np.ndarray, length: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, begin, end) of the greedy factors of phrases of `size` elements that begin at
    `first` of the block, given the longest factor at each of its positions. After a factor
    the next begins at the first position whose window reaches over the boundary and that
    has one of its own."""
    starts = np.flatnonzero(length >= span)
    ends = first + size
    phrase, cursor, out = np.arange(len(first)), first.copy(), []
    while len(phrase):
        i = np.searchsorted(starts, cursor)
        some = i < len(starts)
        at = starts[np.minimum(i, len(starts) - 1)] if len(starts) else cursor
        some &= at < ends[phrase]
        phrase, at = phrase[some], at[some]
        out.append((phrase, at - first[phrase], at + length[at] - first[phrase]))
        cursor = at + length[at] - span + 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _parse_blocks(span: int):
    """Parses whole reference blocks; rows come sorted by anchor."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        starts, elements, _ = _elements(table.column("snippet").combine_chunks())
        lo, hi, h1, h2 = (table.column(c).to_numpy() for c in ("lo", "hi", "h1", "h2"))
        size = np.diff(starts)
        # a text ends in an element of its own
        first = starts[:-1] + np.arange(len(size))
        block = np.empty(len(elements) + len(size), np.uint64)
        ends = first + size
        inside = np.ones(len(block), bool)
        inside[ends] = False
        block[inside] = np.unique(elements, return_inverse=True)[1]
        block[ends] = len(elements) + np.arange(len(size))
        owner = np.repeat(np.where(lo == hi, np.unique(lo, return_inverse=True)[1], -1), size + 1)
        length = longest_factors(Index(block), owner)
        # a phrase that several records have is one factor already
        length[owner < 0] = 0
        row, begin, end = parse(first, size, length, span)
        return pa.RecordBatch.from_pydict({"h1": h1[row], "h2": h2[row], "first": begin.astype(np.int32), "last": (end - span).astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = batch.column("anchor").to_numpy()
            weight = np.cumsum(batch.column("windows").to_numpy().astype(np.int64) + span)
            done, edges = 0, [*np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors)]
            if held and held[-1].column("anchor")[-1].as_py() != anchors[0]:
                edges.insert(0, 0)
            for edge in edges[:-1]:  # the last anchor may go on
                if edge == 0 or size + weight[edge - 1] - (weight[done - 1] if done else 0) >= BLOCK:
                    held.append(batch.slice(done, edge - done))
                    size += int(weight[edge - 1] - (weight[done - 1] if done else 0)) if edge else 0
                    if size >= BLOCK:
                        yield solve(pa.Table.from_batches(held))
                        held, size = [], 0
                    done = edge
            held.append(batch.slice(done))
            size += int(weight[-1] - (weight[done - 1] if done else 0))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _explode_windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("windows").to_numpy().astype(np.int64)
            row, offset, one, two = _windows(batch.column("snippet"), size, span)
            out = {c: batch.column(c).to_numpy()[row] for c in ("h1", "h2", "lo", "hi")}
            yield pa.RecordBatch.from_pydict(out | {"at": offset.astype(np.int32), "w1": one.view(np.int64), "w2": two.view(np.int64)})

    return run


def shared_spans(pieces: DataFrame, span: int, gram: int, seed: int = 1, block: int = 20_000) -> DataFrame:
    """(rec_id, from_pos, to_pos): the maximal runs of positions that lie in a stretch of
    at least `span` elements which stands identically in another record.

    pieces has rec_id, base and seq (see text_pieces, sequence_pieces); other columns are
    not looked at. gram is the length of the anchors' k-grams, at most span. Null elements
    equal nothing. Records shorter than span, empty ones and an empty table have no runs;
    resent rows of a record are not another record. An anchor with more than `block` distinct
    phrases is too large for a reference block; its windows are looked up one by one over
    the cluster, with the same result."""
    if not 1 <= gram <= span:
        raise ValueError("gram must be between 1 and span")
    seq_type = dict(pieces.dtypes)["seq"]
    pieces = pieces.select("rec_id", "base", "seq")
    kinds = "rec_id long, base long, start long, windows int, anchor long, h1 long, h2 long"
    everything = materialize(pieces.mapInArrow(_emit_phrases(span, gram, seed), kinds), "phrases")

    several = everything.groupBy("anchor").agg(F.min("rec_id").alias("a"), F.max("rec_id").alias("b")).where("a <> b").select("anchor")
    index = materialize(everything.join(several, "anchor", "left_semi"), "index")
    distinct = index.groupBy("h1", "h2").agg(
        F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi"),
        *[F.first(c).alias(c) for c in ("anchor", "rec_id", "base", "start", "windows")],
    )
    distinct = materialize(distinct, "distinct")

    blocks = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"), F.sum((F.col("lo") == F.col("hi")).cast("long")).alias("own"))
    edges = distinct.join(blocks.where("size > 1 AND own > 0").select("anchor", "size"), "anchor")
    at, length = (F.col("start") - F.col("base") + 1).cast("int"), F.col("windows") + (span - 1)
    snippet = F.substring("seq", at, length) if seq_type == "string" else F.slice("seq", at, length)
    snippets = edges.join(pieces, ["rec_id", "base"]).select("anchor", "size", "h1", "h2", "lo", "hi", "windows", snippet.alias("snippet"))
    snippets = materialize(snippets.dropDuplicates(["h1", "h2"]), "snippets")

    near = snippets.where(F.col("size") <= block).repartition("anchor").sortWithinPartitions("anchor")
    near = near.mapInArrow(_parse_blocks(span), "h1 long, h2 long, first int, last int")
    hot = snippets.where(F.col("size") > block).mapInArrow(_explode_windows(span), "h1 long, h2 long, lo long, hi long, at int, w1 long, w2 long")
    known = hot.groupBy("w1", "w2").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a <> b").select("w1", "w2")
    hot = hot.where("lo = hi").join(known, ["w1", "w2"], "left_semi").select("h1", "h2", F.col("at").alias("first"), F.col("at").alias("last"))
    whole = distinct.where("lo <> hi").select("h1", "h2", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))

    factors = whole.unionByName(near).unionByName(hot)
    runs = index.join(factors, ["h1", "h2"]).select(
        "rec_id", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + (span - 1)).alias("b")
    )
    return merge_runs(runs, "rec_id")


def merge_runs(runs: DataFrame, key: str) -> DataFrame:
    """(key, from_pos, to_pos): unions of overlapping or adjoining intervals [a, b]."""
    order = W.partitionBy(key).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(before.isNull() | (F.col("a") > before + 1), 1).otherwise(0))
    grouped = marked.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(key, "run").agg(F.min("a").alias("from_pos"), F.max("b").alias("to_pos")).drop("run")
