"""Filling containers of fixed capacity with items.

Only the histogram of item lengths is planned on, at most one row per length up to the
capacity, each spec in a task of its own. Lengths are taken together in windows of a
hundredth of the capacity, so that a window's count is a large number; shallow
combinations, of up to three windows, that fill a container are enumerated, and
non-negative least squares gives how often to repeat each against the histogram, room left
empty having a price. The repeats are rounded by largest remainder and carried out with the
exact lengths of the windows; what rounding left over is fitted again, with more room
allowed when a fit places little. The few residual items are packed greedily, into the
rooms of the containers planned so far and then into more. The plan (which ranks of a
length go to which containers) is joined back to the items, which are ranked within their
length in buckets, so that a length that many items share is not ranked in one task.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.session import BROADCAST_LIMIT, materialize

#: Buckets in which the items of a length are ranked, and ranks in a block of the plan.
BUCKETS, RANKS = 64, 1 << 14
#: Prices of empty room that are tried; the plan with the fewest containers stays.
PRICES = (0.015, 0.15)

#: A combination: (window or length, how many of it).
Combination = tuple[tuple[int, int], ...]


def _spread(n: int, fan: int) -> list[int]:
    """At most `fan` of 1..n, evenly."""
    return np.unique(np.linspace(1, n, min(fan, n)).astype(int)).tolist() if n > 0 else []


def combinations(typical: np.ndarray, counts: np.ndarray, capacity: int, room: float, fan: int = 12, repeats: int = 6) -> list[Combination]:
    """Combinations of up to three windows, given their typical lengths in order, that leave
    at most `room` of the capacity empty. Of the partners of a window and of the numbers
    to take of it, `fan` and `repeats` evenly spread ones are tried."""
    found: dict[Combination, None] = {}

    def last(left: float) -> int | None:
        """The longest window that fits and fills up."""
        i = int(np.searchsorted(typical, left, "right")) - 1
        return i if i >= 0 and left - typical[i] <= room else None

    def add(*parts: tuple[int, int]) -> None:
        found.setdefault(tuple(sorted(parts)), None)

    for a in range(len(typical) - 1, -1, -1):
        for n in _spread(int(min(capacity // typical[a], counts[a])), repeats):
            left = capacity - n * typical[a]
            if left <= room:
                add((a, n))
                continue
            if (c := last(left)) is not None and c != a:
                add((a, n), (c, 1))
            for b in _spread(min(int(np.searchsorted(typical, left, "right")), a), fan):
                b -= 1
                for m in _spread(int(min(left // typical[b], counts[b])), repeats):
                    rest = left - m * typical[b]
                    if rest <= room:
                        add((a, n), (b, m))
                    elif (c := last(rest)) is not None and c not in (a, b):
                        add((a, n), (b, m), (c, 1))
    return list(found)


def least_squares(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, price: np.ndarray, steps: int = 1000) -> np.ndarray:
    """Non-negative x minimizing |A x - target|^2 / 2 + price x for sparse A, by accelerated
    projected gradients with a diagonal scale."""
    n = len(price)
    scale = np.bincount(columns, values * np.bincount(rows, values, len(target))[rows], n)
    scale = 1 / np.maximum(scale, 1e-12)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        residual = np.bincount(rows, values * y[columns], len(target)) - target
        new = np.maximum(y - scale * (np.bincount(columns, values * residual[rows], n) + price), 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(new + (t - 1) / t_new * (new - x), 0)
        x, t = new, t_new
    return x


def rounded(x: np.ndarray, combos: list[Combination], counts: np.ndarray) -> np.ndarray:
    """Whole repeats: what is below the decimal point is cut off, and then given back by
    largest remainder as long as there are items."""
    left, out = counts.copy(), np.zeros(len(x), np.int64)

    def take(i: int, r: int) -> None:
        r = min(r, *(int(left[k]) // m for k, m in combos[i]))
        if r > 0:
            out[i] += r
            for k, m in combos[i]:
                left[k] -= m * r

    for i in np.argsort(-x, kind="stable"):
        take(i, int(x[i] + 1e-9))
    for i in np.argsort(np.floor(x + 1e-9) - x, kind="stable"):
        if x[i] > 1e-6:
            take(i, 1)
    return out


def carried_out(times: np.ndarray, combos: list[Combination], edges: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(exact lengths, repeats) for combinations of windows, taken from `left`. Each place
    takes the longest item of its window that leaves enough for the places after it;
    repeats for which the window has none that fits are left out."""
    ends = np.append(edges[1:], len(lengths))
    out = []
    for i in sorted(np.flatnonzero(times).tolist(), key=lambda i: -max(k for k, _ in combos[i])):
        r = int(times[i])
        places = [k for k, m in sorted(combos[i], reverse=True) for _ in range(m)]
        while r > 0:
            least = []
            for k in places:
                some = np.flatnonzero(left[edges[k] : ends[k]])
                least.append(int(lengths[edges[k] + some[0]]) if len(some) else capacity + 1)
            later, room, use = sum(least), capacity, {}
            if later > capacity:
                break
            for k, shortest in zip(places, least):
                later -= shortest
                j = min(int(np.searchsorted(lengths, room - later, "right")), int(ends[k])) - 1
                while j >= edges[k] and left[j] <= use.get(j, 0):
                    j -= 1
                if j < edges[k]:
                    break
                use[j] = use.get(j, 0) + 1
                room -= int(lengths[j])
            else:
                t = min(r, *(int(left[j]) // m for j, m in use.items()))
                out.append(({int(lengths[j]): m for j, m in use.items()}, t))
                for j, m in use.items():
                    left[j] -= m * t
                r -= t
                continue
            break
    return out


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, price: float = PRICES[-1], tries: int = 20) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(plan, greedy): (exact lengths, repeats) of containers for all items of a histogram,
    and how many items were packed greedily. Every length is 1 to capacity."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    left, out, room = counts.copy(), [], 0.1
    width = max(1, capacity // 100)
    for _ in range(tries):
        if left.sum() <= 0.1 * counts.sum():
            break
        live = np.flatnonzero(left)
        own, many = lengths[live], left[live].copy()
        window = (own - 1) // width
        edges = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        total = np.add.reduceat(many, edges)
        typical = np.add.reduceat(many * own, edges) / total
        combos = combinations(typical, total, capacity, room * capacity)
        if combos:
            rows = np.array([k for c in combos for k, _ in c])
            values = np.array([m for c in combos for _, m in c], float)
            # long items are the hard ones to place, so their counts weigh more
            weight = (typical * many.sum() / (own * many).sum()) ** 1.5
            empty = np.array([1 - sum(typical[k] * m for k, m in c) / capacity for c in combos])
            x = least_squares(rows, np.repeat(np.arange(len(combos)), [len(c) for c in combos]), values * weight[rows], total * weight, price * total.mean() * np.maximum(empty, 0))
            out += carried_out(rounded(x, combos, total), combos, edges, own, many, capacity)
        placed = left[live].sum() - many.sum()
        left[live] = many
        if placed < 0.05 * (placed + many.sum()):
            if room > 0.5:
                break
            room *= 3
    greedy = int(left.sum())
    out = _into_rooms(out, lengths, left, capacity)
    return out + _residuals(lengths, left, capacity), greedy


def _into_rooms(planned: list[tuple[dict[int, int], int]], lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Items of `left` put into rooms of planned containers, the longest first, each where
    it leaves the least room."""
    entries = [[combo, r] for combo, r in planned]
    rooms = sorted((capacity - sum(n * m for n, m in combo.items()), i) for i, (combo, _) in enumerate(entries))
    for j in range(len(lengths) - 1, -1, -1):
        n = int(lengths[j])
        while left[j] > 0 and (at := bisect.bisect_left(rooms, (n, -1))) < len(rooms):
            room, i = rooms.pop(at)
            combo, r = entries[i]
            t = min(r, int(left[j]))
            entries[i][1] = r - t
            if t < r:
                bisect.insort(rooms, (room, i))
            entries.append([combo | {n: combo.get(n, 0) + 1}, t])
            bisect.insort(rooms, (room - n, len(entries) - 1))
            left[j] -= t
    return [(combo, r) for combo, r in entries if r > 0]


def _residuals(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Greedy packing: the longest item first, then always the longest that still fits; a
    combination is repeated as often as its items last."""
    left, out = counts.copy(), []
    alive = np.flatnonzero(left)
    while len(alive):
        use: dict[int, int] = {}
        room = capacity
        while True:
            i = int(np.searchsorted(lengths[alive], room, "right")) - 1
            while i >= 0 and use.get(int(alive[i]), 0) >= left[alive[i]]:
                i -= 1
            if i < 0:
                break
            k = int(alive[i])
            m = min(room // int(lengths[k]), int(left[k]) - use.get(k, 0))
            use[k] = use.get(k, 0) + m
            room -= m * int(lengths[k])
        r = min(int(left[k]) // m for k, m in use.items())
        out.append(({int(lengths[k]): m for k, m in use.items()}, r))
        for k, m in use.items():
            left[k] -= r * m
        alive = alive[left[alive] > 0]
    return out


def slots(planned: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """(length, rank_from, rank_to, container_from, each): items of a length with these
    ranks (from 0, rank_to excluded) go to consecutive containers, `each` to one."""
    used: dict[int, int] = {}
    out, container = [], 0
    for combo, repeats in planned:
        for length, m in combo.items():
            a = used.get(length, 0)
            used[length] = a + m * repeats
            out.append((length, a, a + m * repeats, container, m))
        container += repeats
    return pd.DataFrame(out, columns=["length", "rank_from", "rank_to", "container_from", "each"])


def _planned(part: pd.DataFrame) -> pd.DataFrame:
    """The slots of one spec at one price, with the containers and greedily packed items."""
    out, greedy = plan(part.length.to_numpy(), part.c.to_numpy(), int(part.capacity.iloc[0]), float(part.price.iloc[0]))
    return slots(out).assign(spec_id=part.spec_id.iloc[0], price=part.price.iloc[0], containers=sum(n for _, n in out), greedy=greedy)


def plans(histogram: DataFrame) -> DataFrame:
    """Slots of the best plan of each spec of histogram(spec_id, capacity, length, c): that
    with the fewest containers, where a hundredth more is worth it if none were greedy."""
    priced = histogram.withColumn("price", F.explode(F.array(*map(F.lit, PRICES))))
    schema = "length long, rank_from long, rank_to long, container_from long, each long, spec_id int, price double, containers long, greedy long"
    tried = materialize(priced.groupBy("spec_id", "price").applyInPandas(_planned, schema), "plans")
    items = histogram.groupBy("spec_id").agg(F.sum("c").alias("items"))
    score = F.col("containers") * (1 + 0.01 * F.col("greedy") / F.col("items"))
    best = tried.select("spec_id", "price", "containers", "greedy").distinct().join(items, "spec_id").groupBy("spec_id").agg(F.min_by("price", F.struct(score, "price")).alias("price"))
    return tried.join(best, ["spec_id", "price"]).drop("price")


def pack(items: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """(spec_id, container_id, doc_id, piece, from_token, tokens): for every spec (spec_id,
    capacity) each item of items(doc_id, tokens) in containers numbered from 0.

    An item is split only if it alone exceeds the capacity: into pieces of the capacity
    and a rest. Items of 0 or null tokens need no room and have no row; items with a null
    doc_id are none; ids that come again are packed again, so callers pass records. A spec
    without a positive capacity packs nothing. The same items give the same containers."""
    specs = [(s, c) for s, c in specs if s is not None and c is not None and c > 0]
    if not specs:
        return items.sparkSession.createDataFrame([], "spec_id int, container_id long, doc_id long, piece int, from_token long, tokens long")
    each = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in specs]))
    rows = items.where("doc_id IS NOT NULL AND tokens > 0").select("doc_id", F.col("tokens").alias("n"), each.alias("s"))
    rows = rows.select("doc_id", "n", "s.*").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / F.col("capacity")) - 1).cast("int"))))
    start = F.col("piece") * F.col("capacity")
    rows = rows.select("spec_id", "capacity", "doc_id", "piece", start.alias("from_token"), F.least("capacity", F.col("n") - start).alias("length"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)))

    # one row per spec, length and bucket: bounded by the capacities
    counts = rows.groupBy("spec_id", "capacity", "length", "bucket").agg(F.count(F.lit(1)).alias("c"))
    counts = materialize(counts, "lengths")
    before = F.sum("c").over(W.partitionBy("spec_id", "length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("spec_id", "length", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    # a slot once for every block of ranks it reaches into, so that a frequent length is many keys
    block = F.explode(F.sequence(F.shiftright("rank_from", RANKS.bit_length() - 1), F.shiftright(F.col("rank_to") - 1, RANKS.bit_length() - 1)))
    table = plans(counts.groupBy("spec_id", "capacity", "length").agg(F.sum("c").alias("c"))).select("*", block.alias("block"))
    table = materialize(table.drop("containers", "greedy"), "plan")

    in_bucket = F.row_number().over(W.partitionBy("spec_id", "length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = rows.withColumn("r", in_bucket).join(offsets.hint("merge"), ["spec_id", "length", "bucket"]).withColumn("rank", F.col("offset") + F.col("r"))
    ranked = ranked.withColumn("block", F.shiftright("rank", RANKS.bit_length() - 1))
    # the plan's size is known here, while the optimizer's estimate of the exploded items is not
    # to be trusted: it must not broadcast them
    table = F.broadcast(table) if table.count() * 96 <= BROADCAST_LIMIT else table.hint("merge")
    placed = ranked.join(table, ["spec_id", "length", "block"]).where("rank >= rank_from AND rank < rank_to")
    container = F.col("container_from") + ((F.col("rank") - F.col("rank_from")) / F.col("each")).cast("long")
    return placed.select("spec_id", container.alias("container_id"), "doc_id", "piece", "from_token", F.col("length").alias("tokens"))
