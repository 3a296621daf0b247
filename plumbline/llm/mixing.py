"""Mixing sources to target weights by the cube method.

The share of a source fixes how often each of its records is used on average: some whole
number of times, and once more with a fractional probability. The cube method decides
about the fraction so that not only the number of records but also their tokens come out
as wanted: in its flight phase probabilities move along the null space of the balancing
constraints (records, tokens) until all but as many as there are constraints are 0 or 1.
Flights run in blocks of bounded size; what a block leaves open flies on with what other
blocks of the source left, until a landing problem of a few records remains per source.
"""

from __future__ import annotations

import itertools
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize, small

#: Records that fly together.
BLOCK = 5000
_OPEN = 1e-9


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities moved until at most two are neither 0 nor 1, keeping the sums of p and
    of p * size; in expectation none changes."""
    p = np.clip(p.astype(float), 0, 1).tolist()
    size = size.astype(float).tolist()
    random = np.random.default_rng(seed)
    uniform = iter(())
    queue = iter([int(i) for i in random.permutation(len(p)) if _OPEN < p[i] < 1 - _OPEN])
    active = list(itertools.islice(queue, 3))
    while len(active) == 3:
        i, j, k = active
        # null vector of the rows (1, 1, 1) and (size i, size j, size k)
        u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / d if d > 0 else p[x] / -d for x, d in zip(active, u) if d)
        down = min(p[x] / d if d > 0 else (1 - p[x]) / -d for x, d in zip(active, u) if d)
        r = next(uniform, None)
        if r is None:
            uniform = iter(random.random(1024).tolist())
            r = next(uniform)
        step = up if r < down / (up + down) else -down
        still = []
        for x, d in zip(active, u):
            v = p[x] + step * d
            p[x] = 0.0 if v < _OPEN else 1.0 if v > 1 - _OPEN else v
            if _OPEN < p[x] < 1 - _OPEN:
                still.append(x)
        active = still + list(itertools.islice(queue, 3 - len(still)))
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few open probabilities rounded so that the tokens come closest to what they
    should be, then the number of records; of equally good roundings the first."""
    p = p.copy()
    left = np.flatnonzero((p > _OPEN) & (p < 1 - _OPEN))
    if len(left):
        want, many = (p[left] * size[left]).sum(), p[left].sum()
        p[left] = min(itertools.product((0.0, 1.0), repeat=len(left)), key=lambda c: (abs(np.dot(c, size[left]) - want), abs(sum(c) - many)))
    return np.where(p > 0.5, 1.0, 0.0)


def _fly(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("doc_id")
    seed = abs(hash(tuple(int(x) if isinstance(x, (int, np.integer)) else sum(map(ord, str(x))) for x in key))) % (1 << 32)
    return part.assign(p=flight(part.p.to_numpy(), part.tokens.to_numpy(), seed))


def _fly_and_land(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
    out = _fly(key, part)
    return out.assign(p=landing(out.p.to_numpy(), out.tokens.to_numpy()))


def mix_rates(sizes: dict[str, tuple[int, int]], targets: list[dict], corpus_tokens: int, spread: bool = True) -> list[dict]:
    """How often each source is used on average in each mix.

    sizes: source -> (records, tokens); targets: rows with mix_id, source, weight,
    max_repeats and budget_ratio. Null or negative weights and repeats count as 0, weights
    are divided by the sum over the mix's sources that have tokens; a source without any
    gives its weight to the others. A source that would have to be repeated more often than
    allowed gives all it may; with spread the others make up for it in proportion to their
    weights, so that the mix keeps its size, else the mix becomes smaller by as much."""
    out = []
    for mix in sorted({t["mix_id"] for t in targets if t["mix_id"] is not None}):
        rows: dict[str, dict] = {}
        for t in targets:
            if t["mix_id"] == mix and t["source"] is not None:
                rows.setdefault(t["source"], t)
        budget = max((t["budget_ratio"] or 0.0 for t in rows.values()), default=0.0) * corpus_tokens
        weight = {s: max(t["weight"] or 0.0, 0.0) if sizes.get(s, (0, 0))[1] > 0 else 0.0 for s, t in rows.items()}
        total = sum(weight.values())
        share = {s: w / total if total else 0.0 for s, w in weight.items()}
        cap = {s: max(rows[s]["max_repeats"] or 0, 0) * sizes.get(s, (0, 0))[1] for s in rows}
        give = {s: share[s] * budget for s in rows}
        full: set[str] = set()
        while over := {s for s in rows if s not in full and share[s] > 0 and give[s] > cap[s] * (1 + 1e-12)}:
            full |= over
            rest = sum(share[s] for s in rows if s not in full)
            room = budget - sum(cap[s] for s in full)
            for s in rows:
                give[s] = cap[s] if s in full else (share[s] / rest * room if rest and spread else share[s] * budget)
        for s, t in sorted(rows.items()):
            tokens = sizes.get(s, (0, 0))[1]
            out.append({"mix_id": int(mix), "source": s, "target_share": share[s], "max_repeats": int(max(t["max_repeats"] or 0, 0)), "rate": min(give[s], cap[s]) / tokens if tokens else 0.0})
    return out


def clean_source(c) -> F.Column:
    return F.lower(F.trim(c))


def mix(documents: DataFrame, targets: DataFrame, spread: bool = True, block: int = BLOCK) -> DataFrame:
    """(mix_id, source, doc_id, tokens, repeats): the records of documents(doc_id, source,
    tokens) that each mix uses, with how often.

    Sources are compared in lower case and without outer blanks. Records with a null
    doc_id or source or without tokens are in no mix, though their tokens count in the
    size of the corpus; ids are expected once. targets is a small table of one row per mix
    and source; see mix_rates. Only it and the totals per source of the mixes come to the
    driver. A source without records, and an empty table, give no rows."""
    spark = documents.sparkSession
    wanted = [r.asDict() for r in targets.select("mix_id", clean_source(F.col("source")).alias("source"), "weight", "max_repeats", "budget_ratio").distinct().orderBy("mix_id", "source", F.col("weight").desc_nulls_last()).collect()]
    docs = documents.select("doc_id", clean_source(F.col("source")).alias("source"), "tokens")
    names = sorted({t["source"] for t in wanted if t["source"] is not None})
    totals = docs.groupBy(F.when(F.col("source").isin(names) & F.col("doc_id").isNotNull() & (F.col("tokens") > 0), F.col("source")).alias("source"))
    totals = totals.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()
    sizes = {r.source: (r.n, r.t or 0) for r in totals if r.source is not None}
    rates = mix_rates(sizes, wanted, sum(r.t or 0 for r in totals), spread)
    rates = [r | {"blocks": max(1, -(-sizes[r["source"]][0] // block))} for r in rates if r["rate"] > 0]
    table = spark.createDataFrame(pd.DataFrame(rates, columns=["mix_id", "source", "rate", "blocks"]), "mix_id int, source string, rate double, blocks long")

    rows = docs.where("doc_id IS NOT NULL AND tokens > 0").join(small(table), "source")
    base = F.floor(F.col("rate") + F.lit(_OPEN))
    rows = rows.select("mix_id", "source", "doc_id", "tokens", base.cast("int").alias("base"), F.greatest(F.col("rate") - base, F.lit(0.0)).alias("p"), F.pmod(F.xxhash64("doc_id", "mix_id"), F.col("blocks")).alias("block"))
    schema = "mix_id int, source string, doc_id long, tokens long, base int, p double, block long"
    open_ = (F.col("p") > _OPEN) & (F.col("p") < 1 - _OPEN)

    # few bytes but much work: the engine would put all flights into one task
    wide = min(sum(r["blocks"] for r in rates) or 1, 4 * spark.sparkContext.defaultParallelism)
    flown = materialize(rows.repartition(wide, "mix_id", "source", "block").groupBy("mix_id", "source", "block").applyInPandas(_fly, schema), "flight")
    decided = [flown.where(~open_)]
    left, most = flown.where(open_), max((r["blocks"] for r in rates), default=1)
    while most > block // 2:
        # at most two of a block are open; blocks of what is left are as large as before
        most = -(-2 * most // block)
        left = left.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(most)), F.lit(most)))
        flown = materialize(left.groupBy("mix_id", "source", "block").applyInPandas(_fly, schema), "flight")
        decided.append(flown.where(~open_))
        left = flown.where(open_)
    landed = left.withColumn("block", F.lit(0).cast("long")).groupBy("mix_id", "source", "block").applyInPandas(_fly_and_land, schema)
    every = landed
    for d in decided:
        every = every.unionByName(d)
    repeats = F.col("base") + F.when(F.col("p") > 0.5, 1).otherwise(0)
    return every.select("mix_id", "source", "doc_id", "tokens", repeats.alias("repeats")).where("repeats > 0")


def mix_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, weight, records, uses, tokens, share): what each source of targets
    really has of the tokens of its mix."""
    used = F.col("tokens") * F.col("repeats")
    sums = selection.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("records"), F.sum("repeats").alias("uses"), F.sum(used).alias("tokens"))
    whole = sums.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    rows = targets.select("mix_id", clean_source(F.col("source")).alias("source"), "weight", "max_repeats").distinct()
    joined = rows.join(small(sums), ["mix_id", "source"], "left").join(small(whole), "mix_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select("mix_id", "source", "weight", "max_repeats", zero("records"), zero("uses"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("share"))
