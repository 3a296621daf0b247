"""Percentiles by radix selection on order-preserving integers.

A double is mapped to a 64-bit integer of the same order. A histogram of the leading bits
(the day state) is small, bounded by the number of digits whatever the number of rows, and
is combined with others by adding counts. From it any percentile follows with a relative
error below 2**(12 - bits), and radix_select goes on from rows to the exact value. Both
select by successive digits: level by level the next digit is histogrammed of those rows,
or entries of a state, only whose digits so far are the ones that hold a target rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.session import materialize, small

#: Digits of the exact selection, from the top: 64 bits in all. Those of a state's bits.
LEVELS = (24, 14, 13, 13)
STATE_LEVELS = (12, 12)


def with_sortable_bits(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the bits of a double as a signed long of the same order. -0.0 is 0.0; NaN is
    the largest; null stays null. Exact arithmetic only, so it stays in the JVM; the steps
    are projections of their own to keep the generated code small."""
    taken = lambda c: f"_{name}_{c}"
    a, e, r = F.col(taken("a")), F.col(taken("e")), F.col(taken("r"))
    x = F.col(column).cast("double")
    df = df.withColumn(taken("a"), F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(1.0)).otherwise(F.abs(x)))
    df = df.withColumn(taken("e"), F.floor(F.greatest(F.least(F.log2(a), F.lit(1023.0)), F.lit(-1022.0))).cast("int"))
    half = (e / 2).cast("int")
    df = df.withColumn(taken("r"), (a / F.pow(F.lit(2.0), half)) / F.pow(F.lit(2.0), e - half))
    # the logarithm may be off by one next to a power of two; a subnormal's r stays below 1
    k = F.col(taken("k"))
    df = df.withColumn(taken("k"), F.when(r >= 2, 1).when((r < 1) & (e > -1022), -1).otherwise(0))
    df = df.withColumn(taken("r"), F.when(k == 1, r / 2).when(k == -1, r * 2).otherwise(r)).withColumn(taken("e"), e + k)
    # (r - 1) * 2**52 is the mantissa under the exponent field e + 1023
    df = df.withColumn(taken("s"), (e + 1022).cast("long") * F.lit(1 << 52) + (r * float(1 << 52)).cast("long"))
    s, inf = F.col(taken("s")), F.lit(0x7FF << 52)
    size = F.when(F.isnan(x), inf + 1).when(F.abs(x) == float("inf"), inf).when(a == 0, F.lit(0).cast("long")).otherwise(s)
    df = df.withColumn(taken("s"), F.when(a.isNotNull(), size))
    return df.withColumn(name, F.when((x < 0) & ~F.isnan(x), -s).otherwise(s)).drop(*[taken(c) for c in "aerks"])


def from_bits(bits: Column) -> Column:
    """The double that sortable_bits maps to these bits."""
    a = F.abs(bits)
    field = F.shiftright(a, 52)
    part = (a - F.shiftleft(field, 52)).cast("double") / float(1 << 52)
    e = field - 1023
    half = (e / 2).cast("int")
    normal = (part + 1.0) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e - half)
    tiny = part * F.pow(F.lit(2.0), F.lit(-511)) * F.pow(F.lit(2.0), F.lit(-511))
    size = F.when(field == 0, tiny).otherwise(normal)
    size = F.when(a == F.lit(0x7FF << 52), F.lit(float("inf"))).when(a > F.lit(0x7FF << 52), F.lit(float("nan"))).otherwise(size)
    return F.when(bits < 0, -size).otherwise(size)


def long_form(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys..., measure, bits): one row per value that isn't null."""
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])
    rows = df.select(*keys, F.explode(values).alias("v")).select(*keys, "v.measure", "v.x").where("x IS NOT NULL")
    return with_sortable_bits(rows, "x", "bits").drop("x")


def digit_states(rows: DataFrame, keys: list[str], bits: int = 24) -> DataFrame:
    """(keys..., measure, digit, n): histogram of the leading `bits` bits, which is the
    state to keep of a partition or day. Combined by combine_states."""
    digit = F.shiftright("bits", 64 - bits).alias("digit")
    return rows.select(*keys, "measure", digit).groupBy(*keys, "measure", "digit").agg(F.count(F.lit(1)).alias("n"))


def combine_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of the coarser keys, by adding counts; no row is read again."""
    return states.groupBy(*keys, "measure", "digit").agg(F.sum("n").alias("n"))


def state_percentiles(states: DataFrame, keys: list[str], probs: list[float], levels: tuple[int, ...] = STATE_LEVELS) -> DataFrame:
    """(keys..., measure, p, value, n): value is the smallest number of the digits that hold
    the smallest value whose rank is at least p * n (for negative digits likewise the
    smallest number), so it is below the exact percentile by less than the digits' width, a
    share of 2**(12 - bits) of the value at most. Groups without values have no row; null
    keys are a group. levels are the digits in which the bits of the states are followed."""
    bits = sum(levels)
    at = _select(states.withColumnRenamed("digit", "code").withColumnRenamed("n", "c"), [*keys, "measure"], probs, levels)
    return at.select(*keys, "measure", "p", from_bits(F.shiftleft("prefix", 64 - bits)).alias("value"), F.col("total").alias("n"))


def _targets(probs: list[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")


def _follow(hist: DataFrame, keys: list[str], targets: Column) -> DataFrame:
    """(keys..., p, digit, total, rank): the digit that holds each target rank and the rank
    within it. Null keys group together."""
    by = W.partitionBy(*keys)
    steps = hist.withColumn("upto", F.sum("c").over(by.orderBy("digit").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(by))
    steps = steps.select("*", targets).withColumn("want", F.greatest(F.ceil(F.col("p") * F.col("total")), F.lit(1)))
    steps = steps.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("c") < F.col("want")))
    return steps.select(*keys, "p", "digit", "total", (F.col("want") - (F.col("upto") - F.col("c"))).alias("rank"))


def _select(rows: DataFrame, groups: list[str], probs: list[float], levels: tuple[int, ...]) -> DataFrame:
    """(groups..., p, total, prefix): the code that holds each target rank, of rows(groups...,
    code, c) that count c times each. levels are the widths of the code's digits."""
    shift = sum(levels) - levels[0]
    hist = rows.groupBy(*groups, F.shiftright("code", shift).alias("digit")).agg(F.sum("c").alias("c"))
    at = materialize(_follow(hist, groups, _targets(probs)).withColumnRenamed("digit", "prefix"), "radix")
    for width in levels[1:]:
        wanted = at.select(*groups, "prefix").distinct()
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in groups]
        left = rows.withColumn("prefix", F.shiftright("code", shift)).alias("r")
        inside = left.join(small(wanted).alias("w"), [*same, F.col("r.prefix") == F.col("w.prefix")], "left_semi")
        shift -= width
        digit = (F.shiftright("code", shift) - F.shiftleft("prefix", width)).alias("digit")
        hist = inside.select(*groups, "prefix", digit, "c").groupBy(*groups, "prefix", "digit").agg(F.sum("c").alias("c"))
        by = W.partitionBy(*groups, "prefix").orderBy("digit").rowsBetween(W.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("c").over(by)).alias("h")
        same = [F.col(f"h.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*groups, "prefix"]]
        hit = at.alias("t").join(hist, [*same, F.col("upto") >= F.col("rank"), F.col("upto") - F.col("c") < F.col("rank")])
        at = hit.select(
            *[F.col(f"t.{k}").alias(k) for k in groups], "p", "total", (F.shiftleft("t.prefix", width) + F.col("digit")).alias("prefix"), (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank")
        )
        at = materialize(at, "radix")
    return at


def radix_select(rows: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys..., measure, p, value, n): the exact percentile, i.e. the smallest value whose
    rank is at least p * n. rows is what long_form gives; groups without values have no
    row; null keys are a group; ties need no care, as equal values share all digits."""
    at = _select(rows.withColumnRenamed("bits", "code").withColumn("c", F.lit(1).cast("long")), [*keys, "measure"], probs, LEVELS)
    return at.select(*keys, "measure", "p", from_bits(F.col("prefix")).alias("value"), F.col("total").alias("n"))
