"""Percentiles against sorting."""

import math
import random
import struct

from plumbline.llm.radix import combine_states, digit_states, from_bits, long_form, radix_select, state_percentiles, with_sortable_bits
from pyspark.sql import functions as F


def test_bits_are_those_of_the_double_and_come_back(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 8191.999999999999, 0.1]
    xs += [x for x in (struct.unpack("d", r.randbytes(8))[0] for _ in range(500)) if x == x] + [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1000, 9)]
    df = spark.createDataFrame([(x,) for x in xs] + [(math.nan,), (None,)], "x double")
    got = with_sortable_bits(df, "x", "b").withColumn("y", from_bits(F.col("b"))).collect()
    for row in got:
        if row.x is None:
            assert row.b is None and row.y is None
        elif row.x != row.x:
            assert row.b == (0x7FF << 52) + 1 and row.y != row.y
        else:
            want = struct.unpack("q", struct.pack("d", abs(row.x)))[0]
            assert row.b == (-want if row.x < 0 else want) and row.y == row.x


def rank(xs, p):
    xs = sorted(xs)
    return xs[max(math.ceil(p * len(xs)), 1) - 1]


def test_percentiles_by_day_combined_and_exact(spark):
    r = random.Random(2)
    data = [(r.choice(["a", "b", None]), r.randint(1, 4), r.choice([None, r.gauss(0, 1000), r.expovariate(1) * 10 ** r.randint(-9, 9), 5.0]), "x", 0) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, day int, v double, digit string, p int")
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    rows = long_form(df, ["g", "day"], ["v"])
    days = digit_states(rows, ["g", "day"])
    both = {("day", x.g, x.day, x.p): x for x in state_percentiles(days, ["g", "day"], probs).collect()}
    both |= {("all", x.g, None, x.p): x for x in state_percentiles(combine_states(days, ["g"]), ["g"], probs).collect()}
    one = state_percentiles(combine_states(days, ["g"]), ["g"], probs, (24,))
    assert {tuple(x) for x in one.collect()} == {tuple(x) for x in state_percentiles(combine_states(days, ["g"]), ["g"], probs, (8, 8, 8)).collect()}
    exact = {(x.g, x.p): x for x in radix_select(rows, ["g"], probs).collect()}
    for (kind, g, day, p), x in both.items():
        xs = [d[2] for d in data if d[0] == g and d[2] is not None and (kind == "all" or d[1] == day)]
        want = rank(xs, p)
        assert x.n == len(xs) and x.value <= want and want - x.value <= abs(want) * 2.0**-11
        if kind == "all":
            assert exact[g, p].value == want and exact[g, p].n == len(xs)
    assert len(both) == 5 * (3 + 12)


def test_empty(spark):
    rows = long_form(spark.createDataFrame([("a", None)], "g string, v double"), ["g"], ["v"])
    assert radix_select(rows, ["g"], [0.5]).count() == 0
    assert state_percentiles(digit_states(rows, ["g"]), ["g"], [0.5]).count() == 0
