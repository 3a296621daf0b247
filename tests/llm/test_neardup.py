"""Near-duplicates against brute force."""

import random
import re

from pyspark.sql import functions as F

from plumbline.llm.neardup import record_links, repetitions, similar_classes, similar_pairs


def sets(records: dict, width: int) -> dict:
    out = {}
    for r, seq in records.items():
        if isinstance(seq, str):
            seq = [w.lower() for w in re.findall("[A-Za-z0-9_]+", seq)]
        s = {t for t in zip(*(seq[i:] for i in range(width))) if None not in t}
        if s:
            out[r] = s
    return out


def brute(records: dict, width: int, threshold: float) -> set:
    s = sets(records, width)
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


def texts(seed: int, n: int) -> dict:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = {}
    for i in range(n):
        if out and r.random() < 0.6:
            w = out[r.choice(list(out))].split()
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.3:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
        else:
            w = ["licence", "header", "of", "all", "files", "here"] + [r.choice(words) for _ in range(r.randint(20, 60))]
        out[i] = " ".join(w)
    return out


def found(spark, records, **more):
    df = spark.createDataFrame([(k, v, 0, [1]) for k, v in records.items()], "rec_id long, seq string, size int, buckets array<int>")
    return {tuple(x) for x in similar_pairs(*similar_classes(df, 3, 0.5, **more)).collect()}


def test_recall_and_precision(spark):
    records = texts(1, 400)
    want = brute(records, 3, 0.5)
    got = found(spark, records)
    assert got <= want
    assert len(got) >= 0.99 * len(want) > 100


def test_large_buckets_are_split_and_tiled_without_loss(spark):
    records = texts(2, 200)
    want = brute(records, 3, 0.5)
    got = found(spark, records, limit=5, levels=2, recall=0.9999999)
    assert got <= want
    assert len(got) >= 0.98 * len(want)


def test_recall_by_levels_and_target(spark):
    records = texts(4, 300)
    want = brute(records, 3, 0.5)
    for levels in (1, 2, 4):
        got = found(spark, records, limit=4, levels=levels)
        assert got <= want and len(got) >= 0.995 * len(want)
    few = found(spark, records, recall=0.3, picks=1.0)
    assert 0.3 * len(want) <= len(few) <= len(want)
    assert [repetitions(0.5, 4.0, r) for r in (0.5, 0.9999)] == [1, 4]


def test_copies_share_a_class(spark):
    data = [(1, "a b c d e"), (2, "A-b C\nd e"), (3, "a b c d e"), (3, "a b c d e"), (4, None), (None, "a b c d e"), (5, ""), (6, "a b"), (7, "a b c d f")]
    df = spark.createDataFrame(data, "rec_id long, seq string")
    members, links = similar_classes(df, 3, 0.5)
    assert {tuple(x) for x in members.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7)}
    assert {tuple(x) for x in similar_pairs(members, links).collect()} == {(1, 2), (1, 3), (2, 3), (1, 7), (2, 7), (3, 7)}
    assert {tuple(x) for x in record_links(members, links).collect()} == {(1, 1, 2, 1), (2, 1, 2, 1), (3, 1, 2, 1), (7, 7, 0, 3)}
    members, links = similar_classes(df.limit(0), 3, 0.5)
    assert members.count() == 0 and links.count() == 0


def test_arrays_with_nulls_and_long_records(spark):
    r = random.Random(3)
    long = [r.randint(0, 10**6) for _ in range(30_000)]
    records = {1: long, 2: long[:20_000], 3: [None] * 50, 4: [1, 2, None, 3, 4, 5], 5: [9, 3, 4, 5], 6: [7] * 1000, 7: [7] * 5}
    df = spark.createDataFrame(list(records.items()), "rec_id long, seq array<long>")
    got = {tuple(x) for x in similar_pairs(*similar_classes(df, 3, 0.5)).collect()}
    assert got == brute(records, 3, 0.5)
    _, links = similar_classes(df, 3, 0.5)
    assert links.agg(F.min("similarity")).first()[0] >= 0.5
