"""Packing and mixing: invariants, and comparison with first-fit decreasing."""

import random
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import packing
from plumbline.llm.mixing import flight, landing, mix, mix_rates, mix_shares
from plumbline.llm.packing import pack, plan
from plumbline.llm.tokens import Counter, token_counts


def first_fit(items, capacity):
    room = []
    for x in sorted(items, reverse=True):
        for i, r in enumerate(room):
            if r >= x:
                room[i] -= x
                break
        else:
            room.append(capacity - x)
    return len(room)


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_all_and_no_worse_than_first_fit(seed):
    r = random.Random(seed)
    items = [r.choice([r.randint(1, 100), r.randint(30, 60), 33]) for _ in range(3000)]
    lengths, counts = np.unique(items, return_counts=True)
    out, greedy = plan(lengths, counts, 100)
    used = defaultdict(int)
    for combo, n in out:
        assert n > 0 and sum(x * m for x, m in combo.items()) <= 100
        for x, m in combo.items():
            used[x] += m * n
    assert dict(used) == dict(zip(lengths.tolist(), counts.tolist()))
    assert sum(n for _, n in out) <= first_fit(items, 100) * 1.01 + 1
    assert greedy <= 0.2 * len(items)


def test_plans_of_odd_histograms():
    for lengths, counts in (([7], [1]), ([100], [5]), ([51], [999]), ([1], [12345]), ([99, 2], [3, 4]), ([50], [3]), ([33, 34, 67], [10, 10, 10])):
        out, _ = plan(np.array(lengths), np.array(counts), 100)
        used = defaultdict(int)
        for combo, n in out:
            assert sum(x * m for x, m in combo.items()) <= 100
            for x, m in combo.items():
                used[x] += m * n
        assert dict(used) == dict(zip(lengths, counts))


@pytest.mark.parametrize("ranks", [1 << 14, 4])
def test_pack_splits_only_what_exceeds_the_capacity(spark, monkeypatch, ranks):
    monkeypatch.setattr(packing, "RANKS", ranks)
    r = random.Random(1)
    docs = [(i, r.choice([0, None, 7, 7, 7, r.randint(1, 350)]), "x", 1) for i in range(800)] + [(None, 5, "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, tokens long, spec_id string, rank int")
    out = pack(df, [(1, 100), (2, 1000), (3, 0), (4, None)]).collect()
    size = {d: n for d, n, *_ in docs if d is not None and n}
    for spec, capacity in ((1, 100), (2, 1000)):
        rows = [x for x in out if x.spec_id == spec]
        full, pieces = defaultdict(int), defaultdict(list)
        for x in rows:
            full[x.container_id] += x.tokens
            pieces[x.doc_id].append((x.from_token, x.tokens, x.piece))
        assert max(full.values()) <= capacity and set(full) == set(range(len(full)))
        assert set(pieces) == set(size)
        for d, p in pieces.items():
            p.sort()
            assert sum(t for _, t, _ in p) == size[d] and len(p) == -(-size[d] // capacity)
            assert [a for a, _, _ in p] == [i * capacity for i in range(len(p))]
    assert {x.spec_id for x in out} == {1, 2}
    assert pack(df.limit(0), [(1, 100)]).count() == 0 and pack(df, []).count() == 0


def test_token_counts_equal_the_tokenizer(spark):
    count = Counter()
    r = random.Random(4)
    bits = ["word", "Wörter", " ", "  ", "\n", "\t ", " \n", "it's", "12,5", "é", "😀", "...", " a", "\xa0", "don't", "中文"]
    for _ in range(2000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        assert count(text) == len(count.encoding.encode_ordinary(text)), repr(text)
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id long, tokens string")
    assert {tuple(x) for x in token_counts(df, "id", "tokens").collect()} == {(1, 2), (2, 0), (3, 0)}


def test_flight_keeps_the_sums_and_landing_is_close():
    r = np.random.default_rng(1)
    size = r.integers(1, 5000, 400)
    p = np.full(400, 0.37)
    out = flight(p, size, 3)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    done = landing(out, size)
    assert set(done.tolist()) <= {0.0, 1.0} and abs((done * size).sum() - (p * size).sum()) <= 5000
    mean = np.mean([landing(flight(p[:20], size[:20], s), size[:20]) for s in range(300)], axis=0)
    assert abs(mean - 0.37).max() < 0.15
    assert flight(np.array([]), np.array([]), 1).size == 0
    assert set(flight(np.full(9, 0.5), np.full(9, 4), 1).tolist()) <= {0.0, 0.5, 1.0}


TARGETS = [(1, "a ", 0.5, 1, 0.5), (1, "B", 0.3, 3, 0.5), (1, "none", 0.2, 3, 0.5), (2, "a", 2.0, 2, 1.2), (2, "b", None, 2, 1.2), (2, "c", 0.0, 2, 1.2), (2, "b", None, 2, 1.2), (3, "c", 1.0, 4, 9.0)]


@pytest.mark.parametrize("block", [5000, 40])
def test_mix(spark, block):
    r = random.Random(2)
    docs = [(i, r.choice(["A", "a", "b ", "c", None]), r.choice([None, 0, r.randint(1, 900), 50]), 1) for i in range(2000)] + [(None, "a", 5, 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, repeats int")
    targets = spark.createDataFrame(TARGETS, "mix_id int, source string, weight double, max_repeats int, budget_ratio double")
    out = mix(df, targets, block=block).collect()
    corpus = sum(t or 0 for d, _, t, _ in docs)
    of = defaultdict(int)
    for x in out:
        of[x.mix_id, x.source] += x.tokens * x.repeats
        assert x.repeats >= 1
    assert len({(x.mix_id, x.doc_id) for x in out}) == len(out)
    assert abs(of[1, "a"] - corpus * 0.5 * 0.625) < 1000 and abs(of[1, "b"] - corpus * 0.5 * 0.375) < 1000
    assert max(x.repeats for x in out if x.mix_id == 1 and x.source == "a") == 1
    assert {s for m, s in of if m == 2} == {"a"} and max(x.repeats for x in out if x.mix_id == 2) == 2
    assert {x.repeats for x in out if x.mix_id == 3} == {4}
    shares = {(x.mix_id, x.source): x for x in mix_shares(mix(df, targets, block=block), targets).collect()}
    assert shares[1, "none"].tokens == 0 and abs(shares[1, "a"].share - 0.625) < 0.01
    assert mix(df.limit(0), targets).count() == 0 and mix(df, targets.limit(0)).count() == 0


def test_rates_spread_what_capped_sources_cannot_give():
    targets = [dict(mix_id=1, source=s, weight=w, max_repeats=1, budget_ratio=0.5) for s, w in (("a", 0.5), ("b", 0.5))]
    sizes = {"a": (10, 100), "b": (10, 900)}
    rates = {r["source"]: r["rate"] for r in mix_rates(sizes, targets, 1000)}
    assert rates["a"] == 1.0 and abs(rates["b"] * 900 - 400) < 1e-9
    rates = {r["source"]: r["rate"] for r in mix_rates(sizes, targets, 1000, spread=False)}
    assert rates["a"] == 1.0 and abs(rates["b"] * 900 - 250) < 1e-9
