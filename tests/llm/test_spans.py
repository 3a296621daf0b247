"""Shared spans against brute force."""

import random

import numpy as np
import pytest

from plumbline.llm import spans
from plumbline.llm.spans import Index, longest_factors, parse, sequence_pieces, shared_spans, text_pieces


def brute(records: dict, span: int) -> set:
    owners: dict = {}
    for r, seq in records.items():
        for i in range(len(seq) - span + 1):
            w = tuple(seq[i : i + span])
            if None not in w:
                owners.setdefault(w, set()).add(r)
    out = set()
    for r, seq in records.items():
        hit = [False] * len(seq)
        for i in range(len(seq) - span + 1):
            w = tuple(seq[i : i + span])
            if None not in w and len(owners[w]) > 1:
                hit[i : i + span] = [True] * span
        i = 0
        while i < len(seq):
            if hit[i]:
                j = i
                while j + 1 < len(seq) and hit[j + 1]:
                    j += 1
                out.add((r, i, j))
                i = j
            i += 1
    return out


def texts(seed: int, n: int = 40) -> dict:
    r = random.Random(seed)
    pool = ["".join(r.choice("abcé\n😀") for _ in range(r.randint(5, 60))) for _ in range(12)] + ["a" * 90, "ab" * 50]
    return {i: "".join(r.choice(pool) if r.random() < 0.7 else r.choice("xyz") * r.randint(1, 30) for _ in range(r.randint(0, 9))) for i in range(n)}


def rows(df):
    return {(x.rec_id, x.from_pos, x.to_pos) for x in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_longest_factors_and_parse(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 40))) + "abba" * r.randint(0, 5) for _ in range(12)]
    owners = [r.choice([-1, 0, 1, 2]) for _ in texts]
    block = np.array([c for k, t in enumerate(texts) for c in (*map(ord, t), 1000 + k)], np.uint64)
    owner = np.array([o for o, t in zip(owners, texts) for _ in range(len(t) + 1)])
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    got = longest_factors(Index(block), owner)
    others = lambda k: [t for j, t in enumerate(texts) if j != k and (owners[j] != owners[k] or owners[k] < 0)]
    for k, t in enumerate(texts):
        for i in range(len(t)):
            best = 0
            while i + best < len(t) and any(t[i : i + best + 1] in o for o in others(k)) or (owners[k] < 0 and i + best < len(t) and t.count(t[i : i + best + 1]) + _overlaps(t, t[i : i + best + 1]) > 1):
                best += 1
            assert got[first[k] + i] == best
    for span in (3, 6):
        phrase, begin, end = parse(first, np.array(list(map(len, texts))), got, span)
        assert ((end - begin) >= span).all()
        for k, t in enumerate(texts):
            want = {p for i in range(len(t)) if got[first[k] + i] >= span for p in range(i, i + got[first[k] + i])}
            assert want == {p for q, a, b in zip(phrase, begin, end) if q == k for p in range(a, b)}


def _overlaps(text, part):
    return sum(text.startswith(part, i) for i in range(len(text))) - text.count(part)


@pytest.mark.parametrize("block,part,phrase,held", [(2000, 1 << 20, 512, 1 << 20), (1, 1 << 20, 512, 1 << 20), (2000, 100, 7, 1 << 20), (2000, 1 << 20, 512, 60)])
def test_texts_match_brute_force(spark, monkeypatch, block, part, phrase, held):
    monkeypatch.setattr(spans, "PART", part)
    monkeypatch.setattr(spans, "BLOCK", held)
    monkeypatch.setattr(spans, "PHRASE", phrase)
    records = texts(block + part)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in records.items()], "id long, body string, rec_id string, base int")
    for span, gram in ((16, 5), (16, 16)):
        got = rows(shared_spans(text_pieces(df, "id", "body"), span, gram, block=block))
        assert got == brute(records, span)


def test_nulls_resent_rows_and_empty_tables(spark):
    long = "q" * 30 + "".join(chr(97 + i % 26) for i in range(400))
    data = [(1, long), (1, long), (2, None), (None, long), (3, ""), (4, "short")]
    df = spark.createDataFrame(data, "id long, body string")
    assert rows(shared_spans(text_pieces(df, "id", "body"), 16, 5)) == set()
    df = spark.createDataFrame([*data, (5, "!" + long)], "id long, body string")
    assert rows(shared_spans(text_pieces(df, "id", "body"), 16, 5)) == {(1, 0, 429), (5, 1, 430)}
    assert rows(shared_spans(text_pieces(df.limit(0), "id", "body"), 16, 5)) == set()
    with pytest.raises(ValueError):
        shared_spans(text_pieces(df, "id", "body"), 4, 5)


def test_sequences_match_brute_force_across_pieces(spark):
    r = random.Random(5)
    block = [r.randint(0, 50) for _ in range(30)]
    records = {i: [r.choice([None, *range(4)]) for _ in range(r.randint(0, 20))] + block[: r.randint(0, 30)] + [7] * r.randint(0, 12) for i in range(30)}
    data = [(i, p, v) for i, s in records.items() for p, v in enumerate(s)]
    df = spark.createDataFrame(data + data[:50], "f long, pos int, h long")
    for piece in (1 << 16, 10):
        got = rows(shared_spans(sequence_pieces(df, "f", "pos", "h", 6, piece), 6, 3))
        assert got == brute(records, 6)


def test_positions_are_characters(spark):
    same = "é😀" * 40
    df = spark.createDataFrame([(1, "1" + same), (2, "22" + same)], "id long, body string")
    assert rows(shared_spans(text_pieces(df, "id", "body"), 40, 10)) == {(1, 1, 80), (2, 2, 81)}
