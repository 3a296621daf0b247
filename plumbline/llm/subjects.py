"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams.

The classifiers see sentences. A sentence of a labelled document is a weakly labelled
example of the document's subjects, and so is one of a document whose header names a
chamber (section metadata, less weight). As the classifiers are discriminative, wording
that goes with asides (a term of another subject in a sentence that says the case is not
about it) gets a negative weight for all subjects. A second round relabels the sentences
of documents with several subjects by the first round's scores.

A document's share of a subject is the part of its topical sentences that go to the
subject; per-subject thresholds on share are calibrated on labelled documents held out
from the classifier they are scored by.

Only the reasoning counts: the numbered paragraphs, without page headers, citations and
what stands in brackets. The number of documents to train on is bounded by a parameter;
every document is classified on its whole text.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import small

#: Size of the hashed feature space (a power of two).
BUCKETS = 1 << 17

_PARAGRAPH = re.compile(r"^\s*(?:(?:¶|§|rn\.|para\.?|abs\.)\s*\d+\b|\[\d+\]|\(\d+\)|\d+\s*\.(?!\d)|\d+\)|\d+\s{2,})\s*", re.I)
_PAGE = re.compile(r"^\s*(?:[-–]\s*\d+\s*[-–]|page\s+\d+\s+(?:of|/)\s+\d+|\d+\s*/\s*\d+\s+\S+\s+\d+/\d+|.*\s·\s.*\s·\s*\d+)\s*$", re.I)
_BRACKETS = re.compile(r"\([^()]*\)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-Ý§¶\[])")
_TOKEN = re.compile(r"[^\W\d_]+|\n")
_CHAMBER = re.compile(r"^\s*(?:chamber|kammer|chambre|section|senat)\s*:\s*(.+?)\s*$", re.I | re.M)
_FOLD = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "é": "e", "è": "e", "ê": "e", "à": "a", "â": "a", "î": "i", "ï": "i", "ô": "o", "û": "u", "ç": "c"})


def reasoning(text: str) -> list[str]:
    """Sentences of the numbered paragraphs."""
    paragraphs: list[list[str]] = []
    for line in text.replace("\r", "").replace("\xa0", "  ").split("\n"):
        if _PAGE.match(line):
            continue
        if m := _PARAGRAPH.match(line):
            paragraphs.append([line[m.end() :]])
        elif paragraphs and line.strip():
            paragraphs[-1].append(line.strip())
    out = []
    for p in paragraphs:
        body = re.sub(r"(\w)-\s+(?=[a-zà-ÿ])", r"\1", " ".join(p))
        while (shorter := _BRACKETS.sub(" ", body)) != body:
            body = shorter
        out += [s for s in _SENTENCE.split(body) if s.strip()]
    return out


def chamber(text: str) -> str | None:
    m = _CHAMBER.search(text)
    return fold(m.group(1)) if m else None


def fold(s: str) -> str:
    """Lower case, umlauts and accents spelled out, digits that scans put for letters."""
    return " ".join(_plain(s.lower()).replace("0", "o").replace("1", "l").split())


def _plain(s: str) -> str:
    return s if s.isascii() else s.translate(_FOLD)


def features(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row starts and hashed features of sentences: words, pairs of neighbours and pairs
    with one word between."""
    found = _TOKEN.findall(_plain("\n".join(sentences).lower())) if sentences else []
    h = pd.util.hash_array(np.array(found, object), categorize=True) if found else np.zeros(0, np.uint64)
    is_end = h == pd.util.hash_array(np.array(["\n"], object))[0]
    row = np.cumsum(is_end)
    h, row = h[~is_end], row[~is_end]
    n = np.bincount(row, minlength=len(sentences)) if len(sentences) else np.zeros(0, np.int64)
    pairs, skips = np.maximum(n - 1, 0), np.maximum(n - 2, 0)
    starts = np.concatenate([[0], np.cumsum(n + pairs + skips)]).astype(np.int64)
    out = np.empty(starts[-1], np.uint64)
    first = np.cumsum(n) - n
    within = np.arange(len(h)) - first[row]
    out[starts[row] + within] = h
    for gap, salt, before in ((1, 0x9E3779B97F4A7C15, n), (2, 0xC2B2AE3D27D4EB4F, n + pairs)):
        at = np.flatnonzero(row[gap:] == row[:-gap]) if len(h) > gap else np.zeros(0, np.int64)
        out[starts[row[at]] + before[row[at]] + within[at]] = (h[at] * np.uint64(salt)) ^ h[at + gap]
    return starts, (out * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _logits(weights: np.ndarray, starts: np.ndarray, feats: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(starts) - 1, weights.shape[1]), np.float32)
    rows = np.flatnonzero(np.diff(starts))
    if len(rows):
        sums[rows] = np.add.reduceat(weights[feats], starts[rows], axis=0)
    return sums + weights[BUCKETS]


def train(starts: np.ndarray, feats: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 1024, rate: float = 0.15, decay: float = 1e-4) -> np.ndarray:
    """Weights of logistic one-versus-rest classifiers by Adagrad; the last row is the bias."""
    k = target.shape[1]
    w, seen = np.zeros((BUCKETS + 1, k), np.float32), np.full((BUCKETS + 1, k), 1e-2, np.float32)
    random = np.random.default_rng(7)
    n = len(starts) - 1
    for _ in range(epochs):
        order = random.permutation(n)
        for i in range(0, n, batch):
            pick = order[i : i + batch]
            size = starts[pick + 1] - starts[pick]
            at = np.arange(size.sum()) + np.repeat(starts[pick] - np.cumsum(size) + size, size)
            f, own = feats[at], np.concatenate([[0], np.cumsum(size)])
            error = (1 / (1 + np.exp(-np.clip(_logits(w, own, f), -30, 30))) - target[pick]) * weight[pick, None]
            used, place = np.unique(f, return_inverse=True)
            spread = np.repeat(error, size, axis=0)
            grad = np.stack([np.bincount(place, spread[:, c], len(used)) for c in range(k)], 1).astype(np.float32)
            grad += decay * len(pick) * w[used]
            seen[used] += grad**2
            w[used] -= rate * grad / np.sqrt(seen[used])
            bias = error.sum(0)
            seen[BUCKETS] += bias**2
            w[BUCKETS] -= rate * bias / np.sqrt(seen[BUCKETS])
    return w


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.0  # the score from which on a sentence is topical
    fallback: str | None = None  # the subject of documents that deal with no other
    ready: bool = True  # False: nothing was learnt, nothing is assigned
    index: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.index = {s: i for i, s in enumerate(self.subjects)}

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Document number and scores of each sentence; equal sentences are scored once."""
        sentences = [reasoning(t) for t in texts]
        number: dict[str, int] = {}
        which = np.array([number.setdefault(s, len(number)) for d in sentences for s in d], np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(d) for d in sentences])
        return doc, _logits(self.weights, *features(list(number)))[which]

    def labels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Document number and subject number of each case."""
        if not self.ready or not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, scores = self.scores(texts)
        shares, seen = _shares(doc, scores, len(texts), self.cut)
        return np.nonzero(_decide(shares, seen, self.thresholds, self.index.get(self.fallback)))


def _shares(doc: np.ndarray, scores: np.ndarray, n: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of topical sentences by subject, and whether a document has any reasoning. A
    sentence goes to its best subject if that one's score is above cut; where a document
    has no such sentence, its best-scored one counts."""
    counts = np.zeros((n, scores.shape[1]))
    if len(doc):
        best, top = scores.argmax(1), scores.max(1)
        limit = np.full(n, np.inf)
        np.minimum.at(limit, doc, np.float64(cut))
        most = np.full(n, -np.inf)
        np.maximum.at(most, doc, top)
        topical = top >= np.minimum(limit, most)[doc]
        np.add.at(counts, (doc[topical], best[topical]), 1)
    total = counts.sum(1)
    return counts / np.maximum(total, 1)[:, None], total > 0


def _decide(shares: np.ndarray, seen: np.ndarray, thresholds: np.ndarray, fallback: int | None) -> np.ndarray:
    hit = (shares >= thresholds) & seen[:, None]
    none = seen & ~hit.any(1)
    hit[np.flatnonzero(none), shares[none].argmax(1)] = True
    if fallback is not None:
        hit[:, fallback] &= hit.sum(1) == 1
    return hit


def fit(texts: list[str], labels: list[set[str]], weak: list[str | None], subjects: list[str], fallback: str | None = None, weak_weight: float = 0.3) -> Model:
    """A model from texts with labels (an empty set: none known) and weak labels. Labels
    outside subjects are ignored; without any usable label nothing is assigned."""
    index = {s: i for i, s in enumerate(subjects)}
    k = len(subjects)
    target, weight = np.zeros((len(texts), k), np.float32), np.zeros(len(texts), np.float32)
    known = np.zeros(len(texts), bool)
    for i, (own, hint) in enumerate(zip(labels, weak)):
        if own := own & index.keys():
            target[i, [index[s] for s in own]], weight[i], known[i] = 1, 1, True
        elif hint in index:
            target[i, index[hint]], weight[i] = 1, weak_weight
    if not weight.any():
        return Model(subjects, np.zeros((BUCKETS + 1, k), np.float32), np.full(k, 2.0), np.inf, fallback, False)
    sentences = [reasoning(t) for t in texts]
    size = np.array([len(s) for s in sentences])
    doc = np.repeat(np.arange(len(texts)), size)
    starts, feats = features([s for d in sentences for s in d])
    fold_of = np.random.default_rng(3).integers(0, 2, len(texts))

    def learn(docs: np.ndarray) -> np.ndarray:
        use = np.flatnonzero(docs[doc])
        count = starts[use + 1] - starts[use]
        at = np.arange(count.sum()) + np.repeat(starts[use] - np.cumsum(count) + count, count)
        own, f = np.concatenate([[0], np.cumsum(count)]), feats[at]
        t, wt = target[doc[use]].copy(), weight[doc[use]]
        w = train(own, f, t, wt, epochs=3)
        # second round: among a document's subjects a sentence keeps the likeliest one
        scores = np.where(t > 0, _logits(w, own, f), -np.inf)
        several = t.sum(1) > 1
        t[several] = 0
        t[np.flatnonzero(several), scores[several].argmax(1)] = 1
        return train(own, f, t, wt)

    # scores by classifiers that have not seen the document
    held_doc, held_scores = [], []
    for side in (0, 1):
        w = learn((fold_of != side) & (weight > 0))
        use = np.flatnonzero((known & (fold_of == side))[doc])
        count = starts[use + 1] - starts[use]
        at = np.arange(count.sum()) + np.repeat(starts[use] - np.cumsum(count) + count, count)
        held_doc.append(doc[use])
        held_scores.append(_logits(w, np.concatenate([[0], np.cumsum(count)]), feats[at]))
    held_doc, held_scores = np.concatenate(held_doc), np.concatenate(held_scores)
    best = (-1.0, None, 0.0)
    for cut in (-1.0, -0.5, 0.0, 0.5):
        shares, seen = _shares(held_doc, held_scores, len(texts), cut)
        thresholds = calibrate(shares[known], target[known] > 0)
        hit = _decide(shares[known], seen[known], thresholds, index.get(fallback))
        f1 = 2 * (hit & (target[known] > 0)).sum() / max(1, hit.sum() + target[known].sum())
        best = max(best, (f1, thresholds, cut), key=lambda x: x[0])
    return Model(subjects, learn(weight > 0), best[1], best[2], fallback)


def calibrate(shares: np.ndarray, truth: np.ndarray, least: int = 30) -> np.ndarray:
    """The share from which on a subject is assigned, by the best F1 of each subject; of
    all together where a subject has fewer than `least` labels."""
    grid = np.arange(0.02, 0.62, 0.02)

    def best(s: np.ndarray, t: np.ndarray) -> float:
        f1 = [2 * ((s >= g) & t).sum() / max(1, (s >= g).sum() + t.sum()) for g in grid]
        return float(grid[int(np.argmax(f1))])

    overall = best(shares, truth) if truth.any() else 0.3
    return np.array([best(shares[:, c], truth[:, c]) if truth[:, c].sum() >= least else overall for c in range(truth.shape[1])])


def training_rows(documents: DataFrame, labels: DataFrame, limit: int, hints: int) -> DataFrame:
    """(doc_id, text, labels): at most `limit` labelled documents, in the order of a hash of
    their id, and at most `hints` others that name a chamber. labels' subjects are trimmed and
    lower-cased; repeated labels count once."""
    sets = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.lower(F.trim("subject"))).alias("labels"))
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # documents are chosen by id, so that only the texts of the chosen ones are moved
    marked = texts.select("doc_id").distinct().join(sets, "doc_id").orderBy(*order).limit(limit)
    hinted = texts.where(F.col("text").rlike(r"(?im)^\s*(chamber|kammer|chambre|section|senat)\s*:")).select("doc_id").distinct()
    hinted = hinted.join(sets, "doc_id", "left_anti").orderBy(*order).limit(hints)
    chosen = marked.unionByName(hinted.withColumn("labels", F.array().cast("array<string>")))
    return texts.join(small(chosen), "doc_id").dropDuplicates(["doc_id"])


def classify(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject) for every case of documents(doc_id, text). Null ids or texts and
    texts without numbered paragraphs have none; resent rows count once."""
    sent = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                doc, subject = own.labels(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(doc)), "subject": pa.array([own.subjects[s] for s in subject], pa.string())})

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, subject string").dropDuplicates(["doc_id", "subject"])
