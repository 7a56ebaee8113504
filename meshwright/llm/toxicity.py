"""Toxicity by weak supervision.

Method: many voters (lexicon entries, words and word beginnings, mined from
labelled rows that may be learned from, once for being there and once for
coming up often; and a few surface patterns) vote on a bounded sample of documents. A generative label model, fitted by expectation
maximisation without labels, estimates each voter's rates under either class
and the voters' correlations given the class; correlated voters share their
weight. A linear classifier is trained on the posterior labels and scores every
document by the terms it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import labelled
from .words import U64, avalanche, spans, word_hashes

SAMPLE_ROWS = 8000
BITS = 18
#: Lengths of the word beginnings, in bytes, that are terms beside whole words.
BEGINNINGS = (4, 5, 6)
VOTERS, FEATURES = 80, 256
#: Penalty on the classifier's squared weights.
RIDGE = 0.3
#: A lexicon entry is found in so many learned rows of class 1, and so large a share of the rows that hold it is of class 1.
MIN_SUPPORT, PRECISION = 4, 0.9
#: A term that comes so often in a row is a second term of the row: a beginning that many of its words share.
OFTEN = 3
THRESHOLD = 0.7
MODULUS, REST = 3, 1
PATTERNS = 3

#: The second term of each term.
_SECOND = (avalanche(np.arange(1, (1 << BITS) + 1, dtype=U64)) >> U64(64 - BITS)).astype(np.int64)
_OTHER = np.ones(256, bool)
_OTHER[65:91] = _OTHER[97:123] = False
_OTHER[128:] = False


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every word (a run of letters, A-Z folded) and its beginnings; not deduplicated."""
    starts, ends, row = spans(raw, off, _OTHER)
    rows, found = [], []
    for kind, length in enumerate((None, *BEGINNINGS)):
        use = slice(None) if length is None else np.flatnonzero(ends - starts > length)
        s = starts[use]
        h = word_hashes(raw, s, ends[use] if length is None else s + length, True)
        rows.append(row[use])
        found.append(((h + U64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def patterns(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Surface voters of each row: many exclamation marks, mostly capitals, no letters at all."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    total = np.maximum(np.diff(off), 1)
    marks = np.bincount(row[raw == 33], minlength=n)
    upper = np.bincount(row[(raw >= 65) & (raw <= 90)], minlength=n)
    letters = np.bincount(row[~_OTHER[raw]], minlength=n)
    return np.stack([marks * 100 > total, upper * 2 > np.maximum(letters, 1), letters == 0], 1)


def present(raw: np.ndarray, off: np.ndarray, of_interest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term), of those of interest; a term that comes OFTEN has a second one beside it."""
    row, term = terms(raw, off)
    if of_interest is not None:
        keep = (of_interest | of_interest[_SECOND])[term]
        row, term = row[keep], term[keep]
    both, n = np.unique((row << BITS) | term, return_counts=True)
    row, term, often = both >> BITS, both & ((1 << BITS) - 1), n >= OFTEN
    row, term = np.concatenate([row, row[often]]), np.concatenate([term, _SECOND[term[often]]])
    if of_interest is not None:
        keep = of_interest[term]
        row, term = row[keep], term[keep]
    both = np.unique((row << BITS) | term)
    return both >> BITS, both & ((1 << BITS) - 1)


def extract(raw: np.ndarray, off: np.ndarray) -> list[bytes]:
    row, term = present(raw, off)
    cut = np.searchsorted(row, np.arange(len(off)))
    seen = patterns(raw, off).astype(np.uint8)
    return [p.tobytes() + term[a:b].astype("<u4").tobytes() for p, a, b in zip(seen, cut[:-1].tolist(), cut[1:].tolist())]


def label_model(votes: np.ndarray, lexicon: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of 0/1 votes, the voters' rates by class, and their correlations given the class.

    The first ``lexicon`` voters vote for class 1; it starts from two such votes. A voter that doesn't fire abstains, as
    a lexicon of another language must; that no lexicon voter fires is a voter of its own, among the others. A voter's
    log-odds are divided by one plus twice its correlations' excess over 0.5, so that near-copies count as one.
    """
    v = votes.astype(float)
    p = np.where(v[:, :lexicon].sum(1) >= 2, 0.95, 0.02)
    r0 = r1 = corr = None
    for _ in range(rounds):
        prior = np.clip(p.mean(), 1e-3, 0.5)
        r1 = (p @ v + 0.05) / (p.sum() + 1)
        r0 = ((1 - p) @ v + 0.05) / ((1 - p).sum() + 1)
        c = np.where(p[:, None] > 0.5, v - r1, v - r0)
        cov = c.T @ c / len(v)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(sd, sd)
        share = 1 / (1 + 2 * np.maximum(corr - np.eye(len(sd)) - 0.5, 0).sum(1))
        z = np.log(prior / (1 - prior)) + v @ (np.log(r1 / r0) * share)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, np.stack([r0, r1]), corr


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    rates: np.ndarray | None = None

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, term = present(raw, off, self.weights != 0)
        z = self.bias + np.bincount(row, self.weights[term], len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _entries(row: np.ndarray, term: np.ndarray, y: np.ndarray, ranked: np.ndarray, most: int) -> np.ndarray:
    """The best terms, without those found in nearly the documents of class 1 that one better term is found in."""
    at = np.full(1 << BITS, -1)
    at[ranked] = np.arange(len(ranked))
    use = (at[term] >= 0) & (y[row] == 1)
    holds = np.zeros((len(ranked), int(row.max()) + 1 if len(row) else 0), bool)
    holds[at[term[use]], row[use]] = True
    chosen: list[int] = []
    for i, own in enumerate(holds):
        if len(chosen) == most:
            break
        if not chosen or (holds[chosen][:, own].sum(1) / np.maximum(holds[chosen].sum(1), own.sum())).max() < 0.8:
            chosen.append(i)
    return ranked[chosen]


def _distinct(held: list[np.ndarray]) -> np.ndarray:
    """One row of each group of near-copies, which would make any word of theirs look telling: rows that agree in a band of min-hashes with an earlier row go."""
    seeds = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, (2, 4), dtype=np.uint64) | U64(1)
    seen: set[tuple] = set()
    keep = np.ones(len(held), bool)
    for i, terms_ in enumerate(held):
        if not len(terms_):
            continue
        mixed = avalanche(terms_.astype(U64)[:, None, None] * seeds)
        bands = {(b, *m) for b, m in enumerate(mixed.min(0).tolist())}
        keep[i] = not bands & seen
        seen |= bands
    return keep


def train(data: list[bytes], y: np.ndarray, voters: int = VOTERS, features: int = FEATURES) -> Model:
    """Without rows of both classes every score is the share of class 1, or 0.5 without rows."""
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(1 << BITS), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    surface = np.array([list(d[:PATTERNS]) for d in data], bool)
    held = [np.frombuffer(d, "<i4", offset=PATTERNS) for d in data]
    first = _distinct(held)
    if y[first].any() and not y[first].all():
        held, surface, y = [h for h, k in zip(held, first) if k], surface[first], y[first]
    row, term = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held]), np.concatenate(held)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    df1, df0 = np.bincount(term[y[row] == 1], minlength=1 << BITS), np.bincount(term[y[row] == 0], minlength=1 << BITS)
    expected = (df0 + 0.5) * n1 / n0
    gain = (df1 - expected) / np.sqrt(expected + 1)
    gain[(df1 < max(MIN_SUPPORT, n1 // 100)) | (df1 < PRECISION * (df1 + df0))] = 0
    lexicon = _entries(row, term, y, np.flatnonzero(gain > 0)[np.argsort(-gain[gain > 0], kind="stable")][: 40 * voters], voters)
    if not len(lexicon):
        return Model(np.zeros(1 << BITS), float(np.log(n1 / n0)))

    def dense(chosen: np.ndarray) -> np.ndarray:
        at = np.full(1 << BITS, -1)
        at[chosen] = np.arange(len(chosen))
        out = np.zeros((len(held), len(chosen)), np.float32)
        use = at[term] >= 0
        out[row[use], at[term[use]]] = 1
        return out

    entries = dense(lexicon)
    votes = np.concatenate([entries, entries.sum(1, keepdims=True) == 0, surface], 1)
    p, rates, _ = label_model(votes, len(lexicon))
    df = np.bincount(term, minlength=1 << BITS)
    with_p = np.bincount(term, p[row], 1 << BITS)
    lift = np.abs(with_p - df * p.mean()) / np.sqrt(df + 5)
    lift[df < 4] = 0
    chosen = np.union1d(lexicon, np.argsort(-lift, kind="stable")[:features])
    x = dense(chosen)
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    ridge = np.append(np.full(len(chosen), RIDGE), 0)
    w = np.zeros(len(ridge))
    w[-1] = np.log(p.mean() / (1 - p.mean()))
    for _ in range(25):  # Newton steps on the cross-entropy with the posteriors
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(q * (1 - q), 1e-4)[:, None].astype(np.float32)).T @ x
        step = np.linalg.solve(h.astype(float) + np.diag(ridge + 1e-6), x.T @ (p - q) - ridge * w)
        w += step * min(1.0, 2.0 / np.abs(step).max())  # no step so long that it overshoots
        if np.abs(step).max() < 1e-3:
            break
    w, b = w[:-1], float(w[-1])
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w
    return Model(weights, b, rates)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    chosen = labelled.drawn(labels, "toxic", MODULUS, REST, sample_rows)
    return train(*labelled.sample(docs, chosen, extract))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus held_out, score and predicted.

    Null and empty texts score by the classifier's bias alone. Labels that are null, neither 0 nor 1, or without a
    document, are not used; repeated ids count once, with the text of the smallest hash. Whole texts are scored, a slice of
    rows at a time. Rows of ``docs`` repeat as they come; columns by the new names are replaced, all others stay,
    whatever their names; empty tables give no rows. lang, source and ids never enter a score.
    """
    return labelled.scored(docs, fit(docs, labels, sample_rows).score, MODULUS, REST, threshold)
