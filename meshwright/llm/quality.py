"""Quality by nearest-neighbour voting in a latent semantic space.

Method: texts become vectors of hashed byte trigrams and word repeats, log
counts times inverse document frequency, projected on the leading singular
vectors of a bounded labelled sample. The sample's vectors are broadcast; every
document's cosines with all of them are computed exactly, in blocks, and the
labels of the nearest vote with their similarity as weight.

The sample's bound (``sample_rows``) bounds what is broadcast: vectors of 48
numbers each and one projection matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import labelled
from .words import spans, word_hashes

SAMPLE_ROWS = 5000
BUCKETS, REPEATS, RANK, NEIGHBOURS = 2048, 2, 48, 9
#: Votes are weighted by the similarity to this power.
SHARPNESS = 12
#: A word repeated counts as much as so many trigrams.
REPEAT_WEIGHT = 8
THRESHOLD = 0.3
MODULUS, REST = 5, 0


def counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of BUCKETS trigram counts and REPEATS counts of words equal to the last, or the last but one."""
    n = len(off) - 1
    out = np.zeros((n, BUCKETS + REPEATS), np.float32)
    if len(raw) > 2:
        b = raw.astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
        inside = row[:-2] == row[2:]
        out[:, :BUCKETS] = np.bincount((row[:-2] * BUCKETS + h)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    starts, ends, of = spans(raw, off)
    words = word_hashes(raw, starts, ends, True)
    for back in range(1, REPEATS + 1):
        same = (words[back:] == words[:-back]) & (of[back:] == of[:-back])
        out[:, BUCKETS + back - 1] = np.bincount(of[back:][same], minlength=n)
    return out


def pack(c: np.ndarray) -> list[bytes]:
    out = []
    for row in c:
        at = np.flatnonzero(row)
        out.append(at.astype("<u2").tobytes() + row[at].astype("<u4").tobytes())
    return out


def unpack(data: list[bytes]) -> np.ndarray:
    out = np.zeros((len(data), BUCKETS + REPEATS), np.float32)
    for row, d in zip(out, data):
        n = len(d) // 6
        row[np.frombuffer(d, "<u2", n)] = np.frombuffer(d, "<u4", n, 2 * n)
    return out


@dataclass
class Model:
    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def place(self, c: np.ndarray) -> np.ndarray:
        v = (np.log1p(c) * self.idf) @ self.project
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if not len(self.labels):
            return np.full(n, self.prior)
        out = np.empty(n)
        k = min(NEIGHBOURS, len(self.labels))
        v = self.place(counts(raw, off))
        for i in range(0, n, 256):
            sims = v[i : i + 256] @ self.vectors.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(float)
            weight = (weight / np.maximum(weight.max(1, keepdims=True), 1e-12)) ** SHARPNESS
            total = weight.sum(1)
            out[i : i + 256] = np.where(total > 0, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0, 1)


def train(features: np.ndarray, y: np.ndarray, seed: int = 3) -> Model:
    """Without rows every score is one half; with one label only, that label."""
    if not len(y):
        return Model(np.ones(0), np.ones(0), np.ones(0), np.zeros(0), 0.5)
    df = (features > 0).sum(0)
    idf = np.log((1 + len(y)) / (1 + df)).astype(np.float32) + np.float32(0.1)
    idf[BUCKETS:] = REPEAT_WEIGHT
    a = np.log1p(features)
    a *= idf
    rank = min(RANK, *a.shape)
    rng = np.random.Generator(np.random.PCG64(seed))
    q = rng.standard_normal((a.shape[1], rank + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration for the leading right singular vectors
        q, _ = np.linalg.qr(a.T @ (a @ q))
    small = a @ q
    _, vectors = np.linalg.eigh(small.T @ small)
    project = (q @ vectors[:, ::-1][:, :rank]).astype(np.float32)
    model = Model(idf, project, np.zeros(0), y.astype(float), float(y.mean()))
    model.vectors = (v := a @ project) / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    chosen = labelled.drawn(labels, "quality", MODULUS, REST, sample_rows)
    data, y = labelled.sample(docs, chosen, lambda raw, off: pack(counts(raw, off)))
    return train(unpack(data), y)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus held_out, score and predicted.

    Null and empty texts have no neighbours and score the sample's mean label. Labels that are null, neither 0 nor 1, or
    without a document, are not used; repeated ids count once, with the text of the smallest hash. Whole texts are scored, a
    slice of rows at a time. Rows of ``docs`` repeat as they come; columns by the new names are replaced, all others
    stay, whatever their names; empty tables give no rows. lang, source and ids never enter a score.
    """
    return labelled.scored(docs, fit(docs, labels, sample_rows).score, MODULUS, REST, threshold)
