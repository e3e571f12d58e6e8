"""Operator 8: toxicity by FTRL-proximal logistic regression over hashed word features.

Features are the distinct words, word pairs and pairs that skip one word of a whole
text, hashed to 2^20 coordinates. Training follows McMahan et al. (2013): each
coordinate has its own learning rate, and L1 keeps a weight at exactly 0 until the
evidence for it is larger than the penalty. What is left is a list of some thousand
(coordinate, weight) pairs, which is broadcast.

The labels are read whole; the model is fitted on at most ``max_labelled`` of them,
chosen by a hash of the id, which bounds the one task that trains. Every text is
scored, whole, in one pass over the documents that shuffles nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, map_rows, whole_text

BITS = 20
#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 12_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
#: Parts of the sample that are scored by models of the other parts, to calibrate the probabilities.
CALIBRATION_PARTS = 3
#: Words that a worker remembers the hashes of.
CACHED_WORDS = 150_000
_WORD = re.compile(r"\w+")


class WordHashes(dict):
    """Word -> 64-bit hash, remembered; emptied when full so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def features(text: str, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Coordinates of all words, pairs and skip pairs of the text, with repeats."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    left = h * np.uint64(0x9E3779B97F4A7C15)
    pair = left[:-1] ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    skip = left[:-2] ^ (h[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(2))
    mixed = np.concatenate([h, pair, skip]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
    """Weights of the coordinates, the bias last. rows: distinct coordinates of each document."""
    n_coords = (1 << bits) + 1
    z, n = np.zeros(n_coords), np.zeros(n_coords)
    bias = np.array([n_coords - 1])

    def weights(at, penalty=l1):
        zs = z[at]
        w = -(zs - np.sign(zs) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= penalty, 0.0, w)

    order = np.arange(len(rows))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(order):
            at = rows[i]
            w, wb = weights(at), weights(bias, 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb[0], -35, 35))) - labels[i]
            for a, v in ((at, w), (bias, wb)):
                sigma = (np.sqrt(n[a] + g * g) - np.sqrt(n[a])) / alpha
                z[a] += g - sigma * v
                n[a] += g * g
    out = np.zeros(n_coords)
    seen = np.flatnonzero(n)
    out[seen] = weights(seen)
    out[-1] = weights(bias, 0.0)[0]
    return out


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make logits of unseen rows probabilities (Platt 1999), by Newton steps."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([logits, np.ones(len(logits))])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - goal))
        at = at - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fit_calibrated(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights fitted on all rows, with the slope and shift that rows outside a fit ask for."""
    part = np.arange(len(rows)) % CALIBRATION_PARTS
    logits = np.zeros(len(rows))
    for k in range(CALIBRATION_PARTS):
        w = fit_ftrl([r for r, p in zip(rows, part, strict=True) if p != k], labels[part != k])
        for i in np.flatnonzero(part == k):
            logits[i] = w[rows[i]].sum() + w[-1]
    slope, shift = calibrate(logits, labels)
    w = fit_ftrl(rows, labels) * slope
    w[-1] += shift
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, label, text) of at most max_rows labelled documents, those with the least hash of the id.

    Labels that are null or not in the training folds are left out; of several labels
    of one id the largest counts. Of several documents with one id one is a row, that
    with the least hash of its text, so an id that very many documents have is no more
    than one row of the sample. Rows of equal id and text are one document.
    """
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    ids = durable(ids.orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    texts = docs.select(F.col(id_col).alias("_doc"), whole_text(text_col).alias("_text"))
    found = texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    # The aggregation keeps one text of an id before the shuffle.
    one = found.groupBy("_id").agg(F.min_by(F.struct("_label", "_text"), F.xxhash64("_text")).alias("x"))
    return one.select(F.col("_id").alias("id"), F.col("x._label").alias("label"), F.col("x._text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> pd.DataFrame:
    """The model as (coordinate, weight) rows, only those that are not 0; the bias is the last coordinate."""
    sample = labelled_sample(docs, labels, label_col, learn, max_labelled, id_col, text_col)

    def extract(batches):
        hashes = WordHashes()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "coords": [np.unique(features(t, hashes)).astype("<i4").tobytes() for t in pdf["text"]]})

    def learn_weights(batches):
        pdf = pd.concat(list(batches) or [pd.DataFrame({"id": [], "label": [], "coords": []})]).sort_values(["id", "coords"])
        rows = [np.frombuffer(b, "<i4") for b in pdf["coords"]]
        w = fit_calibrated(rows, pdf["label"].to_numpy(float))
        at = np.flatnonzero(w)
        at = at if len(w) - 1 in at else np.append(at, len(w) - 1)
        yield pd.DataFrame({"coordinate": at, "weight": w[at]})

    coords = map_rows(sample, extract, "id long, label int, coords binary")
    return coords.repartition(1).mapInPandas(learn_weights, "coordinate long, weight double").toPandas()


def score(docs: DataFrame, model: pd.DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id if None) of each document, and its score in 0..1."""
    shared = docs.sparkSession.sparkContext.broadcast((model["coordinate"].to_numpy(), model["weight"].to_numpy()))
    keep = keep or [id_col]

    def apply(batches):
        at, w = shared.value
        weights = np.zeros((1 << BITS) + 1)
        weights[at] = w
        hashes, bias = WordHashes(), weights[-1]
        for pdf in batches:
            sums = []
            for text in pdf["_scored_text"]:
                f = features(text, hashes)
                f = np.unique(f[weights[f] != 0])
                sums.append(weights[f].sum() + bias)
            pdf = pdf.drop(columns="_scored_text")
            pdf["score"] = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35)))
            yield pdf

    picked = docs.select(*keep, whole_text(text_col).alias("_scored_text"))
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema
    return map_rows(picked, apply, schema)


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per document: id, score (higher: likelier toxic) and predicted (score >= threshold).

    Null and empty texts get the score of the bias alone. An empty table gives no
    rows; with no labels every score is 0.5. Repeated rows and equal texts get equal
    scores, and a score equal to the threshold is predicted 1. Texts of any length are
    scored whole. Columns other than the id and the text are ignored.
    """
    model = train(docs, labels, learn, label_col, id_col, text_col, max_labelled)
    scored = score(docs, model, id_col, text_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
