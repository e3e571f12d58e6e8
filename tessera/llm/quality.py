"""Operator 2: document quality by a linear-chain conditional random field over lines.

Every line of a text is a position of a chain with two labels, good and bad. A line's
evidence is a vector of measures of itself, of the line before and of the line after
(shares of kinds of characters, lengths, repetition); a 2 x 2 table scores the labels of
neighbouring lines. The chain is trained on documents, whose label stands for all their
lines, by gradient ascent on the likelihood. Forward-backward gives each line's marginal
probability of being good; a document's quality is the mean of these, weighted by the
lines' lengths, put on the scale of a probability by a logistic curve.

Lines are measured many at a time on the bytes of a piece of a batch, and chains of many
documents are walked together, so Python works per batch, not per line. A text that is longer than a
piece is read slice by slice, three times: for what the ends of slices hand to their neighbours, forward
and backward; a slice takes over a message from the one before or after it, and a line longer than a
slice is measured bit by bit. The fit uses at most ``max_labelled`` labelled rows, in one task;
scoring shuffles nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, whole_text
from tessera.llm.toxicity import calibrate, labelled_sample

MAX_LABELLED = 3_000
EPOCHS, BATCH_DOCS, RATE, L2 = 12, 100, 0.05, 2e-4
#: Bytes of texts that are measured at a time; a longer text is read in slices of that many.
PIECE_BYTES = 200_000
#: Kinds of bytes, each a share of the line.
KINDS = (
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower", b"abcdefghijklmnopqrstuvwxyz"),
    ("digit", b"0123456789"),
    ("space", b" \t\r\x0b\x0c"),
    ("stop", b".,;:?'\"-()"),
    ("mark", b"!"),
    ("bar", b"|"),
    ("symbol", b"*&%$#@^~_=+<>{}[]\\/`"),
    ("wide", bytes(range(128, 256))),
)
#: Shares, log length, mean word length, share of words equal to the one before, share of distinct neighbours, repeated line.
MEASURES = len(KINDS) + 5


def _kind_table() -> np.ndarray:
    table = np.full(256, len(KINDS), np.int64)
    for k, (_, members) in enumerate(KINDS):
        table[np.frombuffer(members, np.uint8)] = k
    return table


_WORD_WEIGHTS = np.random.default_rng(7).integers(1, 2**40, 256)


def _is_blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data == 10) | (data == 9) | (data == 13)


def _word_values(data: np.ndarray, blank: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Words are equal when sums of their bytes, weighted by the places in the word, are."""
    return np.where(blank, 0, (_WORD_WEIGHTS[data] * (2 * inside + 1)) & 0xFFFFFFFFFFFF)


def _line_values(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Lines are equal when sums of their bytes, weighted by their places, are."""
    return ((place + 1) * 0x9E3779B1 & 0xFFFFFFFF) * (data.astype(np.int64) + 1) & 0xFFFFFFFFFF


def _columns(shares, length, words, letters, again, twin) -> np.ndarray:
    per_word, safe = np.maximum(words, 1), np.maximum(length, 1)[:, None]
    return np.column_stack([shares / safe, np.log1p(length) / 6, letters / per_word / 10, again / per_word, twin / per_word])


def lines_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of bytes that end with a line end: all measures but the last, their lengths, and a key that equal lines have in common."""
    kind = _kind_table()
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, length = len(ends), ends - starts
    line = np.repeat(np.arange(n), length + 1)
    shares = np.bincount(line * (len(KINDS) + 1) + kind[data], minlength=n * (len(KINDS) + 1)).reshape(n, -1)[:, :-1]
    blank = _is_blank(data)
    first = ~blank & np.concatenate([[True], blank[:-1]])
    at = np.flatnonzero(first)
    words = np.bincount(line[at], minlength=n)
    letters = np.bincount(line[~blank], minlength=n)
    again = np.zeros(n)
    twin = np.zeros(n)
    if len(at):
        inside = np.arange(len(data)) - at[np.maximum(np.cumsum(first) - 1, 0)]
        sums = np.add.reduceat(_word_values(data, blank, inside), at)
        owner = line[at]
        same = (sums[1:] == sums[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][same], minlength=n)
        same2 = (sums[2:] == sums[:-2]) & (owner[2:] == owner[:-2])
        twin = np.bincount(owner[2:][same2], minlength=n)
    key = np.add.reduceat(_line_values(data, np.arange(len(data)) - starts[line]), starts)
    return _columns(shares, length, words, letters, again, twin), length, key


def long_line(data: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of one line with its end, ``step`` bytes at a time."""
    kind, counts = _kind_table(), np.zeros(len(KINDS) + 1, np.int64)
    words = letters = again = twin = 0
    key, was_blank, since = np.int64(0), True, 0
    open_sum: np.ndarray = np.empty(0, np.int64)
    last = np.empty(0, np.int64)

    def closed(sums: np.ndarray) -> tuple[int, int, np.ndarray]:
        """Words equal to the one before, and to the one before that, among the next closed words."""
        row = np.concatenate([last, sums])
        new = len(last)
        one, two = row[1:] == row[:-1], row[2:] == row[:-2]
        return int(one[max(new - 1, 0) :].sum()), int(two[max(new - 2, 0) :].sum()), row[-2:]

    with np.errstate(over="ignore"):
        for start in range(0, len(data), step):
            part = data[start : start + step]
            counts += np.bincount(kind[part], minlength=len(counts))
            key += _line_values(part, np.arange(start, start + len(part))).sum()
            blank = _is_blank(part)
            first = ~blank & np.concatenate([[was_blank], blank[:-1]])
            at = np.flatnonzero(first)
            words += len(at)
            letters += int((~blank).sum())
            place = np.arange(len(part))
            begun = np.maximum.accumulate(np.where(first, place, -1))
            values = _word_values(part, blank, np.where(begun >= 0, place - begun, place + since))
            head = at[0] if len(at) else len(part)
            if len(open_sum):
                open_sum = open_sum + values[:head].sum()
            if len(at):
                sums = np.add.reduceat(values, at)
                more, more2, last = closed(np.concatenate([open_sum, sums[:-1]]))
                again, twin, open_sum = again + more, twin + more2, sums[-1:]
                since = len(part) - at[-1]
            else:
                since += len(part)
            was_blank = bool(blank[-1])
        more, more2, _ = closed(open_sum)
    one = lambda v: np.array([v])
    return _columns(counts[None, :-1], one(len(data) - 1), one(words), one(letters), one(again + more), one(twin + more2)), one(len(data) - 1), one(key)


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of the texts: (lines, MEASURES) values, their lengths in bytes, and the lines of each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    counts = np.array([b.count(b"\n") + 1 for b in raw], np.int64)
    x, length, key = lines_of(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
    # Lines equal to another of their text.
    text_of = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((key, text_of))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (key[order[1:]] == key[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
    repeated = np.zeros(len(order), bool)
    repeated[order] = same[1:] | same[:-1]
    return np.column_stack([x, repeated & (length > 0)]), length, counts


class LongText:
    """A text in slices of whole lines, of at most ``step`` bytes unless a line is longer; lines are measured when they are asked for."""

    def __init__(self, text: str, step: int):
        self.raw, self.step = text.encode("utf-8", "replace") + b"\n", step
        self.data = np.frombuffer(self.raw, np.uint8)
        self.edges = [0]
        while self.edges[-1] < len(self.raw):
            at = self.edges[-1]
            last = self.raw.rfind(b"\n", at, at + step)
            self.edges.append((last if last >= 0 else self.raw.index(b"\n", at)) + 1)
        self.twice = self._repeated_keys()

    def _slice(self, k: int):
        part = self.data[self.edges[k] : self.edges[k + 1]]
        return lines_of(part) if len(part) <= self.step else long_line(part, self.step)

    def _repeated_keys(self) -> np.ndarray:
        """Keys of the lines, but empty ones, that there are more than once, sorted: 8 bytes a line at most."""
        keys = []
        for k in range(len(self.edges) - 1):
            _, length, key = self._slice(k)
            keys.append(key[length > 0])
        every = np.concatenate(keys)
        del keys
        every.sort()
        twice = every[1:][every[1:] == every[:-1]]
        return twice[np.concatenate([[True], twice[1:] != twice[:-1]])] if len(twice) else twice

    def measured(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The values and lengths of a slice's lines."""
        x, length, key = self._slice(k)
        at = np.minimum(np.searchsorted(self.twice, key), max(len(self.twice) - 1, 0))
        repeated = (self.twice[at] == key) & (length > 0) if len(self.twice) else np.zeros(len(key), bool)
        return np.column_stack([x, repeated]), length


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own measures, those of the line before and the line after (0 at the ends), flags for the ends, and 1."""
    n = len(x)
    first = np.zeros(n, bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
    last = np.concatenate([first[1:], [True]])
    before = np.vstack([np.zeros((1, x.shape[1])), x[:-1]])
    after = np.vstack([x[1:], np.zeros((1, x.shape[1]))])
    before[first] = 0
    after[last] = 0
    return np.column_stack([x, before, after, first, last, np.ones(n)])


def marginals(evidence: np.ndarray, counts: np.ndarray, links: np.ndarray, pairs: bool = False):
    """Probability of good for each line of each chain; with ``pairs`` also the summed table of neighbouring labels.

    evidence: score of good against bad for each line. links: 2 x 2 scores of neighbours.
    All chains are walked together, longest first, so that a step is one array operation.
    """
    order = np.argsort(-counts, kind="stable")
    start = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    half = np.clip(evidence, -60, 60) / 2
    emit = np.exp(np.stack([-half, half], axis=1) - np.abs(half)[:, None])
    move = np.exp(links - links.max())
    forward = np.empty_like(emit)
    now = emit[start] * 0.5
    for t in range(steps):
        k = alive[t]
        if t:
            now = (now[:k] @ move) * emit[start[:k] + t]
        now = now / now.sum(axis=1, keepdims=True)
        forward[start[:k] + t] = now
    good = np.empty(len(evidence))
    table = np.zeros((2, 2))
    back = np.ones((len(size), 2))
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        going = alive[t + 1] if t + 1 < steps else 0
        if going:
            ahead = emit[at[:going] + 1] * back[:going]
            if pairs:
                both = forward[at[:going], :, None] * move[None] * ahead[:, None, :]
                table += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            carried = ahead @ move.T
            back[:going] = carried / carried.sum(axis=1, keepdims=True)
        both = forward[at] * back[:k]
        good[at] = both[:, 1] / both.sum(axis=1)
    return (good, table) if pairs else good


def _products(steps: np.ndarray) -> np.ndarray:
    """All products steps[0] ... steps[t], each scaled to a sum of 1: along the rows of a square of all steps, then over its rows."""
    n = len(steps)
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    square = np.tile(np.eye(2) / 2, (rows * width, 1, 1))
    square[:n] = steps
    square = square.reshape(rows, width, 2, 2)
    out = np.empty_like(square)
    now = square[:, 0] / square[:, 0].sum(axis=(1, 2), keepdims=True)
    out[:, 0] = now
    for t in range(1, width):
        now = now @ square[:, t]
        now = now / now.sum(axis=(1, 2), keepdims=True)
        out[:, t] = now
    before, now = np.empty((rows, 2, 2)), np.eye(2)
    for r in range(rows):
        before[r] = now
        now = now @ out[r, -1]
        now = now / now.sum()
    out = (before[:, None] @ out).reshape(-1, 2, 2)[:n]
    return out / out.sum(axis=(1, 2), keepdims=True)


def _steps(evidence: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The matrix of each line: links into it times the scores of its labels."""
    half = np.clip(evidence, -60, 60) / 2
    emit = np.exp(np.stack([-half, half], axis=1) - np.abs(half)[:, None])
    return np.exp(links - links.max())[None] * emit[:, None, :]


def evidence_of(x: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``with_neighbours(x, counts) @ weights``, without the wide matrix."""
    own, before, after = (x @ weights[k * MEASURES : (k + 1) * MEASURES] for k in range(3))
    first = np.zeros(len(x), bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
    last = np.append(first[1:], True)
    out = own + weights[-1] + first * weights[-3] + last * weights[-2]
    out[1:] += np.where(first[1:], 0, before[:-1])
    out[:-1] += np.where(last[:-1], 0, after[1:])
    return out


def aggregate(good: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean probability of good of each text, weighted by the lengths of its lines."""
    weight = length + 1.0
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class QualityModel:
    """Weights of the evidence, the table of links, and the slope and shift of the final curve."""

    def __init__(self, weights, links, curve=(1.0, 0.0)):
        self.weights, self.links, self.curve = weights, links, curve

    def documents(self, texts: list[str]) -> np.ndarray:
        """Uncalibrated quality of each text."""
        out, piece, size = [], [], 0
        for text in texts:
            alone = len(text) > PIECE_BYTES
            if piece and (alone or size + len(text) > PIECE_BYTES):
                out.append(self._piece(piece))
                piece, size = [], 0
            if alone:
                out.append(np.array([self._long(LongText(text, PIECE_BYTES))]))
            else:
                piece.append(text)
                size += len(text)
        if piece:
            out.append(self._piece(piece))
        return np.concatenate(out) if out else np.empty(0)

    def _piece(self, texts):
        x, length, counts = measure(texts)
        return aggregate(marginals(evidence_of(x, counts, self.weights), counts, self.links), length, counts)

    def _long(self, text: LongText) -> float:
        """The quality of a text by slices: what neighbouring slices see of each other, messages forward, then backward with the sums."""
        n, m = len(text.edges) - 1, MEASURES
        ends = np.zeros((n, 2))
        for k in range(n):
            x, _ = text.measured(k)
            ends[k] = x[0] @ self.weights[2 * m : 3 * m], x[-1] @ self.weights[m : 2 * m]

        def evidence(k: int) -> tuple[np.ndarray, np.ndarray]:
            x, length = text.measured(k)
            own, before, after = (x @ self.weights[j * m : (j + 1) * m] for j in range(3))
            out = own + self.weights[-1]
            out[1:] += before[:-1]
            out[:-1] += after[1:]
            out[0] += ends[k - 1, 1] if k else self.weights[-3]
            out[-1] += ends[k + 1, 0] if k + 1 < n else self.weights[-2]
            return out, length

        into = [np.full(2, 0.5)]
        for k in range(n):
            steps = _steps(evidence(k)[0], self.links)
            if k == 0:
                steps[0] = np.diag(steps[0][0] / np.exp(self.links - self.links.max())[0])
            after = into[-1] @ _products(steps)[-1]
            into.append(after / after.sum())
        total, weight, back = 0.0, 0.0, np.full(2, 0.5)
        for k in range(n - 1, -1, -1):
            score, length = evidence(k)
            steps = _steps(score, self.links)
            if k == 0:
                steps[0] = np.diag(steps[0][0] / np.exp(self.links - self.links.max())[0])
            forward = into[k] @ _products(steps)
            # From the end: what follows each line, and what the slice hands to the one before it.
            behind = _products(np.swapaxes(steps, 1, 2)[::-1])
            following = np.vstack([back, back @ behind[:-1]])[::-1]
            both = forward * following / following.sum(axis=1, keepdims=True)
            good = both[:, 1] / both.sum(axis=1)
            total += float(good @ (length + 1.0))
            weight += float((length + 1.0).sum())
            back = back @ behind[-1]
            back = back / back.sum()
        return total / weight

    def scores(self, texts: list[str]) -> np.ndarray:
        slope, shift = self.curve
        return 1 / (1 + np.exp(-(slope * _logit(self.documents(texts)) + shift)))


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> QualityModel:
    """The chain by Adam over small batches; the curve on documents that the chain of another half was not fitted on."""
    width = 3 * MEASURES + 3
    if not len(texts) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(np.zeros(width), np.zeros((2, 2)), (0.0, float(np.log(share / (1 - share)))))
    half = np.arange(len(texts)) % 2
    unseen = np.zeros(len(texts))
    for k in (0, 1):
        model = _fit_chain([t for t, h in zip(texts, half, strict=True) if h != k], labels[half != k], epochs)
        unseen[half == k] = model.documents([t for t, h in zip(texts, half, strict=True) if h == k])
    model = _fit_chain(texts, labels, epochs)
    model.curve = calibrate(_logit(unseen), labels)
    return model


def _fit_chain(texts: list[str], labels: np.ndarray, epochs: int) -> QualityModel:
    x, _, counts = measure(texts)
    x = with_neighbours(x, counts)
    starts = np.cumsum(counts) - counts
    width = x.shape[1]
    scale = np.maximum(x.std(axis=0), 1e-2)
    x = x / scale
    theta, m, v, step = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4), 0
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(len(texts))
        for at in range(0, len(order), BATCH_DOCS):
            chosen = order[at : at + BATCH_DOCS]
            rows = np.concatenate([np.arange(starts[d], starts[d] + counts[d]) for d in chosen])
            xb, cb = x[rows], counts[chosen]
            y = np.repeat(labels[chosen], cb)
            good, table = marginals(xb @ theta[:width], cb, theta[width:].reshape(2, 2), pairs=True)
            seen = np.diag([((cb - 1) * (labels[chosen] == 0)).sum(), ((cb - 1) * (labels[chosen] == 1)).sum()]).astype(float)
            grad = np.concatenate([xb.T @ (y - good), (seen - table).ravel()]) / len(chosen) - L2 * theta
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return QualityModel(theta[:width] / scale, theta[width:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> QualityModel:
    sample = labelled_sample(docs, labels, label_col, learn, max_labelled, id_col, text_col)

    def run(batches):
        pdf = pd.concat(list(batches) or [pd.DataFrame({"id": [], "label": [], "text": []})]).sort_values(["id", "text"])
        model = fit(list(pdf["text"]), pdf["label"].to_numpy(float))
        yield pd.DataFrame({"weights": [model.weights.tolist()], "links": [model.links.ravel().tolist()], "curve": [list(map(float, model.curve))]})

    rows = sample.repartition(1).mapInPandas(run, "weights array<double>, links array<double>, curve array<double>").collect()
    if not rows:
        return fit([], np.empty(0))
    return QualityModel(np.array(rows[0]["weights"]), np.array(rows[0]["links"]).reshape(2, 2), tuple(rows[0]["curve"]))


def quality(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per document: id, score (0..1, higher: likelier good) and predicted (score >= threshold).

    A null text counts as empty, and an empty text is one empty line, which is scored
    like any other. Repeated rows and equal texts get equal scores, and a score equal to
    the threshold is predicted 1. Texts of any length are scored whole; beyond its own
    bytes, a few times over, a long text takes 8 bytes for each line that isn't empty, and what a slice
    takes. An empty table gives no rows; without labels of both kinds every
    score is the share of good labels. Columns other than the id and the text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learn, label_col, id_col, text_col, max_labelled))

    def apply(batches):
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf["_id"], "score": shared.value.scores(list(pdf["_text"]))})

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    scored = map_rows(scored, apply, f"`{id_col}` {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
