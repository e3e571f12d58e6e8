"""Ranked search and whitening against brute force, with ties, nulls, long texts, repeated rows and empty tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import lexical_search, whitening
from tessera.llm.lexical_search import Lists, Shard, max_score, norms_of, ranked_search, terms
from tessera.llm.whitening import whiten

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute_force(docs, items, top):
    """Rows of (item row, item id, rank, doc id, score)."""
    bags = [Counter(cut(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    out = []
    for row, (item, text) in enumerate(items):
        scored = []
        for (doc, _), bag, size in zip(docs, bags, sizes, strict=True):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * (25 + 75 * size * n // total))) for t in cut(text) if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(scored)[:top])]
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé9 _-\u0085 \n\x7f漢\U0001f600"), max_size=40))
def test_terms_are_those_of_the_pattern(text):
    assert terms(text.encode()) == Counter(w.encode() for w in cut(text))


def test_terms_of_long_texts_are_cut_in_pieces(monkeypatch):
    text = "Word " * 500 + "x" * 300 + " é漢" * 200 + "tail"
    whole = terms(text.encode())
    monkeypatch.setattr(lexical_search, "PIECE_BYTES", 7)
    assert terms(text.encode()) == whole and whole[b"word"] == 500 and sum(len(t) == 33 for t in whole) == 1


def random_docs(rng, n, words=60):
    letters = [f"w{k}" for k in range(words)]
    odds = 1 / np.arange(1, words + 1)
    return [(int(rng.integers(0, n)), " ".join(rng.choice(letters, rng.integers(1, 30), p=odds / odds.sum()))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_max_score_is_exact_and_skips(seed, monkeypatch):
    """One shard: the places equal those of a full evaluation, and fewer postings are read than there are."""
    monkeypatch.setattr(lexical_search, "FIRST_WINDOW", 8)
    rng = np.random.default_rng(seed)
    docs = random_docs(rng, 900)
    shard = Shard(0)
    for doc, text in docs:
        shard.add(doc, terms(text.encode()))
    rows = shard.rows().to_pylist()
    lengths = np.frombuffer(rows[0]["counts"], "<i8")
    norm = lambda v: norms_of(v, len(docs), int(lengths.sum()))
    names = [r["term"] for r in rows[1:]]
    lists = Lists(names, *([r[c] for r in rows[1:]] for c in ("docs", "counts", "least")), norm(lengths), norm)
    read = []
    added = lists.added
    lists.added = lambda t, at: read.append(len(lists.docs[t][at])) or added(t, at)
    ids, nulls = np.array([d for d, _ in docs]), np.zeros(len(docs), np.uint8)
    item = "w0 w0 w1 w40 w55 w3"
    df = {t: len(lists.docs[t]) for t in names}
    asked = [(t, c * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1)))) for t, c in terms(item.encode()).items() if t in df]
    found, scores = max_score(lists, asked, ids, nulls, 7)
    assert [(int(ids[d]), int(s)) for d, s in zip(found, scores, strict=True)] == [r[2:] for r in brute_force(docs, [(0, item)], 7)]
    assert sum(read) < 0.8 * sum(df[t] for t, _ in asked)


DOCS = [(3, "Alpha beta beta"), (1, "alpha BETA beta"), (1, "alpha beta beta"), (None, "alpha beta beta"), (2, None), (4, ""), (5, " ,.; "), (6, "gamma " * 3000), (2**60, "Ärger alpha ärger"), (7, "delta"), (8, "beta gamma delta alpha")]
ITEMS = [(10, "alpha beta"), (10, "beta beta beta"), (None, "ÄRGER ärger Ärger"), (11, None), (12, ""), (13, "nowhere"), (14, "gamma delta nowhere")]


@pytest.mark.parametrize(("shard_docs", "block_bytes"), [(16_384, 10**6), (2, 400)])
def test_search_equals_brute_force(spark, monkeypatch, shard_docs, block_bytes):
    """Ties, nulls, repeated ids of documents and items, items in several blocks."""
    clash = [(d, t, "x", 1, 2, 3) for d, t in DOCS]
    docs = spark.createDataFrame(clash, "doc_id long, text string, term string, shard long, rank int, score long").repartition(3)
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, term string, times long").coalesce(1)
    got = ranked_search(docs, items, 3, block_bytes=block_bytes).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got)) == sorted(map(key, brute_force(DOCS, ITEMS, 3)))
    assert ranked_search(docs.limit(0), items).count() == 0 and ranked_search(docs, items.limit(0)).count() == 0


def whitened_by_numpy(vectors, top=16):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - sums / n).astype(float)
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    z = (x - sums / n).astype(float) @ parts[:, :top] / np.sqrt(values[:top])
    return z, ((n * x - sums) ** 2).sum(axis=1), values[:top] / values.sum(), n


VECTORS = "vec_id long, embedding array<float>, x string, component string, rows long"


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(4)
    usable = [(int(i), (rng.normal(size=20) * np.arange(1, 21)).astype(np.float32).tolist()) for i in range(300)]
    usable += [(1000 + k, usable[7][1]) for k in range(400)] + [(None, usable[8][1]), (5, usable[9][1])]
    unfit = [(2000, None), (2001, []), (2002, [None] + [1.0] * 19), (2003, [float("nan")] * 20), (2004, [float("inf")] + [0.0] * 19), (2005, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "a", "b", 1) for i, v in usable + unfit], VECTORS).repartition(5)
    got = whiten(frame).toPandas()
    assert len(got) == 16 * len(usable) and got.identity_error.max() <= 1e-9
    z, deviation, explained, n = whitened_by_numpy([v for _, v in usable])
    assert set(got.n) == {n} == {300}
    first = got[(got.vec_id < 300) & (got.vec_id != 5)].pivot(index="vec_id", columns="component", values="whitened")
    own = z[[i for i in range(300) if i != 5]]
    signs = np.sign((first.to_numpy() * own).sum(axis=0))
    assert np.abs(first.to_numpy() * signs - own).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)
    devs = got.drop_duplicates("vec_id").set_index("vec_id").deviation
    assert all(devs[i] == deviation[i] for i in range(300) if i != 5)
    assert (got.vec_id.isna().sum(), (got.vec_id == 5).sum()) == (16, 32)


def test_whitening_without_variance_and_with_huge_entries(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows], VECTORS)
    assert whiten(frame([])).count() == 0 and whiten(frame([(1, None)])).count() == 0
    assert whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 5.0])])).toPandas()
    assert set(flat.component) == {1} and np.allclose(flat.explained, 1)
    huge = whiten(frame([(1, [1e38, 2.0]), (2, [-1e38, 3.0]), (3, [0.0, 5.0])])).toPandas()
    assert huge.identity_error.max() < 1e-4 and huge.deviation.isna().sum() == 2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**52), 2**52), min_size=3, max_size=3), min_size=1, max_size=20))
def test_sums_and_deviations_are_exact(rows):
    x = np.array(rows, np.int64)
    sums = whitening.exact_sums(x)
    assert list(sums[1:]) == [sum(r[k] for r in rows) for k in range(3)]
    centre = whitening.Centre(len(rows), list(sums[1:]))
    want = [sum((len(rows) * v - s) ** 2 for v, s in zip(r, sums[1:], strict=True)) for r in rows]
    assert centre.deviation(x) == [w if w < 2**63 else None for w in want]
    assert np.allclose(centre.centred(x), x - x.mean(axis=0), rtol=1e-9, atol=4)
