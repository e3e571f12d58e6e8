"""Removal of repeated byte strings against brute force, with splits of anchors, long and periodic texts, ties and nulls."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import registry, suffix_dedup
from tessera.llm.suffix_dedup import build_collection, repeats_inside, without_repeated_strings


def brute_force(texts, length):
    """The removed spans of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out


def digests(texts, removed):
    rows = []
    for t, spans in zip(texts, removed, strict=True):
        d, at, kept = (t or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + d[at:a], b
        rows.append((len(d), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + d[at:]).hexdigest()))
    return rows


@pytest.mark.parametrize("chunk", [7, 50, 1 << 20])
def test_collections_find_all_repeats(chunk, monkeypatch):
    """Suffixes with common prefixes, in files that are read in many chunks or in one."""
    monkeypatch.setattr(suffix_dedup, "FILE_CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(60):
        base = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(3)]
        texts = [rng.choice(base)[rng.randrange(12) :][: 12 + rng.randrange(16)] for _ in range(rng.randrange(1, 12))]
        texts = [bytes(c if rng.random() > 0.03 else 99 for c in t) for t in texts]
        n_first = np.array([len(t) - 11 for t in texts])
        seen = Counter(t[i : i + 12] for t, n in zip(texts, n_first, strict=True) for i in range(n))
        got = repeats_inside(texts, n_first, 12, 4)
        want = [i < n and seen[t[i : i + 12]] > 1 for t, n in zip(texts, n_first, strict=True) for i in range(len(t))]
        assert got.tolist() == want


def test_files_hold_the_transform(tmp_path):
    """Symbols before the sorted suffixes, and their common prefixes, of two words."""
    symbols = np.array([1, 0, 2, 0, 2, 0, 1, 0, 2, 0], np.int32)
    files = build_collection(symbols, np.array([0, 6]), np.array([6, 4]), 1, str(tmp_path), 100)
    suffixes = sorted([(tuple(symbols[i:6]), i) for i in range(6)] + [(tuple(symbols[i:10]), i) for i in range(6, 10)])
    rows = [c for _, *c in files.chunks("bwt", "lcp", "place")]
    bwt, lcp, place = (np.concatenate(c) for c in zip(*rows, strict=True))
    assert [symbols[p:6].tolist() if p < 6 else symbols[p:].tolist() for p in place[2:]] == [list(s) for s, _ in suffixes]
    assert [b for b, p in zip(bwt[2:], place[2:], strict=True)] == [symbols[p - 1] if p not in (0, 6) else -1 for p in place[2:]]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert lcp[3:].tolist() == [common(a, b) for (a, _), (b, _) in zip(suffixes, suffixes[1:], strict=False)]


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts, passage, common = [], prose(60), prose(30)
    for _ in range(5):
        base = prose(120)
        for _ in range(6):
            words = base.split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    texts += [prose(rng.randrange(30)) + passage[rng.randrange(9) :] + prose(20) for _ in range(12)]
    texts += [prose(12) + " " + common + " " + prose(12) for _ in range(40)]
    texts += ["same text" * 30] * 3 + ["", None, "short", "short", "a" * 900, "xyz " * 300, passage + passage, prose(700)]
    return texts


@pytest.mark.parametrize(("anchor_pieces", "buffer"), [(4096, 10**6), (3, 1500)])
def test_equals_brute_force(spark, monkeypatch, anchor_pieces, buffer):
    """Small bounds force the splits of anchors, small collections, and texts in stretches."""
    monkeypatch.setattr(suffix_dedup, "BUFFER", buffer)
    texts = corpus()
    frame = [(i if i % 9 else None, t, "x", 7, 7, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(frame, "doc_id long, text string, anchor string, piece long, first int, removed string").repartition(3)
    made = without_repeated_strings(docs, length=80, gram=16, block=20, anchor_pieces=anchor_pieces, collection_pieces=20 if anchor_pieces < 9 else 4096)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], sum(s["stop"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in made.collect())
    want = sorted((i if i and i % 9 else -1, *d) for i, d in enumerate(digests(texts, brute_force(texts, 80))))
    assert got == want and sum(w[2] for w in want) > 10_000
    assert without_repeated_strings(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = [r["text"] for r in rows]
    want = sorted((r["doc_id"], *d) for r, d in zip(rows, digests(texts, brute_force(texts, 400)), strict=True))
    got = registry.op11_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want and any(w[3] for w in want)


def test_long_periodic_texts_and_hot_copies(spark):
    """Two megabytes of one letter, a period longer than a gram, and equal rows that are a third of all."""
    long, wave = "a" * 2_000_000, "0123456789abcdefghijklmnopqrstuvwxyz-the-quick-brown-fox-jumps-over-the-lazy-dog;" * 3000
    docs = spark.createDataFrame([(1, long), (2, wave), (3, "tail " + wave[:1000])], "doc_id long, text string")
    docs = docs.unionByName(spark.range(300).select(F.lit(9).cast("long").alias("doc_id"), F.lit("copy " * 100).alias("text")))
    got = without_repeated_strings(docs).groupBy("doc_id", "n_bytes", F.length("kept_bytes").alias("kept")).count().collect()
    assert sorted(map(tuple, got)) == [(1, 2_000_000, 0, 1), (2, len(wave), 0, 1), (3, 1005, 5, 1), (9, 500, 0, 300)]
