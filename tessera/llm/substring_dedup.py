"""Operator 7: substring deduplication by sliding spans of sentences, and of words.

A text is cut into sentences at stops and line ends, and sentences of more than
``MAX_WORDS`` words into pieces of that many. From every sentence on, the shortest run of
at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words is hashed, and so is the
shortest such run that ends with it, on lower-case words. Runs are joined over the whole
corpus by a hash of 96 bits; every occurrence but the first (least id, then place) is removed.

A passage that begins or ends inside sentences may hold no such run. So windows of
``WINDOW`` words are spans too, wherever they begin: those whose hash is the least of any
``AMONG`` windows in a row. Which ones those are inside a passage depends on the passage
alone, so one of ``WINDOW + AMONG - 1`` words (51) or more is always found. The windows
that are found follow one another without a gap; words of it that may stay are fewer than
``AMONG`` at either end.

Shape at scale: a span is 32 bytes, and each is made and shuffled once, to the other spans of
its hash, where all but the first are kept. Hashes that are frequent in a sample of documents
are dealt over ``SALTS`` groups each, whose firsts then meet once more; the sample decides
where rows go and not what is found. What is gathered per document is bounded by its own
length. The texts are shuffled once, to what they lose. The plan is the same at every size.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, map_rows, whole_text

MIN_SENTENCES, MIN_WORDS, MAX_WORDS = 3, 20, 20
#: Words of a window, and of how many windows in a row the least is taken; AMONG < WINDOW.
WINDOW, AMONG = 32, 20
#: Words whose hashes a worker keeps.
KNOWN_WORDS = 500_000
#: Odd factors of the hashes of windows, with their inverses modulo 2^64.
_FACTORS = [(b, pow(b, -1, 2**64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
#: Documents that are asked for frequent hashes, about; how often a hash is among them to be dealt out; the groups it is dealt to.
ASKED, FREQUENT, SALTS = 2_000, 4, 64
#: Spans that a worker hands over at a time.
ROWS_OUT = 200_000
_END = re.compile(r"[.!?]+\s+|\s*\n\s*")
_WORD = re.compile(r"\S+")
SPAN = "id bigint, text_hash int, h1 bigint, h2 int, start int, stop int"


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, stop, lower-case words) of each sentence or piece that has words; together they cover the text from its first word on."""
    out, at = [], 0
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        words = text[at:end].split()
        if len(words) <= MAX_WORDS:
            if words:
                out.append((at, end, [w.lower() for w in words]))
        else:
            spots = [m.start() + at for m in _WORD.finditer(text[at:end])]
            for k in range(0, len(words), MAX_WORDS):
                stop = spots[k + MAX_WORDS] if k + MAX_WORDS < len(spots) else end
                out.append((at if k == 0 else spots[k], stop, [w.lower() for w in words[k : k + MAX_WORDS]]))
        at = end
    return out


def runs(word_counts: list[int]) -> list[tuple[int, int]]:
    """First and last sentence of every shortest run that is long enough, seen from its start and from its end."""
    upto = np.concatenate([[0], np.cumsum(word_counts)])
    n = len(word_counts)
    if n < MIN_SENTENCES:
        return []
    starts = np.arange(n)
    last = np.maximum(np.searchsorted(upto, upto[:-1] + MIN_WORDS, side="left") - 1, starts + MIN_SENTENCES - 1)
    forward = {(int(a), int(b)) for a, b in zip(starts, last, strict=True) if b < n}
    first = np.minimum(np.searchsorted(upto, upto[1:] - MIN_WORDS, side="right") - 1, starts - MIN_SENTENCES + 1)
    return sorted(forward | {(int(a), int(b)) for a, b in zip(first, starts, strict=True) if a >= 0})


def _over(values: np.ndarray, best) -> np.ndarray:
    """``best`` of every AMONG values in a row."""
    size = 1
    while 2 * size <= AMONG:
        values, size = best(values[:-size], values[size:]), 2 * size
    return best(values[: len(values) - (AMONG - size)], values[AMONG - size :]) if size < AMONG else values


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def windows(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts, each as (words, 2) hashes: text, first word and both hashes of the windows that are spans.

    Hashes are sums of the words' hashes times powers of a factor, rolled over the texts laid
    end to end. A row of windows that leaves its text is not looked at.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum()) - WINDOW + 1
    if n < AMONG:
        return (*[np.empty(0, np.int64)] * 2, *[np.empty(0, np.uint64)] * 2)
    laid = np.concatenate(words)
    hashes = []
    for side, (factor, inverse) in enumerate(_FACTORS):
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(laid[:, side] * _powers(factor, len(laid)), dtype=np.uint64)])
        h = (upto[WINDOW:] - upto[:-WINDOW]) * _powers(inverse, n)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        hashes.append(h ^ (h >> np.uint64(32)))
    ends, doc = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)[:n]
    least = _over(hashes[0], np.minimum)
    whole = np.arange(len(least)) + WINDOW + AMONG - 1 <= ends[doc[: len(least)]]
    around = np.zeros(AMONG - 1, np.uint64)
    most = _over(np.concatenate([around, np.where(whole, least, 0), around]), np.maximum)
    at = np.flatnonzero((most == hashes[0]) & (most > 0))
    return doc[at], at - (ends - sizes)[doc[at]], hashes[0][at], hashes[1][at]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, h1, h2, start, stop) of every run and window of every document; places in code points.

    text_hash (32 bits) only has to tell texts apart whose ids are equal.
    """

    def apply(batches):
        import xxhash

        class Known(dict):
            def __missing__(self, word):
                self[word] = made = xxhash.xxh3_128_digest(word)
                return made

        known = Known()

        def windowed(pdf, texts, places, words):
            doc, first, h1, h2 = windows(words)
            start = [places[d][k] for d, k in zip(doc.tolist(), first.tolist(), strict=True)]
            stop = [places[d][k + WINDOW] for d, k in zip(doc.tolist(), first.tolist(), strict=True)]
            at = np.array(texts, np.int64)[doc]
            return pd.DataFrame({"id": pdf["id"].to_numpy()[at], "text_hash": pdf["text_hash"].to_numpy()[at], "h1": h1.view(np.int64), "h2": h2.astype(np.uint32).view(np.int32), "start": start, "stop": stop})

        for pdf in batches:
            texts, places, words, held = [], [], [], 0
            keep = {k: [] for k in ("doc", "start", "stop")}
            hashes = []

            def out():
                at = np.array(keep["doc"], np.int64)
                words = np.frombuffer(b"".join(hashes), "<i4").reshape(-1, 4)
                return pd.DataFrame({"id": pdf["id"].to_numpy()[at], "text_hash": pdf["text_hash"].to_numpy()[at], "h1": words[:, :2].copy().view("<i8").ravel(), "h2": words[:, 2], "start": keep["start"], "stop": keep["stop"]})

            for i, text in enumerate(pdf["text"]):
                cut = sentences(text)
                own = [xxhash.xxh3_128_digest(" ".join(w)) for _, _, w in cut]
                for a, b in runs([len(w) for _, _, w in cut]):
                    keep["doc"].append(i)
                    keep["start"].append(cut[a][0])
                    keep["stop"].append(cut[b][1])
                    hashes.append(xxhash.xxh3_128_digest(b"".join(own[a : b + 1])))
                if len(hashes) >= ROWS_OUT:
                    yield out()
                    keep, hashes = {k: [] for k in keep}, []
                n = sum(len(w) for _, _, w in cut)
                if n >= WINDOW + AMONG - 1:
                    texts.append(i)
                    places.append([*(m.start() for m in _WORD.finditer(text)), len(text)])
                    words.append(np.frombuffer(b"".join([known[w] for _, _, ws in cut for w in ws]), "<u8").reshape(-1, 2))
                    held += n
                if held >= ROWS_OUT:
                    yield windowed(pdf, texts, places, words)
                    texts, places, words, held = [], [], [], 0
                    if len(known) > KNOWN_WORDS:
                        known.clear()
            if hashes:
                yield out()
            if held:
                yield windowed(pdf, texts, places, words)

    return map_rows(_rows(docs, id_col, text_col).select("id", "text_hash", F.col("_text").alias("text")), apply, SPAN)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_ = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)).cast("bigint"))
    return docs.select(F.col(id_col).alias("_id"), id_.alias("id"), F.hash(whole_text(text_col)).alias("text_hash"), whole_text(text_col).alias("_text"))


def frequent_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2) of the spans that are frequent among about ASKED documents; at most some ten thousand."""
    asked = docs.sample(min(1.0, ASKED / max(1, docs.count())), seed=11)
    counted = spans(asked, id_col, text_col).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return durable(counted.where(F.col("n") >= FREQUENT).select("h1", "h2"))


def later_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, start, stop) of every span that is not the first of its hash, by id, text and place."""
    frequent = F.broadcast(frequent_hashes(docs, id_col, text_col).withColumn("dealt", F.lit(True)))
    every = spans(docs, id_col, text_col).join(frequent, ["h1", "h2"], "left")
    salt = F.when(F.col("dealt"), F.pmod(F.xxhash64("id", "text_hash"), F.lit(SALTS)) + 1).otherwise(0).cast("int")
    every = every.select("h1", "h2", salt.alias("salt"), "id", "text_hash", "start", "stop")
    # Rank, as equal rows have equal places and are one document. Both uses read the same shuffle: a filter
    # that Spark could push below the window would make it two.
    order = F.rank().over(Window.partitionBy("h1", "h2", "salt").orderBy("id", "text_hash", "start"))
    ranked = every.withColumn("place", order)
    found = ranked.where("place > 1").select("id", "text_hash", "start", "stop")
    leads = F.greatest(F.col("place"), F.when(F.col("salt") == 0, 2).otherwise(1)) == 1
    first = F.rank().over(Window.partitionBy("h1", "h2").orderBy("id", "text_hash", "start"))
    leading = ranked.where(leads).select("h1", "h2", "id", "text_hash", "start", "stop").distinct().withColumn("place", first)
    return found.unionByName(leading.where("place > 1").select("id", "text_hash", "start", "stop"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, removed): the merged (start, stop) of each document that are not the first of their kind."""
    document = ["id", "text_hash"]
    inside = Window.partitionBy(*document).orderBy("start", "stop")
    reach = F.max("stop").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opened = later_spans(docs, id_col, text_col).withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = opened.withColumn("piece", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*document, "piece").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy(*document).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, removed, removed_chars and kept_text.

    What any later occurrence of a span covers is cut out. Rows of equal id and text are one
    document for this purpose and all get the same result. Null and empty texts, and texts
    of fewer than MIN_WORDS words, or of fewer than MIN_SENTENCES sentences and
    WINDOW + AMONG - 1 words, lose nothing and keep their whole text, as do texts without repeats.
    A null id counts as the least. An empty table gives no rows. Other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col).join(repeated_spans(docs, id_col, text_col), ["id", "text_hash"], "left")
    removed = F.coalesce("removed", F.array().cast("array<struct<start:int,stop:int>>"))
    length = F.length("_text")
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))), F.col("removed"))
    nexts = F.concat(F.transform("removed", lambda r: r["start"]), F.array(length))
    pieces = F.zip_with(edges, nexts, lambda e, n: F.substring(F.col("_text"), e["stop"] + 1, n - e["stop"]))
    return rows.withColumn("removed", removed).select(
        F.col("_id").alias(id_col),
        length.cast("bigint").alias("n_chars"),
        "removed",
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, r: s + r["stop"] - r["start"]).alias("removed_chars"),
        F.when(F.size("removed") > 0, F.array_join(pieces, "")).otherwise(F.col("_text")).alias("kept_text"),
    )
