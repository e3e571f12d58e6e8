"""Operator 12: ranked lexical search by MaxScore over the shards of an inverted index.

The index is made in one pass over the documents: a shard holds the postings of some thousand
of them, a row for each term with the places of its documents, its counts there, and, for each
count, the shortest document that has it. From those pairs the most that any of the term's
documents can score follows for any corpus statistics, so the bounds are exact although a
shard is written before the statistics are known.

A search joins the terms of its items with the index and meets each shard once. Turtle and
Flood's MaxScore (1995) then goes through the shard's documents window by window: lists, sorted
by their bounds, are essential once the bounds so far reach the score of the last place; only
the essential ones are read in full, and the others are probed, the largest bound first, for the
documents that can still qualify. Windows grow, so the last place's score rises early.

Shape at scale: texts never move. What is written is one row per shard and term, what moves are
the lists of the terms asked for, by shard, and then some rows per shard and item, which are cut
to the places asked for before and after they are shuffled. Items are broadcast in blocks whose
bytes are bounded.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, whole_text, written

#: Documents and postings that a shard holds, about; a document is never split.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 4_000_000
#: Bytes of a text that are cut into terms at a time.
PIECE_BYTES = 4_000_000
#: Longer terms are known by their SHA-256.
LONGEST_TERM = 64
#: Bytes of terms that are broadcast with a block of items, about.
BLOCK_BYTES = 16_000_000
#: Documents of the first window; each is twice the one before.
FIRST_WINDOW = 512
#: Letters in lower case and digits stay, as does all beyond ASCII; anything else ends a term.
_TO_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "shard bigint, term binary, n_docs int, docs binary, counts binary, least binary"
#: K of the score's formula, B in percent, and the factor that makes its parts whole numbers.
SATURATION, NORMED, SCALE = 8, 75, 1_000_000_000


def terms(text: bytes) -> Counter:
    """The terms of a whole text and how often it has them, cut piece by piece."""
    import hashlib

    found: Counter = Counter()
    at = 0
    while at < len(text):
        stop = at + PIECE_BYTES
        if stop < len(text):
            # A piece ends where a term does.
            tail = text[stop : stop + PIECE_BYTES].translate(_TO_TERMS)
            cut = tail.find(b" ")
            while cut < 0 and stop < len(text):
                stop += len(tail)
                tail = text[stop : stop + PIECE_BYTES].translate(_TO_TERMS)
                cut = tail.find(b" ")
            stop += max(cut, 0)
        found.update(text[at:stop].translate(_TO_TERMS).split())
        at = stop
    for term in [t for t in found if len(t) > LONGEST_TERM]:
        found[b" " + hashlib.sha256(term).digest()] += found.pop(term)
    return found


class Shard:
    """Postings in the making."""

    def __init__(self, number: int):
        self.number, self.ids, self.lengths, self.held = number, [], [], []
        self.known: defaultdict = defaultdict()
        self.known.default_factory = self.known.__len__
        self.term_nos: list[int] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, found: Counter) -> None:
        self.ids.append(doc_id)
        self.lengths.append(sum(found.values()))
        self.term_nos.extend(map(self.known.__getitem__, found))
        self.counts.extend(found.values())
        self.held.append(len(found))

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.counts) >= SHARD_POSTINGS

    def rows(self) -> pa.RecordBatch:
        """A row per term, after one that holds the ids and lengths of the documents and has no term."""
        term, count = np.array(self.term_nos, np.int64), np.array(self.counts, np.int64)
        doc, length = np.repeat(np.arange(len(self.ids)), self.held), np.array(self.lengths, np.int64)
        order = np.argsort(term, kind="stable")
        term, count, doc = term[order], count[order], doc[order]
        n_docs = np.bincount(term, minlength=len(self.known))
        lists = np.concatenate([[0], np.cumsum(n_docs)])
        # The shortest document of each count of each term.
        by_count = np.lexsort((count, term))
        pair = np.stack([term[by_count], count[by_count]])
        first = np.flatnonzero(np.concatenate([[True], (pair[:, 1:] != pair[:, :-1]).any(axis=0)])) if len(term) else np.empty(0, np.int64)
        shortest = np.minimum.reduceat(length[doc[by_count]], first) if len(first) else np.empty(0, np.int64)
        least = np.stack([pair[1, first], shortest], axis=1).astype("<i8") if len(first) else np.empty((0, 2), "<i8")
        pairs = np.concatenate([[0], np.cumsum(np.bincount(pair[0, first], minlength=len(self.known)))])
        ids = pa.array(self.ids, pa.int64())
        nulls = np.asarray(ids.is_null())
        head = pa.record_batch(
            [pa.array([self.number], pa.int64()), pa.array([None], pa.binary()), pa.array([len(self.ids)], pa.int32()), pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([length.astype("<i8").tobytes()], pa.binary()), pa.array([nulls.astype("u1").tobytes()], pa.binary())],
            _NAMES,
        )
        body = pa.record_batch(
            [pa.array(np.full(len(self.known), self.number)), pa.array(list(self.known), pa.binary()), pa.array(n_docs.astype(np.int32)), _binaries(doc.astype("<u4"), lists, 4), _binaries(count.astype("<u4"), lists, 4), _binaries(least, pairs, 16)],
            _NAMES,
        )
        return pa.Table.from_batches([head, body]).combine_chunks().to_batches()[0]


_NAMES = ["shard", "term", "n_docs", "docs", "counts", "least"]


def _binaries(values: np.ndarray, edges: np.ndarray, width: int) -> pa.Array:
    """A binary value for each stretch between the edges, without a copy of each."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype("<i4").tobytes()), pa.py_buffer(values.tobytes())])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of all documents: (shard, term, n_docs, docs, counts, least).

    A shard's row without a term holds the ids of its documents in ``docs``, their lengths in
    ``counts`` and in ``least`` which ids are null. Every document is in one shard, those
    without terms too.
    """

    def build(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        shard = Shard(number)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(doc_id.as_py(), terms(text.as_py()))
                if shard.full():
                    yield shard.rows()
                    number += 1
                    shard = Shard(number)
        if shard.ids:
            yield shard.rows()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), whole_text(text_col).cast("binary").alias("text")).mapInArrow(build, INDEX)


def _statistics(index: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all terms with repeats."""

    def add_up(batches):
        for batch in batches:
            lengths = [np.frombuffer(b.as_py(), "<i8") for b in batch.column(0)]
            yield pa.record_batch([pa.array([int((v > 0).sum()) for v in lengths], pa.int64()), pa.array([int(v.sum()) for v in lengths], pa.int64())], ["with_terms", "all_terms"])

    summed = index.where("term is null").select("counts").mapInArrow(add_up, "with_terms bigint, all_terms bigint").agg(F.sum("with_terms"), F.sum("all_terms")).first()
    return summed[0] or 0, summed[1] or 0


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_no, item_id, term, times) of each term of each item; item_no tells rows apart whose ids are equal."""

    def cut(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                found = terms(batch.column(2)[row].as_py())
                spread = pa.array([row] * len(found), pa.int64())
                yield pa.record_batch([batch.column(0).take(spread), batch.column(1).take(spread), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["item_no", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("item_no"), F.col(item_col).cast("bigint").alias("item_id"), whole_text(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(cut, "item_no bigint, item_id bigint, term binary, times bigint")


def impacts(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to documents that have it so often and are normed so."""
    return (SCALE * counts) // (1000 * counts + SATURATION * norms)


def norms_of(lengths: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """m of documents with so many terms. n N may exceed 64 bits before it is divided, so it is split."""
    whole, rest = divmod(NORMED * n_docs, max(all_terms, 1))
    if max(int(lengths.max(initial=0)), 1) * max(whole, rest) < 2**62:
        return 100 - NORMED + lengths * whole + (lengths * rest) // max(all_terms, 1)
    return 100 - NORMED + np.array([NORMED * int(v) * n_docs // max(all_terms, 1) for v in lengths], np.int64)


class Lists:
    """The postings of a shard for the terms of a block of items, and the norms of its documents."""

    def __init__(self, term_nos: list[int], docs: list[bytes], counts: list[bytes], least: list[bytes], norms: np.ndarray, norm_of):
        self.norms = norms
        self.docs = {t: np.frombuffer(b, "<u4").astype(np.int64) for t, b in zip(term_nos, docs, strict=True)}
        self.counts = {t: np.frombuffer(b, "<u4").astype(np.int64) for t, b in zip(term_nos, counts, strict=True)}
        self.best = {}
        for t, b in zip(term_nos, least, strict=True):
            pairs = np.frombuffer(b, "<i8").reshape(-1, 2)
            self.best[t] = int(impacts(pairs[:, 0], norm_of(pairs[:, 1])).max())
        edges, width = [0], FIRST_WINDOW
        while edges[-1] < len(norms):
            edges.append(min(len(norms), edges[-1] + width))
            width *= 2
        self.edges = edges
        self.cuts = {t: np.searchsorted(d, edges) for t, d in self.docs.items()}

    def added(self, term: int, at: np.ndarray | slice) -> np.ndarray:
        return impacts(self.counts[term][at], self.norms[self.docs[term][at]])


def max_score(lists: Lists, asked: list[tuple[int, int]], ids: np.ndarray, nulls: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the shard's ``top`` best for an item: the highest score first, then the least id; a null id is last.

    asked: (term, weight times its occurrences in the item).
    """
    ranked = sorted(((w * lists.best[t], t, w) for t, w in asked if t in lists.docs and w > 0))
    bounds = np.cumsum([b for b, _, _ in ranked])
    docs, scores, last = np.empty(0, np.int64), np.empty(0, np.int64), 1
    for window, (low, high) in enumerate(zip(lists.edges[:-1], lists.edges[1:], strict=True)):
        # Documents that have only terms before the first essential one stay below the last place.
        essential = int(np.searchsorted(bounds, last, side="left"))
        if essential == len(ranked):
            break
        score = np.zeros(high - low, np.int64)
        for _, t, w in ranked[essential:]:
            at = slice(*lists.cuts[t][window : window + 2])
            score[lists.docs[t][at] - low] += w * lists.added(t, at)
        can = np.flatnonzero(score)
        for k in range(essential - 1, -1, -1):
            can = can[score[can] + bounds[k] >= last]
            if not len(can):
                break
            _, t, w = ranked[k]
            first, stop = lists.cuts[t][window : window + 2]
            own = lists.docs[t][first:stop]
            at = np.searchsorted(own, can + low)
            there = at < len(own)
            there[there] = own[at[there]] == can[there] + low
            score[can[there]] += w * lists.added(t, first + at[there])
        can = can[score[can] >= last]
        docs, scores = np.concatenate([docs, can + low]), np.concatenate([scores, score[can]])
        order = np.lexsort((ids[docs], nulls[docs], -scores))[:top]
        docs, scores = docs[order], scores[order]
        if len(docs) == top:
            last = int(scores[-1])
    return docs, scores


FOUND = "item_no bigint, item_id bigint, doc_id bigint, score bigint"


def _search_block(spark: SparkSession, index: DataFrame, block: DataFrame, n_docs: int, all_terms: int, top: int) -> DataFrame:
    """(item_no, item_id, doc_id, score): each shard's best documents for the items of a block, whose terms are broadcast."""
    asked = durable(block)
    vocabulary = F.broadcast(asked.select("term").distinct())
    frequency = index.join(vocabulary, "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    known = {bytes(r["term"]): r["df"] for r in frequency.toLocalIterator()}
    term_nos = {t: k for k, t in enumerate(sorted(known))}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in known.items()}
    by_item: dict = {}
    for r in asked.toLocalIterator():
        if (term := bytes(r["term"])) in known:
            by_item.setdefault((r["item_no"], r["item_id"]), []).append((term_nos[term], weight[term] * r["times"]))
    numbers = spark.createDataFrame([(t, k) for t, k in term_nos.items()], "term binary, term_no int")
    held = spark.sparkContext.broadcast(by_item)

    def search(key, rows: pa.Table, heads: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table([pa.array([], pa.int64())] * 4, ["item_no", "item_id", "doc_id", "score"])
        ids, lengths, nulls = (np.frombuffer(heads[c][0].as_py(), kind) for c, kind in (("ids", "<i8"), ("lengths", "<i8"), ("nulls", "u1")))
        norm = lambda v: norms_of(v, n_docs, all_terms)
        lists = Lists(rows["term_no"].to_pylist(), *(rows[c].to_pylist() for c in ("docs", "counts", "least")), norm(lengths), norm)
        out: list[list] = [[], [], [], []]
        for (item_no, item_id), wanted in held.value.items():
            docs, scores = max_score(lists, wanted, ids, nulls, top)
            out[0] += [item_no] * len(docs)
            out[1] += [item_id] * len(docs)
            out[2] += [None if nulls[d] else int(ids[d]) for d in docs]
            out[3] += scores.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], ["item_no", "item_id", "doc_id", "score"])

    # The lists of a block's terms by shard: SHARD_POSTINGS bounds what a task gets of one shard.
    lists = index.join(F.broadcast(numbers), "term").select("shard", "term_no", "docs", "counts", "least")
    heads = index.where("term is null").select(F.col("shard").alias("of"), F.col("docs").alias("ids"), F.col("counts").alias("lengths"), F.col("least").alias("nulls"))
    return lists.groupBy("shard").cogroup(heads.groupBy("of")).applyInArrow(search, FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each item's ``top`` best documents: item id, rank (from 1), document id and score.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A to Z are
    lower-cased. A document's score sums, over the item's terms, repeats included, the term's weight
    floor(1000 ln((2 N + 2) / (2 df + 1))) times (10^9 tf) div (1000 tf + 8 m) with
    m = 25 + (75 n N) div L. Documents with a score above 0 count; of equal scores the lesser id
    is first, a null id last. Null and empty texts have no terms, and items without terms that
    any document has return nothing, as do empty tables. Rows of equal id are documents, or items,
    of their own. Very long texts are cut into terms piece by piece; terms of more than 64 bytes
    are held by their SHA-256. Other columns are ignored.

    A block of items is broadcast with its terms, of about ``block_bytes`` bytes; of items larger
    than that, each is a block of its own or shares one.
    """
    spark = docs.sparkSession
    index, _ = written(build_index(docs, id_col, text_col), "lexical-index")
    n_docs, all_terms = _statistics(index)
    asked = durable(item_terms(items, item_col, item_text_col))
    size = asked.agg(F.sum(F.length("term") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == k)
        own = _search_block(spark, index, block, n_docs, all_terms, top)
        found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")
