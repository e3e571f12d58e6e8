"""Operator 11: removal of repeated byte strings by a suffix structure of many documents.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Whether one
does is read off the Burrows-Wheeler transform and the longest common prefixes of a collection, built
column by column as Bauer, Cox and Rosone do (2011, with prefixes 2012): each round prepends one
symbol to every document, finds the places of the new suffixes by ranks in the transform, and
merges them into files that are read and written once, from front to end. A symbol is a
block of 100 bytes, known by a 64-bit hash, and a stretch of text is 100 documents, one for each
place in a block where a string can begin; so 400 bytes are four symbols, and there are as many
rounds as a stretch has blocks, not as a text has bytes.

For equal strings to meet, texts are cut where their content says. Of the ``GRAM`` bytes from every
position a hash is taken; a string is known by the least of those inside it (its anchor: winnowing,
Schleimer et al. 2003), the leftmost if several are equal. Neighbouring strings with one anchor
make up a piece. Equal strings have equal anchors, so only pieces with equal anchors need one
collection. Equal pieces are one document that counts twice; where an anchor has no other
piece, nothing has to be built. All pieces of one anchor go to one task, many anchors to a
collection; an anchor with too many different pieces is split: half of a piece's strings
all contain a longer stretch around the anchor, and that stretch is the new anchor. It ends at
single strings, which are equal if their anchors are.

Shape at scale: texts are read three times and shuffled twice: to fetch pieces, by document, and
to cut the results. Rows of pieces, one in some 170 bytes, have no text until their anchor
is known to have different pieces. Grouping merges each task's repeats first; joins that
hot anchors go through come straight from shuffles, so Spark splits them.
"""

from __future__ import annotations

import tempfile
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import apart, durable, remove, whole_text, written

LENGTH, GRAM = 400, 64
#: Bytes of a symbol; LENGTH is a multiple of it.
BLOCK = 100
#: Bytes of texts that a worker hashes at a time; a place in them fits in PLACE_BITS.
BUFFER, PLACE_BITS = 1_000_000, 20
#: Different pieces of one anchor that are compared in one collection, and pieces of a collection, about.
ANCHOR_PIECES, COLLECTION_PIECES = 4_096, 4_096
#: Suffixes that are merged at a time when a file is read.
FILE_CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A number for each byte, and powers of an odd number with their inverses, for rolling hashes mod 2^64.
_BYTES = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_STEP, n), _powers(pow(_STEP, -1, 2**64), n)


def _gram_hashes(data: np.ndarray, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every position."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * powers[0][: len(data)], dtype=np.uint64)])
    x = (sums[gram:] - sums[:-gram]) * powers[1][: len(data) - gram + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * _ODD


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from the minima of blocks read forward and backward."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def pieces_of(data: np.ndarray, edges: np.ndarray, length: int, gram: int, powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor, first, last) of the pieces of texts that lie one after another between the edges.

    A piece is a run of strings, by their first bytes, that have one anchor.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return np.empty(0, np.uint64), none, none, none
    grams = _gram_hashes(data, gram, powers)
    low = np.uint64((1 << PLACE_BITS) - 1)
    places = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least((grams & ~low) | places, length - gram + 1)
    start = np.arange(len(least))
    inside = start + length <= np.repeat(edges[1:], np.diff(edges))[: len(least)]
    start, anchor = start[inside], (least[inside] & low).astype(np.int64)
    if not len(start):
        return np.empty(0, np.uint64), none, none, none
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    return grams[anchor[new]], anchor[new], start[new], np.concatenate([start[new[1:] - 1], start[-1:]])


PIECE = "anchor bigint, piece bigint, id bigint, text_hash bigint, first int, n_first int, before int, own boolean"


def pieces(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row for each piece of each text: (anchor, piece, id, text_hash, first, n_first, before, own).

    ``anchor`` and ``piece`` are hashes, ``first`` is the place of the first of its ``n_first``
    strings, ``before`` the bytes from there to the anchor. Pieces that a stretch of text repeats are
    one row with ``own``; what they cover together are rows without an anchor, with the
    place and the bytes. A text of more than BUFFER bytes is hashed in stretches that overlap.
    """

    def stretches(batches):
        """(id, text_hash, place in the text, bytes) of each stretch."""
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_buffer()
                for at in range(0, max(1, text.size - length + 1), BUFFER - length + 1):
                    yield batch.column(0)[row], batch.column(1)[row], at, np.frombuffer(text, np.uint8)[at : at + BUFFER]

    def buffers(batches):
        held, size = [], 0
        for s in stretches(batches):
            if len(s[3]) < length:
                continue
            if held and size + len(s[3]) > BUFFER:
                yield held
                held, size = [], 0
            held.append(s)
            size += len(s[3])
        if held:
            yield held

    def apply(batches):
        import xxhash

        powers = rolling_powers(BUFFER + 1)
        for held in buffers(batches):
            data = np.concatenate([s[3] for s in held])
            edges = np.cumsum([0, *(len(s[3]) for s in held)])
            grams, anchors, first, last = pieces_of(data, edges, length, gram, powers)
            raw = data.tobytes()
            hashes = np.array([xxhash.xxh3_64_intdigest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
            owner = np.searchsorted(edges, first, side="right") - 1
            place = first - edges[owner] + np.array([s[2] for s in held])[owner]
            # Repeats inside a stretch: one row stands for them, and what they cover is known.
            order = np.lexsort((first, hashes, grams, owner))
            same = np.zeros(len(order), bool)
            if len(order) > 1:
                same[1:] = (owner[order[1:]] == owner[order[:-1]]) & (grams[order[1:]] == grams[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
            repeats, heads = np.zeros(len(order), bool), np.ones(len(order), bool)
            repeats[order] = same | np.concatenate([same[1:], [False]]) if len(order) else same
            heads[order] = ~same
            yield _piece_rows(held, owner[heads], grams[heads], hashes[heads], place[heads], (last - first + 1)[heads], (anchors - first)[heads], repeats[heads])
            if repeats.any():
                at = np.flatnonzero(repeats)
                stop = place[at] + (last - first)[at] + length
                opens = np.concatenate([[True], (owner[at[1:]] != owner[at[:-1]]) | (place[at[1:]] > stop[:-1])])
                group = np.flatnonzero(opens)
                ends = np.maximum.reduceat(stop, group)
                yield _piece_rows(held, owner[at[group]], None, None, place[at[group]], ends - place[at[group]], np.zeros(len(group), np.int64), np.ones(len(group), bool))

    return rows.select("id", "text_hash", F.col("_text").cast("binary").alias("text")).mapInArrow(apply, PIECE)


def _piece_rows(held, owner, grams, hashes, first, n_first, before, own) -> pa.RecordBatch:
    ids, text_hashes = pa.array([s[0].as_py() for s in held], pa.int64()), pa.array([s[1].as_py() for s in held], pa.int64())
    none = pa.nulls(len(owner), pa.int64())
    columns = [
        none if grams is None else pa.array(grams.view(np.int64)),
        none if hashes is None else pa.array(hashes.view(np.int64)),
        *(c.take(pa.array(owner)) for c in (ids, text_hashes)),
        *(pa.array(c.astype(np.int32)) for c in (first, n_first, before)),
        pa.array(own),
    ]
    return pa.record_batch(columns, [c.split()[0] for c in PIECE.split(", ")])


class Files:
    """Three files of a collection's suffixes in order: the symbol before each, its common prefix with the one above, and its place."""

    KINDS = {"bwt": np.int32, "lcp": np.uint8, "place": np.int32}

    def __init__(self, folder: str):
        self.folder, self.round, self.size = Path(folder), 0, 0
        for name in self.KINDS:
            (self.folder / f"{name}-0").touch()

    def chunks(self, *names: str):
        """(index of the first suffix, an array of each kind) from front to end; once with empty arrays if there is none."""
        opened = [(self.folder / f"{n}-{self.round}").open("rb") for n in names]
        try:
            for at in range(0, max(1, self.size), FILE_CHUNK):
                n = min(FILE_CHUNK, self.size - at)
                yield at, *(np.fromfile(f, self.KINDS[name], n) for f, name in zip(opened, names, strict=True))
        finally:
            for f in opened:
                f.close()

    def replace(self, chunks) -> None:
        """Write the next files from chunks of all kinds, and drop the old ones."""
        new = [(self.folder / f"{n}-{self.round + 1}").open("wb") for n in self.KINDS]
        size = 0
        for arrays in chunks:
            size += len(arrays[0])
            for f, a, kind in zip(new, arrays, self.KINDS.values(), strict=True):
                a.astype(kind, copy=False).tofile(f)
        for f in new:
            f.close()
        for n in self.KINDS:
            (self.folder / f"{n}-{self.round}").unlink()
        self.round, self.size = self.round + 1, size


class Least:
    """Least values of stretches of an array, from tables of powers of two."""

    def __init__(self, x: np.ndarray):
        self.tables = [x]
        while (w := 1 << len(self.tables)) <= len(x):
            t = self.tables[-1]
            self.tables.append(np.minimum(t[: len(x) - w + 1], t[w // 2 : len(x) - w + 1 + w // 2]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of x[low..high], both included."""
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), self.tables[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.tables[k][low[at]], self.tables[k][high[at] - (1 << int(k)) + 1])
        return out


def _ranked(files: Files, new: np.ndarray, n_symbols: int) -> tuple[np.ndarray, ...]:
    """(symbol, rank, common, index) of the symbols at ``new`` indices of the transform, and of the next ones of their kinds.

    One pass. The suffix that a symbol begins is the rank-th of its kind and has ``common`` symbols in
    common with the one above it: one more than the least prefix since the last symbol of its kind. The
    index is -1 where the symbol isn't new.
    """
    seen = np.zeros(n_symbols, np.int64)
    since = np.zeros(n_symbols, np.uint8)
    last_new = np.zeros(n_symbols, bool)
    out: list[tuple[np.ndarray, ...]] = []
    for at, bwt, lcp in files.chunks("bwt", "lcp"):
        if not len(bwt):
            continue
        known = np.flatnonzero(bwt >= 0)
        keys = np.sort(bwt[known].astype(np.int64) * FILE_CHUNK + known)
        symbol, place = keys // FILE_CHUNK, keys % FILE_CHUNK
        is_new = np.zeros(len(bwt), bool)
        is_new[new[slice(*np.searchsorted(new, [at, at + len(bwt)]))] - at] = True
        is_new = is_new[place]
        head = np.ones(len(keys), bool)
        head[1:] = symbol[1:] != symbol[:-1]
        heads = np.flatnonzero(head)
        rank = np.arange(len(keys)) - np.repeat(heads, np.diff(np.append(heads, len(keys)))) + seen[symbol]
        after_new = np.empty(len(keys), bool)
        after_new[1:] = is_new[:-1]
        after_new[heads] = last_new[symbol[heads]]
        low = np.empty(len(keys), np.int64)
        low[1:] = place[:-1] + 1
        low[heads] = 0
        least = Least(lcp)
        found = np.flatnonzero(is_new | after_new)
        common = least.between(low[found], place[found]).astype(np.int64)
        carried = head[found]
        common[carried] = np.minimum(common[carried], since[symbol[found[carried]]])
        common = np.where(rank[found] > 0, common + 1, 0)
        out.append((symbol[found], rank[found], common, np.where(is_new[found], place[found] + at, -1)))
        if at + len(bwt) >= files.size:
            break
        # What the next chunk has to know of each symbol.
        np.minimum(since, lcp.min(), out=since)
        tails = np.append(heads[1:], len(keys))[: len(heads)] - 1
        tail = place[tails]
        inner = tail + 1 < len(lcp)
        left = np.full(len(tails), 255, np.uint8)
        left[inner] = least.between(tail[inner] + 1, np.full(int(inner.sum()), len(lcp) - 1))
        since[symbol[tails]], last_new[symbol[tails]] = left, is_new[tails]
        seen[symbol[tails]] = rank[tails] + 1
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _merged(files: Files, at: np.ndarray, following: np.ndarray, place: np.ndarray, changed: np.ndarray, common: np.ndarray):
    """The files' next chunks: new suffixes at the indices ``at``, and the common prefixes at the indices ``changed``."""
    before = at - np.arange(len(at))
    begin = 0
    for start, bwt, lcp, places in files.chunks("bwt", "lcp", "place"):
        stop = start + len(bwt)
        own = slice(np.searchsorted(before, start), np.searchsorted(before, stop) if stop < files.size else len(before))
        where = before[own] - start
        lcp = np.insert(lcp, where, 0)
        touched = slice(*np.searchsorted(changed, [begin, begin + len(lcp)]))
        lcp[changed[touched] - begin] = common[touched]
        yield np.insert(bwt, where, following[own]), lcp, np.insert(places, where, place[own])
        begin += len(lcp)


def build_collection(symbols: np.ndarray, first: np.ndarray, count: np.ndarray, step: int, folder: str, depth: int) -> Files:
    """Files of the sorted suffixes of all documents, by one symbol per document and round.

    Document i has ``count[i]`` symbols, which stand at ``first[i]``, ``first[i] + step`` and so on.
    Common prefixes are counted up to ``depth``. Ends are less than any symbol, and differ.
    """
    files, n_symbols = Files(folder), int(symbols.max(initial=-1)) + 1
    order = np.argsort(-count, kind="stable")
    last, count = (first + step * (count - 1))[order], count[order]
    m, rounds = len(count), int(count.max(initial=0))
    # Round 0: the empty suffixes, one for each document; before each stands its document's last symbol.
    files.replace([(np.where(count > 0, symbols[np.where(count > 0, last, 0)], -1) if len(symbols) else np.full(m, -1), np.zeros(m), np.full(m, -1))])
    doc_at, index, starts = np.arange(m), np.arange(m), np.zeros(n_symbols, np.int64)
    for k in range(rounds):
        # Those with a symbol left, in the order of their last suffixes.
        live = doc_at < np.searchsorted(-count, -(k + 1), side="right")
        docs, new = doc_at[live], index[live]
        symbol, rank, common, index_of = _ranked(files, new, n_symbols)
        starts += np.bincount(symbols[last[docs] - k * step], minlength=n_symbols)
        base = m + np.cumsum(starts) - starts
        to = base[symbol] + rank
        order = np.argsort(to)
        to, common, index_of = to[order], np.minimum(common[order], depth), index_of[order]
        is_new = index_of >= 0
        docs = docs[np.searchsorted(new, index_of[is_new])]
        more = count[docs] > k + 1
        following = np.where(more, symbols[np.where(more, last[docs] - (k + 1) * step, 0)], -1)
        files.replace(_merged(files, to[is_new], following, last[docs] - k * step, to, common))
        doc_at, index = docs, to[is_new]
    return files


def repeated_places(files: Files, n: int, depth: int) -> np.ndarray:
    """Whether the suffix at each of n places has ``depth`` symbols in common with another one; one pass."""
    out, above = np.zeros(n, bool), -1
    for _, lcp, place in files.chunks("lcp", "place"):
        deep = np.flatnonzero(lcp >= depth)
        out[place[deep]] = True
        out[np.where(deep > 0, place[deep - 1], above)] = True
        above = place[-1] if len(place) else above
    return out


def repeats_inside(texts: list[bytes], n_first: np.ndarray, length: int, block: int) -> np.ndarray:
    """Whether the string from each byte of all texts, one after another, occurs twice; only from the first ``n_first`` bytes of each."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes = _gram_hashes(data, block, rolling_powers(len(data) + 1))
    order = np.argsort(hashes)
    symbols = np.empty(len(hashes), np.int32)
    symbols[order] = np.cumsum(np.concatenate([[0], hashes[order[1:]] != hashes[order[:-1]]])[: len(order)])
    begins = np.cumsum(sizes) - sizes
    phases = np.minimum(n_first, block)
    owner = np.repeat(np.arange(len(texts)), phases)
    phase = np.arange(len(owner)) - np.repeat(np.cumsum(phases) - phases, phases)
    with tempfile.TemporaryDirectory() as folder:
        files = build_collection(symbols, begins[owner] + phase, (sizes[owner] - phase) // block, block, folder, length // block)
        return repeated_places(files, len(data), length // block)


def covered(starts: np.ndarray, length: int) -> np.ndarray:
    """(from, to) of the merged stretches that strings from the starts, in rising order, cover."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
    return np.stack([starts[new], np.append(starts[new[1:] - 1], starts[-1]) + length], axis=1)


SPANS = "array<struct<start:int,stop:int>>"
#: A piece with its text. root_anchor and root_piece name the piece it is a part of, from ``offset`` on.
PART = "root_anchor bigint, root_piece bigint, offset int, anchor bigint, piece bigint, n_first int, before int, times bigint, text binary"


def _fetched(kinds: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The pieces with their texts, cut from one of the documents that have them."""
    wanted = F.collect_list(F.struct("anchor", "piece", "rep.first", "rep.n_first", "rep.before", "times"))
    wanted = kinds.groupBy(F.col("rep.id").alias("id"), F.col("rep.text_hash").alias("text_hash")).agg(wanted.alias("wanted"))
    # Equal rows have equal pieces; one of them is read.
    texts = rows.join(durable(wanted).select(apart("id"), "text_hash", "wanted"), ["id", "text_hash"])
    texts = texts.select("id", "text_hash", F.col("_text").cast("binary").alias("text"), "wanted")

    def cut(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_buffer()
                wanted = batch.column(3)[row].as_py()
                column = lambda name, kind: pa.array([w[name] for w in wanted], kind)  # noqa: E731, B023
                names = [column("anchor", pa.int64()), column("piece", pa.int64())]
                parts = [bytes(text.slice(w["first"], w["n_first"] - 1 + length)) for w in wanted]
                yield pa.record_batch([*names, pa.array([0] * len(wanted), pa.int32()), *names, column("n_first", pa.int32()), column("before", pa.int32()), column("times", pa.int64()), pa.array(parts, pa.binary())], [c.split()[0] for c in PART.split(", ")])

    return texts.mapInArrow(cut, PART).dropDuplicates(["anchor", "piece"])


def _compared(parts: DataFrame, collections: int, length: int, block: int) -> DataFrame:
    """(root_anchor, root_piece, start, stop): what is repeated of the parts that occur once, by collections of whole anchors."""

    def compare(rows: pa.Table) -> pa.Table:
        texts, n_first = rows["text"].to_pylist(), rows["n_first"].to_numpy()
        repeated = repeats_inside(texts, n_first, length, block)
        begins = np.cumsum([0, *map(len, texts)])
        found: list[tuple[int, int, int]] = []
        for k in np.flatnonzero(rows["times"].to_numpy() == 1):
            spans = covered(np.flatnonzero(repeated[begins[k] : begins[k] + n_first[k]]), length)
            found += [(k, a, b) for a, b in spans.tolist()]
        of = pa.array([k for k, _, _ in found], pa.int64())
        offset = rows["offset"].to_numpy()
        columns = [pa.array([offset[k] + s[j] for k, *s in found], pa.int32()) for j in (0, 1)]
        return pa.table([rows["root_anchor"].take(of), rows["root_piece"].take(of), *columns], ["root_anchor", "root_piece", "start", "stop"])

    dealt = parts.withColumn("collection", F.pmod(F.xxhash64("anchor"), F.lit(collections)))
    return dealt.groupBy("collection").applyInArrow(compare, "root_anchor bigint, root_piece bigint, start int, stop int")


def _halves(parts: DataFrame, level: int, length: int, gram: int) -> DataFrame:
    """The parts cut by how far their strings begin before the anchor, in steps that halve at every level."""
    width = max(1, -(-(length - gram + 1) >> level))

    def cut(batches):
        import xxhash

        for batch in batches:
            made = []
            for r in batch.to_pylist():
                # Strings from the furthest before the anchor on; a part's strings lie in one step of the grid.
                at = 0
                while at < r["n_first"]:
                    step = (r["before"] - at) // width
                    n = min(r["n_first"] - at, r["before"] - at - step * width + 1)
                    text = r["text"][at : at + n - 1 + length]
                    # Inside all strings of the step: from the last one's begin to the first one's end.
                    core = r["text"][r["before"] - step * width : r["before"] - step * width - width + 1 + length]
                    place = f"{step} {r['before'] - at} {n}".encode()
                    anchor = xxhash.xxh3_64_intdigest(core, step) ^ (r["anchor"] & (2**64 - 1))
                    made.append(r | {"offset": r["offset"] + at, "anchor": _signed(anchor), "piece": _signed(xxhash.xxh3_64_intdigest(place + b":" + text)), "n_first": n, "before": r["before"] - at, "text": text})
                    at += n
            yield pa.RecordBatch.from_pylist(made, schema=batch.schema)

    return parts.mapInArrow(cut, PART)


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def _spans_of_kinds(parts: DataFrame, length: int, gram: int, block: int, anchor_pieces: int, collection_pieces: int) -> list[DataFrame]:
    """Tables (root_anchor, root_piece, start, stop) of what is repeated of the parts; parts of equal (anchor, piece) are equal."""
    out, level = [], 0
    while True:
        sizes = durable(parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces"), F.min("times").alias("least")).where("pieces > 1 and least = 1"))
        total = sizes.where(F.col("pieces") <= anchor_pieces).agg(F.sum("pieces")).first()[0] or 0
        # An anchor whose step is one string has one piece, so the cuts come to an end.
        few = parts.join(sizes.where(F.col("pieces") <= anchor_pieces).select(apart("anchor")), "anchor", "left_semi")
        out.append(durable(_compared(few, max(1, -(-total // collection_pieces)), length, block)))
        large = sizes.where(F.col("pieces") > anchor_pieces)
        if large.isEmpty():
            return out
        level += 1
        halves = durable(_halves(parts.join(large.select(apart("anchor")), "anchor", "left_semi").select(*[c.split()[0] for c in PART.split(", ")]), level, length, gram))
        kinds = halves.groupBy("anchor", "piece").agg(F.sum("times").alias("total"), F.min("root_piece").alias("root"), F.min("root_anchor").alias("root_of"))
        kinds = durable(kinds)
        whole = halves.where("times = 1").join(kinds.where("total > 1").select(apart("anchor"), "piece"), ["anchor", "piece"], "left_semi")
        out.append(whole.select("root_anchor", "root_piece", F.col("offset").alias("start"), (F.col("offset") + F.col("n_first") - 1 + length).alias("stop")))
        stays = halves.join(kinds.select(apart("anchor"), "piece", F.col("root").alias("root_piece"), F.col("root_of").alias("root_anchor"), "total"), ["anchor", "piece", "root_piece", "root_anchor"])
        parts = durable(stays.withColumn("times", F.col("total")).dropDuplicates(["anchor", "piece"]).select(*[c.split()[0] for c in PART.split(", ")]))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, id, text_hash, _text): id and text_hash name a row by its content; equal rows have equal names."""
    id_, text = F.col(id_col).cast("bigint"), whole_text(text_col)
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(id_, F.lit(0).cast("bigint")).alias("id"), F.xxhash64(text, id_.isNull()).alias("text_hash"), text.alias("_text"))


def repeated_spans(rows: DataFrame, length: int, gram: int, block: int, anchor_pieces: int, collection_pieces: int) -> tuple[DataFrame, list[str]]:
    """(id, text_hash, removed) of the rows that lose anything, and the folders that it is read from."""
    found, path = written(pieces(rows, length, gram), "pieces")
    known = found.where("anchor is null").select("id", "text_hash", F.col("first").alias("start"), (F.col("first") + F.col("n_first")).alias("stop"))
    found = found.where("anchor is not null").withColumn("times", F.when(F.col("own"), 2).otherwise(1))
    live = found.groupBy("anchor").agg(F.sum("times").alias("n"), (F.min("piece") == F.max("piece")).alias("alike")).where("n > 1").select("anchor", "alike")
    alive, alive_path = written(found.join(durable(live).select(apart("anchor"), "alike"), "anchor").drop("own"), "live-pieces")
    whole = alive.where("alike").select("id", "text_hash", F.col("first").alias("start"), (F.col("first") + F.col("n_first") - 1 + length).alias("stop"))
    mixed = alive.where("not alike")
    kinds = durable(mixed.groupBy("anchor", "piece").agg(F.sum("times").alias("times"), F.min(F.struct("id", "text_hash", "first", "n_first", "before")).alias("rep")))
    open_ = durable(kinds.groupBy("anchor").agg(F.min("times").alias("least")).where("least = 1").select("anchor"))
    parts, parts_path = written(_fetched(kinds.join(open_.select(apart("anchor")), "anchor", "left_semi"), rows, length), "parts")
    spans = _spans_of_kinds(parts, length, gram, block, anchor_pieces, collection_pieces)
    compared = reduce(DataFrame.unionByName, spans).select(F.col("root_anchor").alias("anchor"), F.col("root_piece").alias("piece"), F.struct("start", "stop").alias("span"))
    compared = compared.groupBy("anchor", "piece").agg(F.collect_set("span").alias("spans"))
    repeated = kinds.where("times > 1").select("anchor", "piece", F.array(F.struct(F.lit(0).alias("start"), (F.col("rep.n_first") - 1 + length).cast("int").alias("stop"))).alias("spans"))
    decided = durable(repeated.unionByName(compared.join(kinds.where("times = 1").select(apart("anchor"), "piece"), ["anchor", "piece"], "left_semi")))
    partly = mixed.join(decided.select(apart("anchor"), "piece", "spans"), ["anchor", "piece"]).select("id", "text_hash", "first", F.inline("spans"))
    partly = partly.select("id", "text_hash", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))
    every = known.unionByName(whole).unionByName(partly).distinct()
    return durable(every.groupBy("id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed"))), [path, alive_path, parts_path]


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans with those joined that overlap or touch."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s["stop"])
        else:
            out.append((s["start"], s["stop"]))
    return out


def without_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, anchor_pieces: int = ANCHOR_PIECES, collection_pieces: int = COLLECTION_PIECES) -> DataFrame:
    """One row per document: id, n_bytes, removed (array of start and stop bytes) and kept_bytes.

    Texts are UTF-8 bytes. A byte is removed if a string of ``length`` bytes that covers it also starts
    at another place of any document, its own and equal rows included; strings overlap, do not
    cross documents, and are judged on the whole input. So all of a text of ``length`` bytes or more
    goes if another row has it too, and shorter texts stay. Null counts as empty; null and empty
    texts stay as they are. Ids may be null or repeat. An empty table gives no rows. Other columns
    are ignored. Very long texts are hashed in stretches; a document's own spans are held at once.
    ``length`` is a multiple of ``block`` and larger than ``gram``.
    """
    rows = _rows(docs, id_col, text_col)
    removed, folders = repeated_spans(rows, length, gram, block, anchor_pieces, collection_pieces)
    for folder in folders:
        remove(docs.sparkSession, folder)
    joined = rows.join(removed.select(apart("id"), "text_hash", "removed"), ["id", "text_hash"], "left").select(F.col("_id").alias(id_col), F.col("_text").cast("binary").alias("text"), "removed")
    id_kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            spans, kept = [], []
            for row in range(batch.num_rows):
                own, text = merged(batch.column(2)[row].as_py() or []), batch.column(1)[row].as_buffer()
                edges = [0, *(e for s in own for e in s), text.size]
                spans.append([{"start": a, "stop": b} for a, b in own])
                kept.append(b"".join(text.slice(a, b - a) for a, b in zip(edges[::2], edges[1::2], strict=True)))
            sizes = pa.array([len(batch.column(1)[row].as_buffer()) for row in range(batch.num_rows)], pa.int64())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.record_batch([batch.column(0), sizes, pa.array(spans, kind), pa.array(kept, pa.binary())], [id_col, "n_bytes", "removed", "kept_bytes"])

    return joined.mapInArrow(cut, f"`{id_col}` {id_kind}, n_bytes bigint, removed {SPANS}, kept_bytes binary")
