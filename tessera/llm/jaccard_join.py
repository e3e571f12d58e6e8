"""Operator 9: n-gram Jaccard join by chosen paths.

Each document is the set of its word n-grams. After Christiani and Pagh (2017), a set
walks down a tree: at a node it is sent to the children named by some of its own n-grams,
each the least under a hash of that node, so that two sets of similarity J meet in a child
with probability J each. A node with at most ``block`` sets is a leaf. Walks go as deep as
nodes are large; with as many branches as ``branches_for`` gives, the odds that a pair
comes through don't fall below a fixed point, however deep the tree is. Whole walks are
repeated until the expected recall at the threshold reaches the target.

In a leaf all sets are compared by sketches, the least ``SKETCH`` fingerprints of each (as
Christiani, Pagh and Sivertsen 2018 do with other sketches); what may be linked there forms
a cluster. Equal clusters of several leaves are one. Fingerprints are fetched for the sets
of clusters alone, and a cluster is compared exactly, by products of 0/1 matrices.

A node that its children would not split is one whose sets have much in common: a template, a
license, a family of copies. There sets choose among the n-grams that fewer than half of the
node have. A pair at the threshold shares less of those, so a set takes as many branches as
keep its odds, by how much of it is common. Where too little is left to choose from, sets are the
node's core: they leave the walk, and are compared with each other and with those sets of the
node that have enough in common with them. Half of that is proven without pairs: Jaccard
distance is a metric, so sets within half the allowed distance of one and the same set,
that of the n-grams most sets have, are all linked (a ball). What is compared goes chunk by
chunk, so no task ever holds more than two chunks.

A pair that meets in several clusters is counted in the least of them only. Pairs are never
written out: a block returns, for each of its sets, how many links it has there and the
least set that it is linked with through the block; those edges, fewer than the sets, give
the classes. Equal sets are merged first and stand for all their documents.

Shape at scale: texts are read once. What moves is, per set, its tree keys (28 numbers), a
sketch of 96 bytes per shared leaf, and the fingerprints once and once more per cluster. The
plan is the same at every size. A pair's similarity is computed on 32-bit fingerprints; a
chance agreement of two different n-grams of a pair has a probability of about n^2 / 2^32.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import apart, broadcast_if_small, durable, map_rows, partitions, whole_text
from tessera.llm.components import components
from tessera.llm.toxicity import WordHashes

N_GRAM, THRESHOLD = 5, 0.8
#: Levels of the trees whose keys are made with the fingerprints; deeper ones are made where they are needed.
LEVELS = 3
TARGET_RECALL = 0.99
BLOCK = 512
#: Fingerprints of a sketch, and the share of them that two sets of similarity 0.8 have in common at
#: least (8 of 24 or fewer where 19 are expected at least: odds under 1 in 100,000).
SKETCH, SKETCH_SHARE = 24, 0.375
#: Sets of a node that are asked for its common n-grams, about.
ASKED = 48
#: Bytes of common n-grams of all nodes that are broadcast at most.
COMMON_BYTES = 32_000_000
#: Where a pair at the threshold shares less than this of what isn't common, sets belong to the core.
LEAST_REST = 0.18
#: From this level on nodes are compared whole, if a walk should ever come so far.
DEEPEST = 40
#: Cells of a 0/1 matrix that a worker builds at a time.
SLAB_CELLS = 4_000_000
_WORD = re.compile(r"\w+")


def branches_for(threshold: float) -> int:
    """Branches with which walks of pairs at the threshold don't die out."""
    return max(2, math.ceil(1.6 / threshold))


def runs_for(threshold: float, recall: float = TARGET_RECALL) -> int:
    """Walks needed: a pair at the threshold comes through any number of levels with s = 1 - (1 - threshold s)^branches."""
    s = survival(threshold)
    return 1 if s >= recall else math.ceil(math.log(1 - recall) / math.log(1 - s))


def survival(threshold: float) -> float:
    """The odds that a pair at the threshold comes through a run, however deep."""
    s, branches = 1.0, branches_for(threshold)
    for _ in range(DEEPEST):
        s = 1 - (1 - threshold * s) ** branches
    return s


def rest_similarity(common: np.ndarray, threshold: float) -> np.ndarray:
    """How similar two sets of equal size at the threshold are without their common share."""
    both = 2 * threshold / (1 + threshold)
    return np.maximum(both - common, 0) / (2 - both - common)


def rest_branches(common: np.ndarray, threshold: float) -> np.ndarray:
    """Branches among the n-grams that aren't common with which a pair's odds don't fall; 0 for a set of the core.

    A pair's common shares differ a little, so the branches are those of a slightly larger share.
    """
    s = survival(threshold)
    similar = rest_similarity(np.minimum(common + 0.02, 0.999), threshold)
    core = rest_similarity(common, threshold) < LEAST_REST
    wanted = np.ceil(np.log(1 - s) / np.log1p(-np.maximum(similar, LEAST_REST / 2) * s)).astype(int)
    return np.where(core, 0, np.maximum(wanted, branches_for(threshold)))


def near_share(threshold: float) -> float:
    """The least common share of a set that can be linked with one of the core, which may be smaller by the threshold."""
    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (low, middle) if rest_similarity(np.array(middle), threshold) < LEAST_REST else (middle, high)
    part = threshold / (1 + threshold)
    return part + threshold * (part - 1 + low)


def fingerprints(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 32-bit fingerprints of the word n-grams; a shorter text is one n-gram."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint32)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    x = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - n + 1 + k]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique((x >> np.uint64(32)).astype(np.uint32))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(level: int, edges: np.ndarray) -> np.ndarray:
    """An odd factor for each edge that leads to the level."""
    return _scramble(edges.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level)) | np.uint64(1)


def _least(prints: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Of each hash of the n-grams, the least."""
    chosen = np.full(len(multipliers), np.uint64(0xFFFFFFFFFFFFFFFF))
    wide = prints.astype(np.uint64) + np.uint64(1)
    step = max(1, SLAB_CELLS // (8 * len(multipliers)))
    for at in range(0, len(wide), step):
        x = wide[None, at : at + step] * multipliers[:, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(chosen, x.min(axis=1), out=chosen)
    return chosen


def _names(level: int, edges: np.ndarray, parents: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    own = _scramble(chosen + (edges.astype(np.uint64) + np.uint64(level << 40)) * np.uint64(0xD6E8FEB86659FD93))
    return _scramble(parents ^ own)


def path_keys(prints: np.ndarray, runs: int, branches: int) -> list[np.ndarray]:
    """The names of the nodes that a set reaches, level by level; a child's name follows its parent's."""
    edges = [np.arange(runs * branches ** (level + 1)) for level in range(LEVELS)]
    chosen = _least(prints, np.concatenate([_multipliers(level, e) for level, e in enumerate(edges)]))
    out, at, names = [], 0, np.zeros(runs, np.uint64)
    for level, e in enumerate(edges):
        names = _names(level, e, np.repeat(names, branches), chosen[at : at + len(e)])
        at += len(e)
        out.append(names.view(np.int64))
    return out


def signatures(docs: DataFrame, n: int, runs: int, branches: int, id_col: str, text_col: str) -> DataFrame:
    """(row_no, id, text_hash, set_key, n_set, prints, keys1..keys3) of each document; keys are null for a text without words."""

    def apply(batches):
        import xxhash

        hashes = WordHashes()
        for pdf in batches:
            out = {"row_no": pdf["row_no"], "id": pdf["id"], "text_hash": pdf["text_hash"], "set_key": [], "n_set": [], "prints": []} | {f"keys{k + 1}": [] for k in range(LEVELS)}
            for text in pdf["text"]:
                prints = fingerprints(text, n, hashes)
                raw = prints.astype("<u4").tobytes()
                keys = path_keys(prints, runs, branches) if len(prints) else [None] * LEVELS
                out["set_key"].append(xxhash.xxh3_128_digest(raw))
                out["n_set"].append(len(prints))
                out["prints"].append(raw)
                for k in range(LEVELS):
                    out[f"keys{k + 1}"].append(keys[k])
            yield pd.DataFrame(out)

    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(whole_text(text_col)).alias("text_hash"), whole_text(text_col).alias("text"))
    keys = ", ".join(f"keys{k + 1} array<bigint>" for k in range(LEVELS))
    return map_rows(rows, apply, f"row_no bigint, id bigint, text_hash bigint, set_key binary, n_set int, prints binary, {keys}")


def _children(large: DataFrame, sets: DataFrame, prints: DataFrame, level: int, branches: int) -> DataFrame:
    """(row_no, node, edge, off, key): the nodes of the next level that the sets of large nodes go to.

    ``off`` marks rows whose way has left the trees whose keys were made with the fingerprints.
    """

    def deeper(batches):
        for pdf in batches:
            edge = np.repeat(pdf["edge"].to_numpy(np.int64) * branches, branches) + np.tile(np.arange(branches), len(pdf))
            factors = _multipliers(level, edge).reshape(-1, branches)
            chosen = [_least(np.frombuffer(b, "<u4"), f) for b, f in zip(pdf["prints"], factors, strict=True)]
            node = np.repeat(pdf["node"].to_numpy(np.int64), branches)
            key = _names(level, edge, node.view(np.uint64), np.concatenate(chosen)) if len(pdf) else np.empty(0, np.uint64)
            yield pd.DataFrame({"row_no": np.repeat(pdf["row_no"].to_numpy(), branches), "node": node, "edge": edge, "off": True, "key": key.view(np.int64)})

    computed = (large if level >= LEVELS else large.where("off")).select("row_no", "node", "edge")
    # Where the rows are few, they go to the fingerprints, which stay in place.
    out = map_rows(prints.join(broadcast_if_small(computed, computed.count()), "row_no"), deeper, "row_no bigint, node bigint, edge bigint, off boolean, key bigint")
    if level < LEVELS:
        keyed = large.where("not off").join(sets.select("row_no", F.col(f"keys{level + 1}").alias("_keys")), "row_no")
        own = F.slice("_keys", (F.col("edge") * branches + 1).cast("int"), branches)
        edges = F.sequence(F.col("edge") * branches, F.col("edge") * branches + branches - 1)
        to = F.explode(F.arrays_zip(edges.alias("edge"), own.alias("key")))
        known = keyed.select("row_no", "node", to.alias("to")).select("row_no", "node", "to.edge", F.lit(False).alias("off"), "to.key")
        out = known.unionByName(out)
    return out


def _asked(size: str):
    """About ASKED rows of a node of so many, by a hash of the row and the node."""
    return F.pmod(F.xxhash64("row_no", "node"), F.col(size)) < ASKED


def _common(rows: DataFrame, column: str, least: int) -> DataFrame:
    """(node, common): the numbers that more than half of a node's rows have in ``column``; the least of them only, if ``least``."""

    def vote(key, pdf):
        held, times = np.unique(np.concatenate([np.frombuffer(b, "<u4") for b in pdf[column]]), return_counts=True)
        most = held[times * 2 > len(pdf)]
        return pd.DataFrame({"node": [key[0]], "common": [(most[:least] if least else most).astype("<u4").tobytes()]})

    return rows.groupBy("node").applyInPandas(vote, "node bigint, common binary")


def _shared(batches, column: str, out: list[str]):
    """The columns ``out``, the numbers that ``column`` and ``common`` share, and the lengths of both."""
    for pdf in batches:
        common = {b: np.frombuffer(b, "<u4") for b in set(pdf["common"])}
        own = [np.frombuffer(b, "<u4") for b in pdf[column]]
        shared = [len(np.intersect1d(x, common[b], assume_unique=True)) for x, b in zip(own, pdf["common"], strict=True)]
        yield pdf[out].assign(shared=shared, own=[len(x) for x in own], n_common=[len(common[b]) for b in pdf["common"]])


def _rest_children(large: DataFrame, whole: DataFrame, prints: DataFrame, level: int, threshold: float) -> DataFrame:
    """(row_no, node, share, edge, key) of the sets of nodes that don't split: where they go by what isn't common; a set of the core has one row without a key."""
    inside = durable(large.join(whole.select(apart("node")), "node", "left_semi").select("row_no", "node", "edge", "in_leaf"))
    asked = inside.where(_asked("in_leaf"))
    common = durable(_common(prints.join(broadcast_if_small(asked, asked.count()), "row_no"), "prints", 0))
    size = common.agg(F.sum(F.length("common"))).first()[0] or 0

    def apply(batches):
        for pdf in batches:
            held = {b: np.frombuffer(b, "<u4") for b in set(pdf["common"])}
            out: dict[str, list] = {c: [] for c in ("row_no", "node", "share", "edge", "key")}
            for row, node, edge, b, c in zip(pdf["row_no"], pdf["node"], pdf["edge"], pdf["prints"], pdf["common"], strict=True):
                own = np.frombuffer(b, "<u4")
                rest = np.setdiff1d(own, held[c], assume_unique=True)
                share = 1 - len(rest) / len(own)
                n = int(rest_branches(np.array(share), threshold)) if len(rest) else 0
                keys: list = [None]
                edges = np.array([edge], np.int64)
                if n:
                    edges = np.int64(edge) * 64 + np.arange(n)
                    chosen = _least(rest, _multipliers(level, edges))
                    keys = _names(level, edges, np.full(n, node, np.int64).view(np.uint64), chosen).view(np.int64).tolist()
                for name, value in (("row_no", [row] * len(keys)), ("node", [node] * len(keys)), ("share", [share] * len(keys)), ("edge", edges.tolist()), ("key", keys)):
                    out[name] += value
            yield pd.DataFrame(out).astype({"key": "Int64"})

    # Where the rows are few, they go to the fingerprints, which stay in place; so do the common ones, whose bytes are counted.
    met = prints.join(broadcast_if_small(inside, inside.count()), "row_no")
    met = met.join(F.broadcast(common) if size <= COMMON_BYTES else common.select(apart("node"), "common"), "node")
    return map_rows(met, apply, "row_no bigint, node bigint, share double, edge bigint, key bigint")


def leaves(sets: DataFrame, prints: DataFrame, block: int, branches: int, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """Leaves with at least two sets, as (row_no, leaf), and hot nodes, as (row_no, leaf, core, in_leaf); None where there are none.

    What is dealt by node is three numbers per set and edge. The core of a node that doesn't split leaves the
    walk there and makes it a hot node; sets that may be linked with the core are in the hot node too
    and walk on by what isn't common, so that all pairs can meet.
    """
    members = sets.select("row_no", F.posexplode("keys1").alias("edge", "node")).withColumn("edge", F.col("edge").cast("bigint")).withColumn("off", F.lit(False))
    small, hot, level = [], [], 1
    while True:
        sizes = durable(members.groupBy("node").agg(F.count(F.lit(1)).alias("in_leaf")).where("in_leaf > 1"))
        known = members.join(sizes.select(apart("node"), "in_leaf"), "node")
        small.append(known.where(F.col("in_leaf") <= block).select("row_no", F.col("node").alias("leaf")))
        large = durable(known.where(F.col("in_leaf") > block))
        if large.isEmpty():
            break
        if level >= DEEPEST:
            hot.append(large.select("row_no", F.col("node").alias("leaf"), F.lit(True).alias("core")))
            break
        child = durable(_children(large, sets, prints, level, branches))
        held = child.groupBy("node", "key").agg(F.count(F.lit(1)).alias("held"))
        most = held.groupBy("node").agg(F.max("held").alias("held"))
        whole = durable(sizes.join(most, "node").where("held * 2 > in_leaf").select("node"))
        if not whole.isEmpty():
            rest = durable(_rest_children(large, whole, prints, level, threshold))
            cored = durable(rest.where("key is null").select("node").distinct())
            near = rest.where(F.col("share") >= near_share(threshold)).join(cored.select(apart("node")), "node", "left_semi")
            hot.append(near.select("row_no", F.col("node").alias("leaf"), F.col("key").isNull().alias("core")).distinct())
            child = child.join(whole.select(apart("node")), "node", "left_anti")
            child = child.unionByName(rest.where("key is not null").select("row_no", "node", "edge", F.lit(True).alias("off"), "key"))
        members = child.select("row_no", "edge", "off", F.col("key").alias("node"))
        level += 1
    if not hot:
        return reduce(DataFrame.unionByName, small), None
    hot = durable(reduce(DataFrame.unionByName, hot))
    sizes = durable(hot.groupBy("leaf").agg(F.count(F.lit(1)).alias("in_leaf")))
    return reduce(DataFrame.unionByName, small), durable(hot.join(sizes.select(apart("leaf"), "in_leaf"), "leaf"))


def _intersections(prints: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of distinct numbers."""
    n = len(prints)
    inter = np.zeros((n, n), np.float32)
    lengths = np.array([len(p) for p in prints])
    if not lengths.any():
        return inter
    tokens, owner = np.concatenate(prints), np.repeat(np.arange(n), lengths)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if not len(column):
        return inter
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    width = max(1, SLAB_CELLS // n)
    for at in range(0, int(column[-1]) + 1, width):
        inside = slice(*np.searchsorted(column, [at, at + width]))
        slab = np.zeros((n, min(width, int(column[-1]) + 1 - at)), np.float32)
        slab[owner[inside], column[inside] - at] = 1
        inter += slab @ slab.T
    return inter


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least member of the component of each row of a symmetric 0/1 matrix."""
    n = len(linked)
    root = np.arange(n)
    while True:
        least = np.where(linked, root[None, :], n).min(axis=1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _groups(batches, keys: list[str]):
    """Rows with equal keys, which come one after another; a group may go on in the next batch. Yields lists of groups."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if held:
            pdf = pd.concat([*held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        key = pdf[keys].to_numpy()
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(pdf)]
        yield [pdf.iloc[a:b] for a, b in zip(edges[:-2], edges[1:-1], strict=True) if b - a > 1]
        held = [pdf.iloc[edges[-2] :]]
    if held and len(held[0]) > 1:
        yield held


def _clusters(batches, threshold: float):
    """(cluster, row_no): the sets of each leaf that may be linked, by their sketches; a cluster is named by its sets."""
    import xxhash

    for leaves_ in _groups(batches, ["leaf"]):
        names, members = [], []
        for pdf in leaves_:
            sketch = [np.frombuffer(b, "<u4") for b in pdf["sketch"]]
            size, kept = pdf["n_set"].to_numpy(np.float64), np.array([len(x) for x in sketch])
            may = _intersections(sketch) >= SKETCH_SHARE * np.minimum(kept[:, None], kept[None, :])
            may &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
            np.fill_diagonal(may, False)
            if not may.any():
                continue
            root, rows = _roots(may), pdf["row_no"].to_numpy(np.int64)
            for r in np.unique(root[may.any(axis=1)]):
                own = np.sort(rows[root == r])
                names += [xxhash.xxh64_intdigest(own.tobytes()) - 2**63] * len(own)
                members.append(own)
        yield pd.DataFrame({"cluster": np.array(names, np.int64), "row_no": np.concatenate(members) if members else np.empty(0, np.int64)})


def compare_block(name: int, low: int, high: int, chunk: np.ndarray, rows: np.ndarray, weights: np.ndarray, ball: np.ndarray, all_names: list, walked: list, prints: list[np.ndarray], threshold: float):
    """(row_no, root, links, set_links) of the sets that have links counted in this cluster or block.

    Sets of one ball (0: none) are known to be linked and are not counted here. ``walked`` are those of a
    set's names under which it is compared with the core only.
    """
    n = len(rows)
    size = np.array([len(p) for p in prints], np.float64)
    # In doubles: in single precision pairs exactly at the threshold fall below it.
    linked = _intersections(prints).astype(np.float64) * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9
    np.fill_diagonal(linked, False)
    linked &= (ball[:, None] != ball[None, :]) | (ball[:, None] == 0)
    if low != high:
        linked &= chunk[:, None] != chunk[None, :]
    # A pair that also meets under a lesser name is counted there.
    if linked.any():
        linked &= _intersections([x[x < name] for x in all_names]) == _intersections([x[x < name] for x in walked])
    root = _roots(linked)
    got = np.flatnonzero(linked.any(axis=1))
    return rows[got], rows[root[got]], (linked[got] @ weights).astype(np.int64), linked[got].sum(axis=1)


def _compare_sorted(batches, threshold: float):
    """Compare clusters and blocks that come one after another, sorted."""
    for blocks in _groups(batches, ["name", "low", "high"]):
        found = [
            compare_block(
                *(int(pdf[c].iloc[0]) for c in ("name", "low", "high")), pdf["chunk"].to_numpy(), pdf["row_no"].to_numpy(), pdf["weight"].to_numpy(np.float64), pdf["ball"].to_numpy(np.int64),
                *([np.asarray(x, np.int64) for x in pdf[c]] for c in ("all_names", "walked")), [np.frombuffer(b, "<u4") for b in pdf["prints"]], threshold,
            )
            for pdf in blocks
        ]
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 4
        yield pd.DataFrame(dict(zip(("row_no", "root", "links", "set_links"), cols, strict=True)))


def balls(needed: DataFrame, threshold: float) -> DataFrame:
    """(row_no, leaf, core, ball, inside, near): of the sets of each hot node, which are within half the allowed distance of what most have.

    ``ball`` is named by that common set, ``inside`` says whether a set is in it, and ``near`` whether it can be linked with any that is.
    """
    inside = needed.where("size(hot) > 0").select("row_no", "prints", F.inline("hot")).withColumnRenamed("leaf", "node")
    common = durable(_common(inside.where(_asked("in_leaf")), "prints", 0))
    met = inside.select("row_no", "node", "core", "prints").join(common.select(apart("node"), "common"), "node")
    met = met.withColumn("ball", F.xxhash64("common"))
    shared = map_rows(met, lambda b: _shared(b, "prints", ["row_no", "node", "core", "ball"]), "row_no bigint, node bigint, core boolean, ball bigint, shared int, own int, n_common int", rows=200)
    distance = 1 - F.col("shared") / (F.col("own") + F.col("n_common") - F.col("shared"))
    allowed = 1 - threshold
    return shared.select("row_no", F.col("node").alias("leaf"), "core", "ball", (distance <= allowed / 2 + 1e-12).alias("inside"), (distance <= allowed * 1.5 + 1e-9).alias("near"))


#: Which zones of a hot node are compared: inside the ball, core near it, core far from it, walking on near it, walking on far from it.
_MEETS = {0: (1, 3), 1: (0, 1, 2, 3, 4), 2: (1, 2, 3, 4), 3: (0, 1, 2), 4: (1, 2)}


def _hot_blocks(zoned: DataFrame, block: int) -> DataFrame:
    """(row_no, name, low, high, chunk) of the blocks of hot nodes: the core against itself and against those that walk on, by the zones that can be linked.

    Sets inside the ball are known to be linked; those that walk on meet each other further down.
    """
    zone = F.when(F.col("inside") & F.col("core"), 0).when(F.col("core") & F.col("near"), 1).when(F.col("core"), 2).when(F.col("near"), 3).otherwise(4)
    zoned = zoned.select("row_no", "leaf", zone.alias("zone"))
    zones = list(_MEETS)
    counts = zoned.groupBy("leaf").pivot("zone", zones).count().na.fill(0)
    chunks = lambda z: F.ceil(F.col(f"`{z}`") / F.lit(float(block))).cast("int")
    sizes = durable(counts.select("leaf", *[chunks(z).alias(f"chunks{z}") for z in zones]))
    placed = zoned.join(sizes.select(apart("leaf"), *[f"chunks{z}" for z in zones]), "leaf")
    # Chunks are numbered zone by zone.
    first = lambda z: sum((F.col(f"chunks{y}") for y in range(z)), F.lit(0))
    by_zone = lambda f: F.coalesce(*[F.when(F.col("zone") == z, f(z)) for z in zones])
    placed = placed.withColumn("chunk", by_zone(first) + F.pmod(F.xxhash64("row_no", "leaf"), by_zone(lambda z: F.col(f"chunks{z}"))).cast("int"))
    none = F.array().cast("array<int>")
    of_zone = lambda z: F.when(F.col(f"chunks{z}") > 0, F.sequence(first(z), first(z) + F.col(f"chunks{z}") - 1)).otherwise(none)
    placed = placed.withColumn("other", F.explode(by_zone(lambda z: F.concat(*[of_zone(y) for y in _MEETS[z]]))))
    return placed.select("row_no", F.col("leaf").alias("name"), F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk")


def jaccard_join(docs: DataFrame, n: int = N_GRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: id, class_id, n_links, n_set_links, text_hash, row_no and class_row.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams
    (lower case, punctuation ignored) is at least the threshold. class_id is the least
    id among all documents reached over links; n_links counts linked documents, copies
    too, and n_set_links counts linked different sets. text_hash (64 bits), row_no and class_row name rows
    where ids repeat; class_row is the row that stands for the class. A text of fewer
    words than n is one n-gram; a null, empty or wordless text is linked with nothing.
    Equal rows are documents of their own that are linked. An empty table gives no rows.
    Other columns are ignored.
    """
    spark, branches = docs.sparkSession, branches_for(threshold)
    signed = durable(signatures(docs, n, runs_for(threshold, recall), branches, id_col, text_col))
    wordless = signed.where("n_set = 0").select("row_no", "id", "text_hash")
    worded = signed.where("n_set > 0")
    prints = worded.select("row_no", "prints")
    groups = durable(worded.groupBy("set_key").agg(F.min("row_no").alias("rep"), F.count(F.lit(1)).alias("weight")))
    weights = groups.select(F.col("rep").alias("row_no"), "weight")
    sketch = F.substring("prints", 1, 4 * SKETCH).alias("sketch")
    # Every level of the walk reads the sets, so they are picked once.
    sets = durable(worded.select("row_no", *[f"keys{k + 1}" for k in range(LEVELS)]).join(weights.select("row_no"), "row_no", "left_semi"))
    reached, hot = leaves(sets, prints, block, branches, threshold)
    sketched = reached.join(worded.select("row_no", "n_set", sketch), "row_no")
    sketched = sketched.repartition(partitions(spark), "leaf").sortWithinPartitions("leaf")
    clusters = sketched.select("leaf", "row_no", "n_set", "sketch").mapInPandas(lambda b: _clusters(b, threshold), "cluster bigint, row_no bigint").distinct()
    to = F.lit(None).cast("struct<leaf:bigint,core:boolean,in_leaf:bigint>")
    at = clusters.select("row_no", F.col("cluster").alias("name"), to.alias("hot"))
    if hot is not None:
        at = at.unionByName(hot.select("row_no", F.col("leaf").alias("name"), F.struct("leaf", "core", "in_leaf").alias("hot")))
    per_set = at.groupBy("row_no").agg(F.array_sort(F.collect_list("name")).alias("all_names"), F.collect_list("hot").alias("hot"))
    needed = durable(per_set.join(weights, "row_no").join(prints, "row_no"))
    small = needed.select("row_no", F.explode(F.array_except("all_names", F.transform("hot", lambda h: h["leaf"]))).alias("name"))
    blocks = small.select("row_no", "name", *[F.lit(0).alias(c) for c in ("low", "high", "chunk")])
    sure = None
    if hot is None:
        content = needed.withColumn("ball", F.lit(0).cast("bigint"))
    else:
        zoned = durable(balls(needed, threshold))
        # A set is in one ball; in hot nodes of other balls it counts as outside.
        home = durable(zoned.where("inside").groupBy("row_no").agg(F.min("ball").alias("home")))
        zoned = zoned.join(home, "row_no", "left").withColumn("near", F.col("near") | F.col("inside")).withColumn("inside", F.col("inside") & (F.col("home") == F.col("ball")))
        blocks = blocks.unionByName(_hot_blocks(durable(zoned.drop("home")), block))
        content = needed.join(home.withColumnRenamed("home", "ball"), "row_no", "left").withColumn("ball", F.coalesce("ball", F.lit(0).cast("bigint")))
        held = home.join(weights, "row_no")
        totals = durable(held.groupBy("home").agg(F.min("row_no").alias("root"), F.sum("weight").alias("in_ball"), F.count(F.lit(1)).alias("sets")))
        sure = held.join(totals.select(apart("home"), "root", "in_ball", "sets"), "home").where("sets > 1")
        sure = sure.select("row_no", "root", (F.col("in_ball") - F.col("weight")).alias("links"), (F.col("sets") - 1).alias("set_links"))
    dealt = durable(blocks).join(content.select("row_no", "weight", "ball", "all_names", F.transform(F.filter("hot", lambda h: ~h["core"]), lambda h: h["leaf"]).alias("walked"), "prints"), "row_no")
    dealt = dealt.repartition(partitions(spark), "name", "low", "high").sortWithinPartitions("name", "low", "high", "row_no")
    found = dealt.mapInPandas(lambda batches: _compare_sorted(batches, threshold), "row_no bigint, root bigint, links bigint, set_links bigint")
    found = durable(found if sure is None else found.unionByName(sure))
    classes = components(found.where("row_no <> root").select(F.col("row_no").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("row_no").agg(F.sum("links").alias("links"), F.sum("set_links").alias("set_links"))
    known = links.join(classes.withColumnRenamed("node", "row_no"), "row_no")
    per_group = groups.join(known.withColumnRenamed("row_no", "rep"), "rep", "left").select(
        "set_key",
        F.coalesce("component", "rep").alias("class_row"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("set_links", F.lit(0)).alias("n_set_links"),
    )
    rows = worded.select("row_no", "id", "text_hash", "set_key").join(per_group, "set_key").drop("set_key")
    rows = rows.unionByName(wordless.select("row_no", "id", "text_hash", F.col("row_no").alias("class_row"), F.lit(0).cast("bigint").alias("n_links"), F.lit(0).cast("bigint").alias("n_set_links")))
    rows = durable(rows)
    least = durable(rows.groupBy("class_row").agg(F.min("id").alias("class_id")))
    return rows.join(least.select(apart("class_row"), "class_id"), "class_row").select(F.col("id").alias(id_col), "class_id", "n_links", "n_set_links", "text_hash", "row_no", "class_row")
