"""Operator 1: exact deduplication against a history of distinct digests.

The history is an index of shards. A shard holds a minimal perfect hash over its
distinct SHA-256 digests; each slot holds the full digest, the locator of the row
that stays (its id and row number) and the size of its group. A lookup computes the
slot and compares all 32 bytes: a match is a repeat of the history and is answered by its
slot, anything else is a nonmember. Nonmembers are grouped by themselves, apart from the
history, and are answered by an index of their own groups.

Shape at scale: a row is 56 bytes once its text has been digested, and texts never
move. Digests are spread evenly over the shards, so building is even. Rows of one
very frequent text all belong to one shard; they are counted per shard first, and a
shard with more rows than its share is copied and its rows are dealt over the copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, durable, partitions, whole_text
from tessera.llm.perfect_hash import MinimalPerfectHash, as_words

#: Distinct digests that a shard holds on average, at most (about 4 MB).
SHARD_KEYS = 65_536
ROW = "digest binary, row_id bigint, row_no bigint"
INDEX = "shard int, n bigint, hash binary, digests binary, keep_ids binary, keep_nos binary, sizes binary, id_nulls binary"


def row_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, row_id, row_no) of each row; row_no tells rows apart whose ids are equal."""
    return docs.select(
        F.unhex(F.sha2(whole_text(text_col).cast("binary"), 256)).alias("digest"),
        F.col(id_col).cast("bigint").alias("row_id"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the winner (largest id, then row number) and the group's size."""
    best = F.max(F.struct("row_id", "row_no"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.row_id").alias("keep_id"), F.col("best.row_no").alias("keep_no"), "group_size"
    )


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _whole(column: pa.ChunkedArray) -> np.ndarray:
    """64-bit integers, which pandas would make floats where some are null; null counts as 0."""
    return column.fill_null(0).to_numpy().astype(np.int64)


def _digest_words(column: pa.ChunkedArray) -> np.ndarray:
    return as_words(column.to_pylist())


def build_index(winners: DataFrame, shards: int) -> DataFrame:
    """A row per shard that holds the perfect hash and the slots of its digests."""

    def build(key, rows):
        words = _digest_words(rows["digest"])
        mph = MinimalPerfectHash.build(words)
        order = np.argsort(mph.slots(words))
        column = lambda name: _whole(rows[name])[order].astype("<i8").tobytes()
        nulls = rows["keep_id"].is_null().to_numpy()[order].astype(np.uint8).tobytes()
        slots = {"hash": mph.pack(), "digests": words[order].tobytes(), "keep_ids": column("keep_id"), "keep_nos": column("keep_no"), "sizes": column("group_size"), "id_nulls": nulls}
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(words)], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in slots.items()})

    return winners.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, INDEX)


def probe(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Each row with its slot's keep_id, keep_no and group_size; all null for a nonmember.

    Rows are dealt by (shard, copy). The number of copies of a shard follows the
    counted rows of that shard, so that no task gets much more than its share.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("shard", _shard(shards))
    counted = rows.groupBy("shard").count()
    mean = F.greatest(F.lit(1.0), F.sum("count").over(Window.partitionBy()) / F.lit(max(shards, partitions(spark))))
    plan = durable(counted.select("shard", F.greatest(F.lit(1), F.ceil(F.col("count") / mean).cast("int")).alias("copies")))
    plan = broadcast_if_small(plan, shards)
    dealt = rows.join(plan, "shard").withColumn("copy", F.pmod(F.xxhash64("row_no"), F.col("copies")).cast("int"))
    spread = index.join(plan, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def look(key, left, right):
        words = _digest_words(left["digest"])
        same, at, slots, nulls = np.zeros(len(words), bool), np.zeros(len(words), np.int64), {}, np.zeros(1, bool)
        if len(right) and len(words):
            held = {c: right[c][0].as_py() for c in ("hash", "digests", "keep_ids", "keep_nos", "sizes", "id_nulls")}
            kept = np.frombuffer(held["digests"], "<u8").reshape(-1, 4)
            slot = MinimalPerfectHash.unpack(held["hash"]).slots(words)
            at = np.maximum(slot, 0)
            same = (slot >= 0) & (kept[at] == words).all(axis=1)
            slots = {c: np.frombuffer(held[c], "<i8")[at] for c in ("keep_ids", "keep_nos", "sizes")}
            nulls = (np.frombuffer(held["id_nulls"], np.uint8) == 1)[at]
        none = np.zeros(len(words), np.int64)
        found = lambda c, missing: pa.array(slots.get(c, none), pa.int64(), mask=missing)
        out = left.select(["digest", "row_id", "row_no"])
        out = out.append_column("keep_id", found("keep_ids", ~same | nulls))
        return out.append_column("keep_no", found("keep_nos", ~same)).append_column("group_size", found("sizes", ~same))

    return (
        dealt.drop("copies")
        .groupBy("shard", "copy")
        .cogroup(spread.drop("copies").groupBy("shard", "copy"))
        .applyInArrow(look, f"{ROW}, keep_id bigint, keep_no bigint, group_size bigint")
    )


def absorb(history: DataFrame, index: DataFrame, incoming: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The history with the counts of a batch's repeats added, and the groups of the batch's nonmembers.

    ``incoming`` has one row per distinct digest of the batch. A repeat adds its count to the
    slot it matches, whose winner stays; nonmembers stand as groups of their own.
    """
    keys = incoming.select("digest", F.col("keep_id").alias("row_id"), F.col("keep_no").alias("row_no"))
    found = probe(keys, index, shards).select("digest", F.col("keep_no").isNotNull().alias("member"))
    batch = durable(incoming.join(found, "digest"))
    more = batch.where("member").select("digest", F.col("group_size").alias("more"))
    grown = history.join(more, "digest", "left").withColumn("group_size", F.col("group_size") + F.coalesce("more", F.lit(0))).drop("more")
    return grown, batch.where("not member").drop("member")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history_share: float = 0.5) -> DataFrame:
    """One row per document, dropped ones too: its group, the row of it that stays, and the digest.

    Columns: ``id_col``, keep_id, group_size, kept, text_sha256.
    Texts are equal when identical; null counts as empty. Of equal texts the row with
    the largest id stays, of equal ids too exactly one row. A null id is the smallest.
    An empty table gives no rows. Other columns are ignored. Rows are taken from the
    largest ids down: the upper ``history_share`` of the id range is the history, the
    rest is a batch looked up in it, so a winner in the history is never displaced.
    """
    spark = docs.sparkSession
    rows = durable(row_digests(docs, id_col, text_col))
    low, high, n = rows.agg(F.min("row_id"), F.max("row_id"), F.count(F.lit(1))).first()
    cut = high - int((high - low) * history_share) if n and high is not None else 0
    old = F.coalesce(F.col("row_id") >= F.lit(cut), F.lit(False))
    shards = max(partitions(spark), -(-n // SHARD_KEYS))
    history = durable(group_digests(rows.where(old)))
    incoming = durable(group_digests(rows.where(~old)))
    grown, fresh = absorb(history, build_index(history, shards), incoming, shards)
    looked_up = durable(probe(rows, build_index(grown, shards), shards))
    nonmembers = looked_up.where("keep_no is null").select("digest", "row_id", "row_no")
    found = looked_up.where("keep_no is not null").unionByName(probe(nonmembers, build_index(fresh, shards), shards))
    return found.select(
        F.col("row_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row_no") == F.col("keep_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
