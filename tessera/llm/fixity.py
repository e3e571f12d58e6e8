"""Operator 6: Merkle fixity audit of replicas of a WARC archive.

The primary's records get a place, an offset and a length in one fixed order, and a tree
over them: a leaf is the SHA-256 of a record with its offset range, an inner node that of
its ``FANOUT`` children in order with the range they cover. A replica's records are put at
the places of the primary's list and hashed into a tree of the same shape. Only the roots
are compared at first; where nodes differ, the audit goes down to their children, level by
level, and ends at the records that are altered or missing. Records that only the replica
has are in no tree; the join that puts the others at their places tells them apart. The
order of a replica's own records is not compared.

Shape at scale: record bytes are hashed where they are read. What moves is a digest per
record, and 1/FANOUT of that per level. Places and offsets are prefix sums over range
partitions, so no task sees more than its part of the order, however many records are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, durable, partitions

FANOUT = 64
#: Digest of a record that a replica lacks.
MISSING = "-"


def warc_record(url: Column, body: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """The bytes of a WARC/1.1 response record; null fields count as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    name = F.md5(F.concat(url, F.lit("\n"), body).cast("binary"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:md5:"), name, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def record_list(records: DataFrame, keys: list[str], record_col: str = "record") -> DataFrame:
    """(keys, copy, pos, offset, length, digest) of the primary, in the order of the keys.

    Rows of equal keys are told apart by ``copy``, which numbers them by their digests.
    """
    spark = records.sparkSession
    body = F.coalesce(F.col(record_col), F.lit("")).cast("binary")
    plain = records.select(*keys, F.octet_length(body).cast("bigint").alias("length"), F.sha2(body, 256).alias("digest"))
    order = [F.col(k).asc_nulls_first() for k in keys] + [F.col("digest"), F.xxhash64(F.monotonically_increasing_id())]
    placed = durable(plain.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order))
    row = F.monotonically_increasing_id()
    placed = placed.withColumn("part", F.shiftright(row, 33).cast("int")).withColumn("nth", row.bitwiseAND((1 << 33) - 1))
    totals = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("length").alias("bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"))
    inside = Window.partitionBy("part").orderBy("nth")
    placed = placed.withColumn("end", F.sum("length").over(inside)).join(F.broadcast(bases), "part")
    listed = placed.select(*keys, (F.col("row0") + F.col("nth")).alias("pos"), (F.col("byte0") + F.col("end") - F.col("length")).alias("offset"), "length", "digest")
    return durable(_number_copies(listed, keys, "pos"))


def _number_copies(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``copy``: 0 for a key that one row has; rows of a repeated key are numbered by digest."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    repeated = durable(counted.where("_n > 1").drop("_n"))
    if repeated.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("bigint"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    flagged = rows.alias("a").join(repeated.withColumn("_again", F.lit(True)).alias("b"), on, "left").select("a.*", "_again")
    single = flagged.where("_again is null").drop("_again").withColumn("copy", F.lit(0).cast("bigint"))
    # Equal records are interchangeable, so a copy is named by its digest and its number among equal digests;
    # those numbers are dealt per partition of the input and need no ordering of a whole key.
    many = durable(flagged.where("_again").drop("_again").withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "digest", "_part").orderBy(order)
    many = many.withColumn("_own", F.row_number().over(own))
    sizes = many.groupBy(*keys, "digest", "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("digest", "_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    names = [*keys, "digest", "_part"]
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names]
    numbered = many.alias("a").join(sizes.alias("b"), on).select("a.*", "_base")
    return single.unionByName(numbered.withColumn("copy", F.col("_base") + F.col("_own") - 1).drop("_part", "_own", "_base"))


def tree(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves (idx, start, stop, hash) up to one root; each is a table of its own."""
    node = F.sha2(F.concat_ws(":", "start", "stop", "digest").cast("binary"), 256)
    levels = [durable(leaves.select(F.col("pos").alias("idx"), "start", "stop", node.alias("hash")))]
    while levels[-1].count() > 1:
        child = F.struct("idx", "start", "stop", "hash")
        grouped = levels[-1].groupBy(F.floor(F.col("idx") / fanout).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        joined = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["start"], c["stop"], c["hash"])), ",")
        levels.append(
            durable(
                grouped.select(
                    F.col("up").alias("idx"),
                    F.element_at("children", 1)["start"].alias("start"),
                    F.element_at("children", -1)["stop"].alias("stop"),
                    F.sha2(joined.cast("binary"), 256).alias("hash"),
                )
            )
        )
    return levels


def mismatches(primary: list[DataFrame], replica: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(idx) of the leaves that differ, reached through differing nodes only."""
    wrong = None
    for own, other in zip(reversed(primary), reversed(replica), strict=True):
        other = other.select(F.col("idx").alias("_idx"), F.col("hash").alias("_hash"))
        level = own
        if wrong is not None:
            below = F.floor(F.col("idx") / fanout) == F.col("_up")
            level = own.join(wrong.withColumnRenamed("idx", "_up"), below, "left_semi")
        wrong = durable(level.join(other, F.col("idx") == F.col("_idx"), "left").where("_hash is null or hash <> _hash").select("idx"))
        n = wrong.count()
        if not n:
            return wrong
        wrong = broadcast_if_small(wrong, n)
    return wrong


def audit(primary: DataFrame, replica: DataFrame, keys: list[str], record_col: str = "record", fanout: int = FANOUT, added: bool = False) -> DataFrame:
    """One row per record of the primary that the replica has wrong or lacks, and with ``added`` per record that only the replica has.

    Columns: the keys, copy, pos, offset, length, replica_length and state (altered,
    resized or missing). Records of the replica that the primary lacks, further copies of
    one that it has among them, are ignored unless ``added`` is true: then their state is
    added, and they have no pos, offset and length. Null records count as empty; null keys are keys like others
    and come first; rows of equal keys are copies, numbered by digest; an empty primary
    gives no others than added rows, an empty replica lacks everything. Other columns are ignored.
    """
    listed = record_list(primary, keys, record_col)
    body = F.coalesce(F.col(record_col), F.lit("")).cast("binary")
    held = replica.select(*keys, F.octet_length(body).cast("bigint").alias("replica_length"), F.sha2(body, 256).alias("digest"))
    held = _number_copies(held.withColumn("_row", F.monotonically_increasing_id()), keys, "_row").drop("_row").withColumnRenamed("digest", "replica_digest")
    names = [*keys, "copy"]
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names]
    named = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in names]
    joined = listed.alias("a").join(held.alias("b"), on, "full" if added else "left")
    every = durable(joined.select(*named, "pos", "offset", "length", "digest", "replica_length", F.coalesce("replica_digest", F.lit(MISSING)).alias("replica_digest")))
    both = every.where("pos is not null")
    stop = F.col("offset") + F.col("length")
    mine = tree(both.select("pos", F.col("offset").alias("start"), stop.alias("stop"), "digest"), fanout)
    theirs = tree(both.select("pos", F.col("offset").alias("start"), stop.alias("stop"), F.col("replica_digest").alias("digest")), fanout)
    wrong = mismatches(mine, theirs, fanout)
    state = F.when(F.col("replica_digest") == MISSING, "missing").when(F.col("replica_length") != F.col("length"), "resized").otherwise("altered")
    shown = [*keys, "copy", "pos", "offset", "length", "replica_length"]
    found = both.join(wrong.withColumnRenamed("idx", "pos"), "pos", "left_semi").select(*shown, state.alias("state"))
    return found.unionByName(every.where("pos is null").select(*shown, F.lit("added").alias("state"))) if added else found


def damaged(records: DataFrame, keys: list[str], record_col: str = "record") -> DataFrame:
    """A replica as years of storage leave it, the same at every run: of 64 records about three are altered, cut or lost.

    The md5 of a record's keys decides: 0 of 64 is lost, 1 loses its last byte, 2 has its
    first letter replaced.
    """
    named = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    fate = F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("bigint") % 64
    body = F.col(record_col)
    hit = F.when(fate == 1, F.substring(body, F.lit(1), F.length(body) - 1)).when(fate == 2, F.concat(F.lit("X"), F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
    return records.where(fate != 0).withColumn(record_col, hit)
