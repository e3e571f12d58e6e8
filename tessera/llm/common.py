"""What the corpus operators share: reading, durable cuts of lineage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows (of a few fixed-width columns) that an operator broadcasts, after counting them.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, or the folder set on its context.

    Only a local master, where all is one machine, may do without: it gets a temporary folder.
    On a cluster executors would not find each other's files there, so that is refused.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known is None and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return known or tempfile.mkdtemp(prefix="tessera-")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage with a Parquet table in the shared folder: the table and its path, for ``remove`` when it has served."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark wrote it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def apart(key: str) -> Column:
    """The key as Spark doesn't know it, so that a checkpointed side is shuffled with the other one.

    Only where both sides of a join come straight from a shuffle can Spark split a key with very many rows.
    """
    return F.col(key).bitwiseXOR(F.lit(0)).alias(key)


def broadcast_if_small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the counted rows are within the bound; otherwise Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def map_rows(df: DataFrame, run, schema: str, rows: int = 500) -> DataFrame:
    """mapInArrow with small pandas frames: ``run`` gets an iterator of them and yields frames of ``schema``.

    An Arrow batch of long texts is cut into slices of ``rows`` rows before it becomes Python
    strings, so a worker holds the strings of one slice only. Whole numbers stay whole where
    some are null.
    """

    def apply(batches):
        import pandas as pd
        import pyarrow as pa

        whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}

        def slices():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows).to_pandas(types_mapper=whole.get)

        for made in run(slices()):
            yield pa.RecordBatch.from_pandas(made[names], schema=arrow, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names, arrow = kinds.names, to_arrow_schema(kinds)
    return df.mapInArrow(apply, kinds)
