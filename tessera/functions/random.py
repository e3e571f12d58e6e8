"""Uniform numbers that depend on their labels only, not on partitions or order of rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(stream: str, *labels: Column) -> Column:
    """In [0, 1): the first 32 bits of md5('stream-label-label...')."""
    name = F.concat_ws("-", F.lit(stream), *[x.cast("string") for x in labels])
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
