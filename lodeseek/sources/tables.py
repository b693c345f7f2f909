"""Tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_table(df: DataFrame, path: Column, text: str) -> DataFrame:
    """Any table with a text column as files(path, text)."""
    return df.select(path.cast("string").alias("path"), F.col(text).alias("text"))


def relative(path: Column, root: Column) -> Column:
    """The path below root; the whole path where it does not lie there."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


def spread(df: DataFrame) -> DataFrame:
    """df on all cores: a scan of fewer partitions than there are cores, such as one small file, is dealt out; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
