"""Row metrics, histories and dedupes: what a results table needs beyond the hits."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import checkpoint_folder


def display_lines(text: Column) -> Column:
    """Lines that a cell takes: one more than its line ends."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def row_units(hit: list[str]) -> Column:
    """Height of a row in lines: its tallest cell."""
    return F.greatest(*[display_lines(F.col(c)) for c in hit]) if len(hit) > 1 else display_lines(F.col(hit[0]))


class Heights:
    """Rows of a table in one order, each with its top and bottom: running sums of heights over everything.

    Rows are dealt out by ranges of the order and summed up within each range; what stands above a range is added from
    a table of one row for each range, the page index. Ranges are written as folders, so that a lookup reads the one
    that it needs. A null height is 0; rows that are equal in the order stand in any sequence, but in one that stays."""

    def __init__(self, rows: DataFrame, order: list[str], units: str = "units"):
        spark = rows.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tied = rows.withColumn("__tie", F.monotonically_increasing_id())
        ranged = tied.repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie").withColumn("page", F.spark_partition_id())
        path = f"{checkpoint_folder(spark)}/heights-{uuid.uuid4().hex}"
        ranged.write.partitionBy("page").parquet(path)
        kept = spark.read.schema(ranged.schema).parquet(path)
        height = F.coalesce(F.col(units), F.lit(0)).cast("long")
        self.pages = kept.groupBy("page").agg(F.sum(height).alias("height")).withColumn("above", F.coalesce(F.sum("height").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        within = Window.partitionBy("page").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # one row for each of n ranges
        summed = kept.withColumn("__sum", F.sum(height).over(within)).join(F.broadcast(self.pages.select("page", "above")), "page")
        bottom = F.col("above") + F.col("__sum")
        self.rows = summed.select(*rows.columns, "page", (bottom - height).alias("top"), bottom.alias("bottom"))

    def between(self, first: int, beyond: int) -> DataFrame:
        """The rows that a view from one offset up to another shows, and no others; reads only the ranges that they stand in."""
        pages = [r["page"] for r in self.pages.where((F.col("above") < beyond) & (F.col("above") + F.col("height") > first)).select("page").collect()]
        return self.rows.where(F.col("page").isin(pages) & (F.col("top") < beyond) & (F.col("bottom") > first)).drop("page")

    def row_at(self, offset: int) -> DataFrame:
        """The row that stands at a scroll offset: the first whose bottom lies beyond it."""
        return self.between(offset, offset + 1)


def keep_first(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def recent(history: DataFrame, pattern: str, at: str, most: int = 30) -> DataFrame:
    """The latest use of each pattern, newest first."""
    return history.groupBy(pattern).agg(F.max(at).alias(at)).orderBy(F.desc(at), pattern).limit(most)


def shortened(text: Column, most: int, kept: int, front: bool = False, mark: str = "...") -> Column:
    """Texts over most characters: their last (front) or first kept characters and a mark."""
    cut = F.concat(F.lit(mark), F.substring(text, -kept, kept)) if front else F.concat(F.substring(text, 1, kept), F.lit(mark))
    return F.when(F.length(text) > most, cut).otherwise(text)


def path_label(path: Column) -> Column:
    return shortened(path, 40, 37, front=True)


def hint_label(hint: Column) -> Column:
    return shortened(hint, 28, 25, mark="…")


def bytes_cut(text: Column, most: int = 32_000) -> Column:
    """At most so many bytes of UTF-8, without cutting a character."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    # up to three bytes of a cut character may hang over
    whole = F.coalesce(*[F.try_validate_utf8(F.substring(raw, F.lit(1), F.lit(most - k)).cast("string")) for k in range(4)])
    return F.when(F.octet_length(text) > most, whole).otherwise(text)


def clipped(ranges: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """Ranges in order of start, each begun where the ones before it have ended; those without rest are dropped."""
    w = Window.partitionBy(group).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.withColumn("__done", F.coalesce(F.max(end).over(w), F.lit(0)))
    return out.withColumn(start, F.greatest(start, "__done")).where(F.col(start) < F.col(end)).drop("__done")


def expand_tabs(text: Column, width: int = 4) -> Column:
    """Tabs as blanks up to the next multiple of width, by column within the line."""

    @F.pandas_udf("string")
    def expanded(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t.expandtabs(width) if t is not None else None)

    return F.when(F.contains(text, F.lit("\t")), expanded(text)).otherwise(text)
