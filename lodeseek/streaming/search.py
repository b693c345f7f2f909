"""Searches over files as they arrive. Every generator is stateless, so no watermark or state store is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import search
from ..plans.conditions import SearchConditions


def arriving(spark: SparkSession, path: str, schema: str, path_column: str, text_column: str, fmt: str = "parquet", most_files: int = 100) -> DataFrame:
    """files(path, text) of the tables that land in a folder."""
    from pyspark.sql import functions as F

    df = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", most_files).load(path)
    return df.select(F.col(path_column).cast("string").alias("path"), F.col(text_column).alias("text"))


def hits(files: DataFrame, conditions: SearchConditions) -> DataFrame:
    """The same search, over a stream: hits are appended as files come in."""
    return search.search(files, conditions)


def to_table(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append hits to a Parquet folder, exactly once."""
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def each_batch(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch of hits to a function."""
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Calls back with the rows seen so far."""

    def __init__(self, tell: Callable[[int], None]):
        self.tell, self.seen = tell, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.seen += event.progress.numInputRows or 0
        self.tell(self.seen)

    def onQueryTerminated(self, event) -> None:
        pass


def cancellable(spark: SparkSession, tag: str):
    """Jobs that are started under the tag can be cancelled with spark.interruptTag(tag) or cancelJobsWithTag."""
    spark.sparkContext.addJobTag(tag)
    return lambda: spark.sparkContext.cancelJobsWithTag(tag)
