"""Run a stream into a folder that can be read as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType


def batch_path(out: str, batch_id: int) -> str:
    return f"{out}/batch={batch_id}"


def start(
    stream: DataFrame,
    out: str,
    mode: str = "append",
    each: Callable[[DataFrame, int], None] | None = None,
    drain: bool = True,
) -> StreamingQuery:
    """Write every micro-batch to its own folder below ``out``.

    A repeated batch overwrites its own folder, so each result is there once.
    ``drain`` works off what is there and stops; otherwise the query runs on.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_path(out, batch_id))

    writer = stream.writeStream.outputMode(mode).foreachBatch(each or save)
    writer = writer.option("checkpointLocation", f"{out}-checkpoint")
    return (writer.trigger(availableNow=True) if drain else writer).start()


Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def known_path(out: str, batch_id: int) -> str:
    return f"{out}/_known/batch={batch_id}"


def folded(stream: DataFrame, out: str, step: Step, drain: bool = True) -> StreamingQuery:
    """Run ``step(batch, known) -> (results, known)`` on every micro-batch.

    What the next batch has to know is written beside the results; the first one knows
    nothing (None). A repeated batch starts from the same rows and replaces both, so any
    batch job over "what is known and what came" is a stream that survives its executors.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(known_path(out, batch_id - 1)) if batch_id else None
        batch = batch.persist()
        results, after = step(batch, known)
        results.write.mode("overwrite").parquet(batch_path(out, batch_id))
        after.write.mode("overwrite").parquet(known_path(out, batch_id))
        batch.unpersist()
        if batch_id > 1:
            remove(spark, known_path(out, batch_id - 2))

    return start(stream, out, each=save, drain=drain)


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def logged(stream: DataFrame, out: str, step: Callable[[DataFrame, DataFrame | None], DataFrame], drain: bool = True) -> StreamingQuery:
    """Run ``step(batch, results so far) -> results`` on every micro-batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        before = batch.sparkSession.read.parquet(out).filter(F.col("batch") < batch_id) if batch_id else None
        batch = batch.persist()
        step(batch, before).write.mode("overwrite").parquet(batch_path(out, batch_id))
        batch.unpersist()

    return start(stream, out, each=save, drain=drain)


def finished(spark: SparkSession, query: StreamingQuery, out: str) -> DataFrame:
    """Results of a query that drains its stream, with the ``batch`` that wrote them."""
    query.awaitTermination()
    return spark.read.parquet(out)


def collected(spark, out: str, schema: StructType) -> DataFrame:
    """All results so far, with the ``batch`` that wrote them."""
    return spark.read.schema(StructType(schema.fields).add("batch", LongType())).parquet(out)


def drained(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Work off what is there and return the results as a table."""
    start(stream, out, mode).awaitTermination()
    return collected(stream.sparkSession, out, stream.schema)
