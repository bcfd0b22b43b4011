"""Incremental ingest: arriving rows are kept once, and signed counts of references and rows are carried on per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.operators import references as R
from quillmill.operators.documents import text_facts


def stream_table(spark: SparkSession, folder: str, like: DataFrame, max_files: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the schema of ``like``."""
    r = spark.readStream.schema(like.schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def arrivals_per_window(stream: DataFrame, time: str = "loaded_at", window: str = "1 day", late: str = "90 days") -> DataFrame:
    """(window_start, kind, n) with a watermark: rows later than ``late`` no longer count."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")


def first_deliveries(stream: DataFrame, key: str, time: str = "loaded_at", late: str = "365 days") -> DataFrame:
    """Each key once while its first delivery is within the watermark."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def ingest_documents(stream: DataFrame, target: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Append the text facts of new documents to a Parquet table, one batch after another, and stop when all is read."""

    def put(batch: DataFrame, number: int) -> None:
        text_facts(batch, key, text).withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete", before: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    s = before(stream) if before else stream
    return s.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_counts(stream: DataFrame, state: str, checkpoint: str, refs_of: Callable[[DataFrame], DataFrame] | None = None, lives_of: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Carry the signed counts of references and existing rows on in the folder ``state``, one table per batch.

    ``refs_of`` and ``lives_of`` give the references (space, key, ...) and lifetimes (space, key, loaded_at, deleted_at) of
    the arriving rows. Each batch is written beside the counts it started from, so a batch that is repeated after a
    failure counts once; ``counts_at`` reads the last one.
    """

    def put(batch: DataFrame, number: int) -> None:
        change = R.signed_counts(refs_of(batch) if refs_of else None, lives_of(batch) if lives_of else None)
        before = counts_at(batch.sparkSession, state, number)
        (change if before is None else R.add_counts(before, change)).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_at(spark: SparkSession, state: str, before: int | None = None) -> DataFrame | None:
    """The counts after the last finished batch (of those below ``before``)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(state)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    done = [int(f.getPath().getName().removeprefix("batch=")) for f in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    done = [n for n in done if before is None or n < before]
    return spark.read.parquet(f"{state}/batch={max(done)}") if done else None
