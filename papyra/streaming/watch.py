"""Watched folders and backfills as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyra.operators import store
from papyra.sources import files

WATCH_SECONDS = 45
_BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New files below a folder as a stream of (path, sha256, mtime, length, reader, content)."""
    found = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return found.select("path", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").cast("double").alias("mtime"), "length", files.reader("path").alias("reader"), "content").where("reader is not null")


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, seconds: int | None = WATCH_SECONDS, index: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Index what arrives in ``folder`` into the Parquet table at ``table`` (path, sha256, mtime, text, engine, status).

    Each batch is compared to the table: unchanged files and copies of indexed
    contents are noted, not read. A batch that runs again after a failure
    writes its own folder again, so nothing is doubled. ``index`` is called with the new
    rows. With ``seconds`` None all present files are indexed, then the query ends.
    """
    columns = "path string, sha256 string, mtime double, text string, engine string, status string, batch long"

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        try:
            known = session.read.schema(columns).parquet(table).where(F.col("batch") != number)
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = session.createDataFrame([], columns)
        known = known.groupBy("path").agg(F.max_by(F.struct("sha256", "mtime", "status"), "batch").alias("r")).select("path", "r.*")
        status = store.new_files(batch.select("path", "sha256", "mtime"), known)
        fresh = batch.join(status.where("status = 'new'").select("path"), "path", "left_semi")
        texts = files.whole_texts(files.pages(fresh))
        rows = status.join(texts, "path", "left").withColumn("status", F.when(F.col("status") != "new", F.col("status")).when(F.trim(F.coalesce("text", F.lit(""))) == "", "needs_ocr").otherwise("indexed"))
        rows.where("status <> 'unchanged'").select("path", "sha256", "mtime", "text", "engine", "status").write.mode("overwrite").parquet(f"{table}/batch={number}")
        if index:
            index(session.read.schema(columns).parquet(f"{table}/batch={number}"))

    out = arriving(spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if seconds is None else out.trigger(processingTime=f"{seconds} seconds")).start()


def backfill(spark: SparkSession, chunks: str, out: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], files_per_batch: int = 32) -> StreamingQuery:
    """Embed the chunks of a Parquet folder some files at a time, until all are done; a restart goes on where it stopped."""
    schema = spark.read.parquet(chunks).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(chunks)

    def take(batch: DataFrame, number: int) -> None:
        embed(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_contents(stream: DataFrame, content: str = "sha256") -> DataFrame:
    """The first row of each content; the state is one hash a content."""
    return stream.dropDuplicates([content])
