"""Incremental ingest: files that arrive in a folder, parsed once each, with progress and cancellation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import facts


def arriving(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """doc_id, path, length, content, modified of each new file. Stateless, so any trigger works."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", per_trigger).load(path)
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content", F.col("modificationTime").alias("modified"))


def once_each(files: DataFrame, within: str = "1 day") -> DataFrame:
    """One file of each content; the state forgets contents older than the watermark."""
    keyed = files.withColumn("sha256", F.sha2("content", 256)).withWatermark("modified", within)
    return keyed.dropDuplicatesWithinWatermark(["sha256"])


def profile_stream(files: DataFrame, out: str, checkpoint: str, *sections: str) -> StreamingQuery:
    """Parse files as they arrive and append their facts to a Parquet table."""
    return facts(files, *sections).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The frame with a count of rows and failures that is known once it was written, without another pass."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("files"), F.count_if(F.col("status") != "ok").alias("failed")), seen


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop what runs under the tag (spark.addTag); nothing partial is committed."""
    spark.interruptTag(tag)
