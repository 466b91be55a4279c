"""Running word counts over a stream of reads, with the batch operators' expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.sequences import windows
from tessera.operators.filters import valid_bases


def read_stream(spark: SparkSession, path: str, schema: str = "run string, read_id long, seq string", files_per_batch: int = 16) -> DataFrame:
    """Reads from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """``run, kmer, n`` so far; state is one number per run and word."""
    words = reads.where(valid_bases(seq)).select("run", F.explode(windows(seq, k)).alias("kmer"))
    return words.groupBy("run", "kmer").agg(F.count(F.lit(1)).alias("n"))


def write_counts_stream(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the counts that each batch changed, under its number; a repeated batch replaces its folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of each word from what :func:`write_counts_stream` wrote."""
    rows = spark.read.parquet(path)
    return rows.groupBy("run", "kmer").agg(F.max_by("n", "batch").alias("n"))
