"""Streams of reads: cutting and correcting barcodes as files arrive, and counts that tolerate late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.layouts import Chemistry

SCHEMA = "read_index bigint, name string, sequence string, quality string, at timestamp"
#: The whitelist rows up to which the stream's lookup table is broadcast; beyond, Spark joins it by shuffle.
SMALL_WHITELIST = 200_000


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Reads from Parquet files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def barcodes(reads: DataFrame, layout: Chemistry, whitelist: DataFrame, column: str) -> DataFrame:
    """The stream with ``barcode``, ``umi`` and ``corrected`` of single-read layouts: exact members, which a static join
    gives without state. Reads whose barcode isn't a member have a null there."""
    cut = layout.parse([F.col("sequence")], concatenate=True)
    known = whitelist.select(F.upper(column).alias("corrected")).distinct()
    parsed = reads.withColumns({"barcode": cut["cell_barcode"], "umi": cut["umi"]})
    side = F.broadcast(known) if known.limit(SMALL_WHITELIST + 1).count() <= SMALL_WHITELIST else known
    return parsed.join(side, parsed.barcode == side.corrected, "left")


def counts_by_window(parsed: DataFrame, window: str = "1 minute", lateness: str = "5 minutes") -> DataFrame:
    """(window_start, corrected, n_reads, n_umis): reads and distinct UMIs per barcode and event-time window.

    Rows later than ``lateness`` are no longer counted. Repeated reads (name and time) within it count once.
    """
    once = parsed.where(F.col("corrected").isNotNull()).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["name"])
    grouped = once.groupBy(F.window("at", window), "corrected").agg(F.count(F.lit(1)).alias("n_reads"), F.approx_count_distinct("umi").alias("n_umis"))
    return grouped.select(F.col("window.start").alias("window_start"), "corrected", "n_reads", "n_umis")
