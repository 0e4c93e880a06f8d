"""The queries p1, p3, p4, p5 and p6 over the tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.keys import key_form
from strandweave.operators.annotation_lines import parse_lines
from strandweave.operators.coverage import merge_intervals
from strandweave.operators.key_totals import frequent_keys, key_totals
from strandweave.operators.references import orphan_references, orphans_by_period
from strandweave.operators.widen import cell_faults, read_definitions, widen
from strandweave.session import table


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return widen(table(spark, d, "gtf_attributes"), table(spark, d, "gtf_attribute_defs"), "line_no")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    single = [a.key for a in read_definitions(table(spark, d, "gtf_attribute_defs")) if not a.is_multi]
    return cell_faults(_wide(spark, d), "line_no", single)


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table; arrays are joined to strings and dates written out, so that any engine can compare them."""
    wide = _wide(spark, d).drop("faults")
    shown = {"array<string>": lambda c: F.array_join(c, "|").alias(c), "date": lambda c: F.col(c).cast("string").alias(c)}
    return wide.select(*[shown.get(t, F.col)(c) for c, t in wide.dtypes])


def _totals(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    entries, fasta = table(spark, d, "gtf_entries"), table(spark, d, "fasta_entries")
    span = F.when(F.col("end_pos") >= F.col("start_pos"), F.col("end_pos") - F.col("start_pos") + 1)
    by_chromosome = entries.select(key_form("chromosome").alias("key"), span.alias("length"), "loaded_at")
    by_name = fasta.select(key_form("name").alias("key"), F.char_length("sequence").alias("length"), "loaded_at")
    return [("gtf_entries", key_totals(by_chromosome, "key", "length", "loaded_at")), ("fasta_entries", key_totals(by_name, "key", "length", "loaded_at"))]


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    (a, x), (b, y) = _totals(spark, d)
    return x.select(F.lit(a).alias("table_name"), "*").unionByName(y.select(F.lit(b).alias("table_name"), "*"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    (a, x), (b, y) = _totals(spark, d)
    named = lambda name, totals: frequent_keys(totals, 1 / 20).select(F.lit(name).alias("table_name"), "key_value")
    return named(a, x).unionByName(named(b, y))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "gtf_lines"), "raw_no", "line")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where(F.col("reason").isNotNull()).select("raw_no", "reason")


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    """The loaded entries; of the attributes the gene's id, so that any engine can compare them."""
    good = _parsed(spark, d).where(F.col("reason").isNull()).drop("reason")
    return good.withColumn("gene_id", F.col("attributes")["gene_id"]).drop("attributes")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "gtf_entries").select(
        "line_no", "loaded_at", F.col("gene_id").alias("genes"), F.col("transcript_id").alias("transcripts"), F.col("chromosome").alias("chromosomes")
    )
    parents = {
        name: table(spark, d, name).select(key, "added_at", "removed_at")
        for name, key in (("genes", "gene_id"), ("transcripts", "transcript_id"), ("chromosomes", "chromosome"))
    }
    return orphan_references(refs, parents, "line_no", "loaded_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("line_no", "ref_table", F.date_format("loaded_at", "yyyy-MM").alias("loaded_month"), "fault")


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, d), "loaded_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "gtf_entries")
    exons = entries.where(F.lower(F.trim("feature")) == "exon").select(key_form("transcript_id").alias("transcript_id"), "start_pos", "end_pos")
    return merge_intervals(exons, "transcript_id", "start_pos", "end_pos")


QUERIES = {f.__name__: f for f in (p1_found, p1_wide, p3_found, p3_totals, p4_found, p4_entries, p5_found, p5_by_month, p6_found)}
