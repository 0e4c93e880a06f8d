"""From files to files: reads to unmapped records, and records that keep the header of the file they come from.

What is written is a folder of parts in the order of the records; read again, the parts are the files of one table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from strandweave.operators import records
from strandweave.sources import bam, sam
from strandweave.sources.text import files_of


def group_header(group: str, sample: str | None = None) -> str:
    """The header lines of unmapped records of a read group."""
    return f"{sam.HEADER}\n@RG\tID:{group}" + (f"\tSM:{sample}" if sample else "")


def header_like(path: str) -> str:
    """The header lines of a SAM or BAM file, or of the first part of a folder."""
    first = files_of(path)[0]
    return bam.header_of(first) if first.endswith(".bam") else sam.header_of(first)


def write_records(rows: DataFrame, out: str, header: str, kind: str = "bam") -> str:
    """Write records, with the header lines, as a folder of ``kind`` (bam or sam); its path."""
    rows.drop("file_no", "file").write.format(kind).mode("append").option("header", header).save(out)
    return out


def write_like(rows: DataFrame, source: str, out: str, kind: str = "bam") -> str:
    """Write records (applied, filtered or split ones) with the header of the file that they come from."""
    return write_records(rows, out, header_like(source), kind)


def fastq_to_bam(spark: SparkSession, fastq: str, out: str, name: str | None = None) -> str:
    """The reads of a file as unmapped records of a read group; a random name is made up without one."""
    group = name or uuid.uuid4().hex
    reads = spark.read.format("fastq").load(fastq)
    return write_records(records.reads_to_records(reads, group), out, group_header(group, group))


def fastqs_to_bam(spark: SparkSession, fastqs: list[str], record: Column, out: str, name: str | None = None) -> str:
    """The records that a struct expression makes of the zipped ``reads`` of several files, nulls left out, in the reads' order."""
    group = name or uuid.uuid4().hex
    made = records.zipped_records([spark.read.format("fastq").load(f) for f in fastqs], record, group)
    return write_records(made.orderBy("file_no", "record_index"), out, group_header(group))


def fastqs_to_bam_with_chemistry(spark: SparkSession, fastqs: list[str], chemistry, tag_map: dict, out: str, name: str | None = None, sequence_key: str = "cdna") -> str:
    """Records cut from several files' reads by a layout, in the reads' order."""
    group = name or uuid.uuid4().hex
    made = records.layout_records([spark.read.format("fastq").load(f) for f in fastqs], chemistry, tag_map, group, sequence_key)
    return write_records(made.orderBy("file_no", "record_index"), out, group_header(group))
