"""Spark data sources for FASTQ, FASTA, GTF, SAM and BAM files.

``register`` makes the formats known to a session: ``spark.read.format("fastq").load(path)``. Each file is a partition,
as its records can only be told apart from its start; many files are read at once, and gzip is told by content. A file
name column lets partitioned corpora be read as one table. ``write`` gives one file per partition; for a single ordered
file coalesce to one sorted partition first.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from strandweave.sources import bam, sam
from strandweave.sources.text import files_of, lines_of

FASTQ = "file string, read_index bigint, header string, name string, attributes string, sequence string, quality string"
FASTA = "file string, entry_index bigint, header string, name string, attributes map<string,string>, sequence string"
GTF = "file string, line_no bigint, line string, chromosome string, feature string, start bigint, end bigint, strand string, attributes map<string,string>"
#: The patterns of a GTF line, of its attributes and of a FASTA header's.
GTF_LINE = re.compile(r"([^\t]+)\t[^\t]*\t([^\t]+)\t(\d+)\t(\d+)\t[^\t]*\t([+.-])\t[^\t]*\t(.*)")
GTF_PAIR = re.compile(r'(\S+?)\s*"(.+?)";?')
FASTA_PAIR = re.compile(r"(\S+?):(\S*)")


def split_header(header: str) -> tuple[str, str]:
    """Name and rest of a header without its mark; only a blank ends the name."""
    name, _, rest = header.strip()[1:].partition(" ")
    return name, rest


def fastq_rows(path: str, strict: bool = False) -> Iterator[tuple]:
    """Records of four lines; an incomplete last one is dropped, or with ``strict`` an error, as are malformed ones."""
    record: list[str] = []
    index = 0
    for line in lines_of(path):
        record.append(line.strip())
        if len(record) == 4:
            header, sequence, plus, quality = record
            if not header.startswith("@"):
                raise ValueError(f"{path}: a read's header must begin with @: {header}")
            if strict and (not plus.startswith("+") or len(sequence) != len(quality)):
                raise ValueError(f"{path}: malformed read {header}")
            yield (path, index, header, *split_header(header), sequence, quality)
            record, index = [], index + 1
    if strict and any(record):
        raise ValueError(f"{path}: the last read is incomplete")


def fasta_rows(path: str) -> Iterator[tuple]:
    """Entries with their sequence's lines joined."""
    header, parts, index = None, [], 0

    def entry() -> tuple:
        name, rest = split_header(header)
        return (path, index, header, name, dict(FASTA_PAIR.findall(rest)), "".join(parts))

    for line in lines_of(path):
        line = line.strip()
        if line.startswith(">"):
            if header is not None:
                yield entry()
                index += 1
            header, parts = line, []
        elif line:
            if header is None:
                raise ValueError(f"{path}: a FASTA file must begin with >")
            parts.append(line)
    if header is not None:
        yield entry()


def gtf_rows(path: str) -> Iterator[tuple]:
    """Entries; lines that begin with # are skipped, a line that isn't an entry is an error."""
    for number, line in enumerate(lines_of(path)):
        if line.startswith("#") or not line.strip():
            continue
        m = GTF_LINE.fullmatch(line)
        if m is None:
            raise ValueError(f"{path}: line {number} isn't an entry: {line}")
        chromosome, feature, start, end, strand, attributes = m.groups()
        yield (path, number, line, chromosome, feature, int(start), int(end), strand, dict(GTF_PAIR.findall(attributes.replace(" ", ""))))


@dataclass
class OneFile(InputPartition):
    path: str


class FileReader(DataSourceReader):
    def __init__(self, paths: list[str], rows, options: dict) -> None:
        self.paths, self.rows, self.options = paths, rows, options

    def partitions(self) -> list[InputPartition]:
        return [OneFile(p) for p in self.paths]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        return self.rows(partition.path, **self.options)


@dataclass
class Written(WriterCommitMessage):
    path: str


class FileWriter(DataSourceWriter):
    """Writes a file per partition under a name of its own; only a commit of the whole job gives it its final name."""

    def __init__(self, folder: str, suffix: str, dump, overwrite: bool) -> None:
        self.folder, self.suffix, self.dump = folder.removeprefix("file://").removeprefix("file:"), suffix, dump
        if os.path.isdir(self.folder) and os.listdir(self.folder) and not overwrite:
            raise ValueError(f"{self.folder} isn't empty")
        self.before = [os.path.join(self.folder, f) for f in os.listdir(self.folder)] if os.path.isdir(self.folder) else []

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"_part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{self.suffix}")
        self.dump(path, rows)
        return Written(path)

    def commit(self, messages: list) -> None:
        for old in self.before:
            if os.path.isfile(old):
                os.remove(old)
        for m in messages:
            if m is not None:
                os.rename(m.path, os.path.join(self.folder, os.path.basename(m.path)[1:]))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def _text_dump(line_of):
    def dump(path: str, rows: Iterator) -> None:
        import gzip

        with (gzip.open(path, "wt") if path.endswith(".gz") else open(path, "w")) as f:
            for row in rows:
                f.write(line_of(row) + "\n")

    return dump


class _Source(DataSource):
    suffix, table, rows, line_of = "", "", None, None

    def schema(self) -> str:
        return self.table

    def reader(self, schema: StructType) -> DataSourceReader:
        options = {"strict": True} if self.options.get("strict", "false").lower() == "true" else {}
        return FileReader(files_of(self.options["path"]), type(self).rows, options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        suffix = self.suffix + (".gz" if self.options.get("compression") == "gzip" else "")
        return FileWriter(self.options["path"], suffix, _text_dump(type(self).line_of), overwrite)


class FastqSource(_Source):
    """FASTQ; option ``strict``. Writes header (or @name), sequence, quality."""

    suffix, table, rows = ".fastq", FASTQ, staticmethod(fastq_rows)
    line_of = staticmethod(lambda r: "\n".join([r["header"], r["sequence"], "+", r["quality"]]))

    @classmethod
    def name(cls) -> str:
        return "fastq"


class FastaSource(_Source):
    """FASTA. Writes header and sequence, each on one line."""

    suffix, table, rows = ".fa", FASTA, staticmethod(fasta_rows)
    line_of = staticmethod(lambda r: f"{r['header']}\n{r['sequence']}")

    @classmethod
    def name(cls) -> str:
        return "fasta"


class GtfSource(_Source):
    """GTF. Writes the lines."""

    suffix, table, rows = ".gtf", GTF, staticmethod(gtf_rows)
    line_of = staticmethod(lambda r: r["line"])

    @classmethod
    def name(cls) -> str:
        return "gtf"


class SamSource(_Source):
    """SAM text. The header lines are the option ``header`` when writing."""

    suffix, table, rows = ".sam", sam.SCHEMA, staticmethod(sam.rows)

    @classmethod
    def name(cls) -> str:
        return "sam"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        header = self.options.get("header", sam.HEADER)

        def dump(path: str, rows: Iterator) -> None:
            with open(path, "w") as f:
                f.write(header.rstrip("\n") + "\n")
                for row in rows:
                    f.write(sam.line_of(row) + "\n")

        return FileWriter(self.options["path"], self.suffix, dump, overwrite)


class BamSource(_Source):
    """BAM. The header lines are the option ``header`` when writing."""

    suffix, table, rows = ".bam", sam.SCHEMA, staticmethod(bam.rows)

    @classmethod
    def name(cls) -> str:
        return "bam"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        header = self.options.get("header", sam.HEADER)
        return FileWriter(self.options["path"], self.suffix, lambda path, rows: bam.dump(path, header, rows), overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (FastqSource, FastaSource, GtfSource, SamSource, BamSource):
        spark.dataSource.register(source)
