"""Positional read layouts ("chemistries") and the columns they cut from reads.

A layout is driver-side configuration; what it does to data are built-in string functions.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.errors import ChemistryError, MultimodalChemistryError, SubSequenceDefinitionError


class Strand(Enum):
    """How reads lie to the transcript."""

    UNSTRANDED = 0
    FORWARD = 1
    REVERSE = -1


@dataclass(frozen=True)
class Slice:
    """A part of one of the reads: all of it, from a start on, or from a start for a length; 0-based."""

    index: int
    start: int | None = None
    length: int | None = None

    def __post_init__(self) -> None:
        if self.length is not None and (self.start is None or self.length < 1):
            raise SubSequenceDefinitionError("a length needs a start and must be at least 1")

    @property
    def end(self) -> int | None:
        return None if self.length is None else self.start + self.length

    def is_overlapping(self, other: Slice) -> bool:
        """Whether both take a common position of the same read; an open end reaches on for ever."""
        if self.index != other.index:
            return False
        a, b = (self.start or 0, float("inf") if self.end is None else self.end), (other.start or 0, float("inf") if other.end is None else other.end)
        return a[0] < b[1] and b[0] < a[1]

    def column(self, reads: list[Column]) -> Column:
        """The part as a column; an error where the read is too short; null of null."""
        read = reads[self.index]
        if self.start is None:
            return read
        if self.length is None:
            return F.when(F.char_length(read) > self.start, F.substring(read, F.lit(self.start + 1), F.char_length(read))).when(
                read.isNotNull(), F.raise_error(F.lit("read is too short for its layout"))
            )
        return F.when(F.char_length(read) >= self.end, F.substring(read, self.start + 1, self.length)).when(
            read.isNotNull(), F.raise_error(F.lit("read is too short for its layout"))
        )


@dataclass(frozen=True)
class Parser:
    """An ordered group of slices."""

    slices: tuple[Slice, ...]

    def __iter__(self):
        return iter(self.slices)

    def __len__(self) -> int:
        return len(self.slices)

    def __getitem__(self, i: int) -> Slice:
        return self.slices[i]

    def is_overlapping(self, other: Parser) -> bool:
        return any(a.is_overlapping(b) for a in self for b in other)

    def parse(self, reads: list[Column], concatenate: bool = False) -> Column:
        """The slices as an array, or as one string."""
        parts = [s.column(reads) for s in self.slices]
        return F.concat(*parts) if concatenate else F.array(*parts)


@dataclass(frozen=True)
class Chemistry:
    """A layout: its reads, its named parsers, and the name of its whitelist, if it has one."""

    name: str
    n: int = 0
    strand: Strand | None = None
    parsers: dict[str, Parser] = field(default_factory=dict)
    whitelist: str | None = None
    kind: str = "single_cell"
    resolution: tuple[float, str | None] | None = None
    description: str = ""
    files: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for path in self.files.values():
            if not os.path.isfile(path):
                raise ChemistryError(f"{self.name} names a file that isn't there: {path}")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Chemistry) and (self.n, self.parsers) == (other.n, other.parsers)

    __hash__ = None

    @property
    def lengths(self) -> tuple[int | None, ...]:
        """Per read the position that its slices end at, null where one is open."""
        ends: list[list] = [[] for _ in range(self.n)]
        for parser in self.parsers.values():
            for s in parser:
                ends[s.index].append(s.end)
        return tuple(None if not e or None in e else max(e) for e in ends)

    def has_parser(self, name: str) -> bool:
        return name in self.parsers

    def get_parser(self, name: str) -> Parser:
        if name not in self.parsers:
            raise ChemistryError(f"{self.name} has no parser {name}")
        return self.parsers[name]

    def has_file(self, name: str) -> bool:
        return name in self.files

    def get_file(self, name: str) -> str:
        if name not in self.files:
            raise ChemistryError(f"{self.name} has no file {name}")
        return self.files[name]

    @property
    def _barcode(self) -> str:
        return "spot_barcode" if self.kind == "spatial" else "cell_barcode"

    has_cell_barcode = property(lambda self: "cell_barcode" in self.parsers)
    has_spot_barcode = property(lambda self: "spot_barcode" in self.parsers)
    has_barcode = property(lambda self: self._barcode in self.parsers)
    has_umi = property(lambda self: "umi" in self.parsers)
    has_cdna = property(lambda self: "cdna" in self.parsers)
    has_whitelist = property(lambda self: self.whitelist is not None)
    cell_barcode_parser = property(lambda self: self.get_parser("cell_barcode"))
    spot_barcode_parser = property(lambda self: self.get_parser("spot_barcode"))
    barcode_parser = property(lambda self: self.get_parser(self._barcode))
    umi_parser = property(lambda self: self.get_parser("umi"))
    cdna_parser = property(lambda self: self.get_parser("cdna"))

    @property
    def whitelist_path(self) -> str:
        """The whitelist's file name; the files themselves are the user's to supply."""
        if self.whitelist is None:
            raise ChemistryError(f"{self.name} has no whitelist")
        return f"{self.whitelist}_whitelist.txt.gz"

    def reorder(self, order: list[int]) -> Chemistry:
        """The layout for reads given in another order: read i becomes read ``order[i]``."""
        moved = {k: Parser(tuple(replace(s, index=order[s.index]) for s in p)) for k, p in self.parsers.items()}
        return replace(self, parsers=moved, n=max(order) + 1)

    def parse(self, reads: list[Column], concatenate: bool = False) -> dict[str, Column]:
        """A column per parser."""
        if len(reads) != self.n:
            raise ChemistryError(f"{self.name} needs {self.n} reads, not {len(reads)}")
        return {name: parser.parse(reads, concatenate) for name, parser in self.parsers.items()}

    def parse_reads(self, names: list[Column], sequences: list[Column], qualities: list[Column], check_name: bool = True, concatenate: bool = False) -> dict[str, Column]:
        """Per parser a struct of sequence and quality; with ``check_name`` an error where the reads' names differ."""
        seqs, quals = self.parse(sequences, concatenate), self.parse(qualities, concatenate)
        out = {k: F.struct(seqs[k].alias("sequence"), quals[k].alias("quality")) for k in self.parsers}
        if check_name and len(names) > 1:
            same = F.lit(True)
            for other in names[1:]:
                same = same & (names[0] == other)
            out = {k: F.when(same, c).otherwise(F.raise_error(F.lit("reads have different names"))) for k, c in out.items()}
        return out

    def _bus(self, parser: Parser) -> str:
        return ",".join(f"{s.index},{s.start or 0},{s.end or 0}" for s in parser)

    def to_kallisto_bus_arguments(self) -> dict[str, str]:
        """The technology string for kallisto bus: barcodes, UMIs and cDNA as read, start, end."""
        if not (self.has_barcode and self.has_umi):
            raise ChemistryError("kallisto bus needs a barcode and a UMI")
        return {"-x": ":".join(map(self._bus, (self.barcode_parser, self.umi_parser, self.cdna_parser)))}

    def to_starsolo_arguments(self) -> dict[str, object]:
        """The arguments for STARsolo: 1-based starts for single slices, inclusive 0-based ranges for several."""
        if not self.has_barcode and not self.has_umi:
            return {"--soloType": "SmartSeq"}
        if not (self.has_barcode and self.has_umi):
            raise ChemistryError("STARsolo needs both barcode and UMI")
        both = [*self.barcode_parser, *self.umi_parser]
        if len({s.index for s in both}) > 1:
            raise ChemistryError("STARsolo needs barcode and UMI in one read")
        if any(s.end is None for s in both):
            raise ChemistryError("STARsolo needs barcodes and UMIs of known length")
        if len(self.barcode_parser) == 1 and len(self.umi_parser) == 1:
            b, u = both
            named = {"--soloType": "CB_UMI_Simple", "--soloCBstart": b.start + 1, "--soloCBlen": b.length, "--soloUMIstart": u.start + 1, "--soloUMIlen": u.length}
        else:
            ranges = lambda p: [f"0_{s.start}_0_{s.end - 1}" for s in p]
            named = {"--soloType": "CB_UMI_Complex", "--soloCBposition": ranges(self.barcode_parser), "--soloUMIposition": ranges(self.umi_parser)}
        return named | {"--soloCBwhitelist": self.whitelist_path if self.has_whitelist else "None"}


@dataclass(frozen=True)
class Multimodal:
    """Several layouts under keys that ignore case."""

    name: str
    chemistries: dict[str, Chemistry]

    def __post_init__(self) -> None:
        if len({k.lower() for k in self.chemistries}) != len(self.chemistries):
            raise MultimodalChemistryError("keys must differ by more than case")

    def chemistry(self, key: str) -> Chemistry:
        for k, c in self.chemistries.items():
            if k.lower() == key.lower():
                return c
        raise MultimodalChemistryError(f"{self.name} has no {key}")


#: Fixed values, one layout a line: name; reads; strand; cDNA; barcode; UMI; whitelist. Slices are read:start+length,
#: read:start+ to the read's end, or read:* for all of it.
SINGLE_CELL = """
10xv1; 3; FORWARD; 2:*; 0:0+14; 1:0+10; 10x_version1
10xv2; 2; FORWARD; 1:*; 0:0+16; 0:16+10; 10x_version2
10xv3; 2; FORWARD; 1:*; 0:0+16; 0:16+12; 10x_version3
10xv4; 2; FORWARD; 1:*; 0:0+16; 0:16+12; 10x_version4
10xv3_Ultima; 1; FORWARD; 0:62+; 0:22+16; 0:38+12; 10x_version3
10xFBonly; 2; FORWARD; 1:*; 0:0+16; 0:16+12; 10x_fb
10xATAC; 3; FORWARD; 0:* 1:*; 2:0+16; ; 10x_atac
Drop-seq; 2; UNSTRANDED; 1:*; 0:0+12; 0:12+8;
CEL-Seq; 2; FORWARD; 1:*; 0:0+8; 0:8+4;
CEL-Seq2; 2; FORWARD; 1:*; 0:6+6; 0:0+6;
inDropsv1; 2; UNSTRANDED; 1:*; 0:0+11 0:30+8; 0:42+6;
inDropsv2; 2; UNSTRANDED; 0:*; 1:0+11 1:30+8; 1:42+6;
inDropsv3; 3; UNSTRANDED; 2:*; 0:0+8 1:0+8; 1:8+6; indrops_version3
SCRB-seq; 2; UNSTRANDED; 1:*; 0:0+6; 0:6+10;
SureCell; 2; FORWARD; 1:*; 0:0+6 0:21+6 0:42+6; 0:51+8;
Smart-seq2; 2; UNSTRANDED; 0:* 1:*; ; ;
Smart-seq3; 2; UNSTRANDED; 0:11+ 1:*; ; 0:11+8;
STORM-seq; 2; REVERSE; 0:* 1:14+; ; 1:0+8;
Sci-fate; 2; UNSTRANDED; 1:*; 0:8+10; 0:0+8; sci_fate
BD Rhapsody; 2; FORWARD; 1:*; 0:0+9 0:21+9 0:43+9; 0:52+8; BDWTA
SPLiT-seq; 2; FORWARD; 0:*; 1:10+8 1:48+8 1:78+8; 1:0+10; splitseq_version2
"""
#: Fixed values, likewise, with the resolution at the end; layouts without reads are known by name only.
SPATIAL = """
Slide-seqV2; 2; UNSTRANDED; 1:*; 0:0+8 0:26+6; 0:32+9; ; 10 um
Visium; 2; FORWARD; 1:*; 0:0+16; 0:16+12; visium; 55 um
Stereo-seq; 2; UNSTRANDED; 1:*; 0:0+25; 0:25+10; ; 0.5 um
CosMx; 0; ; ; ; ; ; 0.18 um
Seq-Scope HDMI-DraI; 2; FORWARD; 1:*; 0:0+20; 0:20+9; ; 0.6 um
Seq-Scope HDMI32-DraI; 2; FORWARD; 1:*; 0:0+32; 0:32+9; ; 0.6 um
STARmap; 0; ; ; ; ; ;
seqFISH; 0; ; ; ; ; ;
MERFISH; 0; ; ; ; ; ;
"""
MULTIMODAL = """
10xFB gex; 2; FORWARD; 1:*; 0:0+16; 0:16+12; 10x_version3
10xFB fb; 2; FORWARD; 1:*; 0:0+16; 0:16+12; 10x_fb
10xMultiome gex; 2; FORWARD; 1:*; 0:0+16; 0:16+12; 10x_multiome_gex
10xMultiome atac; 3; FORWARD; 0:* 1:*; 2:0+16; ; 10x_multiome_atac
"""
_SLICE = re.compile(r"(\d+):(?:\*|(\d+)\+(\d*))")


def _slices(text: str) -> Parser | None:
    found = tuple(Slice(int(i), int(s) if s else None, int(n) if n else None) for i, s, n in _SLICE.findall(text))
    return Parser(found) if found else None


def _layout(line: str, kind: str) -> Chemistry:
    name, n, strand, cdna, barcode, umi, whitelist, *rest = [x.strip() for x in line.split(";")]
    barcode_name = "spot_barcode" if kind == "spatial" else "cell_barcode"
    parsers = {k: p for k, t in ((barcode_name, barcode), ("umi", umi), ("cdna", cdna)) if (p := _slices(t))}
    scale, _, unit = rest[0].partition(" ") if rest and rest[0] else ("1", "", "")
    resolution = (float(scale), unit or None) if kind == "spatial" else None
    return Chemistry(name, int(n), Strand[strand] if strand else None, parsers, whitelist or None, kind, resolution)


def registry() -> list[Chemistry | Multimodal]:
    """All known layouts."""
    found: list = [_layout(line, kind) for text, kind in ((SINGLE_CELL, "single_cell"), (SPATIAL, "spatial")) for line in text.strip().splitlines()]
    grouped: dict[str, dict[str, Chemistry]] = {}
    for line in MULTIMODAL.strip().splitlines():
        c = _layout(line, "single_cell")
        whole, _, key = c.name.partition(" ")
        grouped.setdefault(whole, {})[key] = replace(c, name=f"{whole}-{key}")
    return [*found, *(Multimodal(k, v) for k, v in grouped.items())]


def clean_name(name: str) -> tuple[str, int | None]:
    """Lower case without dashes and blanks, and the version that a trailing number, with or without v, stands for."""
    plain = name.lower().replace("-", "").replace(" ", "")
    m = re.search(r"v?(\d+)$", plain)
    return (plain[: m.start()], int(m[1])) if m else (plain, None)


def get_chemistry(name: str) -> Chemistry | Multimodal:
    """The one layout of that name, whatever its case, dashes and spelling of the version."""
    found = [c for c in registry() if clean_name(c.name) == clean_name(name)]
    if len(found) != 1:
        raise ChemistryError(f"{name} names {len(found)} chemistries")
    return found[0]


def registry_frame(spark: SparkSession) -> DataFrame:
    """The registry as rows (name, kind, n_reads, strand, field, part_no, read_index, start, length, end, whitelist)."""
    rows = []
    for c in registry():
        for x in c.chemistries.values() if isinstance(c, Multimodal) else [c]:
            for name, parser in x.parsers.items():
                rows += [(x.name, x.kind, x.n, x.strand.name, name, i, s.index, s.start, s.length, s.end, x.whitelist) for i, s in enumerate(parser)]
    schema = "name string, kind string, n_reads int, strand string, field string, part_no int, read_index int, start int, length int, end int, whitelist string"
    return spark.createDataFrame(rows, schema)
