"""Driver-side errors. Errors in data surface when a plan runs, as Spark's runtime errors with the same wording."""


class SequenceError(Exception):
    """A sequence, its qualities or an alignment is invalid."""


class BamError(Exception):
    """Alignment records are inconsistent, or arguments for them are."""


class ReadError(Exception):
    """A sequencing read is invalid."""


class FastqError(Exception):
    """A FASTQ file is invalid."""


class FastaError(Exception):
    """A FASTA file is invalid."""


class FastaEntryError(Exception):
    """A FASTA entry is invalid."""


class GtfError(Exception):
    """A GTF file is invalid."""


class GtfEntryError(Exception):
    """A GTF line is invalid."""


class SegmentError(Exception):
    """A segment ends before it starts, or starts below zero."""


class SegmentCollectionError(Exception):
    """Segments don't fit their bounds."""


class SubSequenceDefinitionError(Exception):
    """A slice of a read is invalid."""


class SubSequenceParserError(Exception):
    """A group of slices is invalid."""


class ChemistryError(Exception):
    """A chemistry is unknown or doesn't fit its reads."""


class SingleCellChemistryError(ChemistryError):
    """A single-cell chemistry lacks what is asked of it."""


class SpatialChemistryError(ChemistryError):
    """A spatial chemistry lacks what is asked of it."""


class MultimodalChemistryError(ChemistryError):
    """A multimodal chemistry lacks what is asked of it."""


class ArgumentError(Exception):
    """An argument of an executable doesn't pass its validator."""


class BinaryError(Exception):
    """An executable is missing or called wrongly."""
