"""Genes and transcripts from annotation entries, and sequences cut from a genome by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.sequence import complement
from strandweave.operators import intervals

#: The patterns of a line and of its attributes.
LINE = r"^([^\t]+)\t[^\t]*\t([^\t]+)\t(\d+)\t(\d+)\t[^\t]*\t([+.-])\t[^\t]*\t(.*)$"
PAIR = r'(\S+?)\s*"(.+?)";?'
#: Windows of a chromosome that sequence is cut from are 2 to the power of this many bases.
WINDOW_BITS = 16


def parse_entries(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(line_no, line, chromosome, feature, start, end, strand, attributes) of lines that aren't comments.

    Start is 1-based, end inclusive. Attributes are pairs of a name and a quoted value after all blanks are taken out;
    of repeated names the last holds. A line that isn't an entry has null columns.
    """
    kept = lines.where(~F.col(line).startswith("#"))
    part = lambda i: F.nullif(F.regexp_extract(line, LINE, i), F.lit(""))
    return kept.select(
        F.col(order).alias("line_no"), F.col(line).alias("line"), part(1).alias("chromosome"), part(2).alias("feature"),
        part(3).try_cast("bigint").alias("start"), part(4).try_cast("bigint").alias("end"), part(5).alias("strand"),
        attribute_pairs(F.coalesce(part(6), F.lit("")), PAIR).alias("attributes"),
    )


def attribute_pairs(text: Column, pattern: str = PAIR) -> Column:
    """The pairs that a pattern's two groups find in a text without blanks, as a map; the last of a name holds."""
    plain = F.regexp_replace(text, " ", "")
    pairs = F.reverse(F.arrays_zip(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2)).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1))


def _features(entries: DataFrame, use_version: bool) -> DataFrame:
    a = F.col("attributes")
    version = lambda kind: F.when(a[f"{kind}_version"].isNotNull(), F.concat(F.lit("."), a[f"{kind}_version"])).otherwise("") if use_version else F.lit("")
    return entries.where(F.col("feature").isin("exon", "transcript", "gene") & a["gene_id"].isNotNull()).select(
        "line_no", "feature", "chromosome", "strand", (F.col("start") - 1).alias("start"), F.col("end"),
        F.concat(a["gene_id"], version("gene")).alias("gene_id"), F.concat(a["transcript_id"], version("transcript")).alias("transcript_id"),
        F.coalesce(a["gene_name"], F.lit("")).alias("gene_name"), F.coalesce(a["transcript_name"], F.lit("")).alias("transcript_name"),
    )


def _extent(rows: DataFrame, key: str, feature: str) -> DataFrame:
    """(key, start, end): of the rows from the last one of the feature on, or of all without one.

    That last row sets the extent, later ones widen it: a running choice that two aggregates express.
    """
    last = rows.groupBy(key).agg(F.max(F.when(F.col("feature") == feature, F.col("line_no"))).alias("_last"))
    counted = F.col("line_no") >= F.coalesce("_last", F.lit(-1))
    return rows.join(last, key).groupBy(key).agg(F.min(F.when(counted, F.col("start"))).alias("start"), F.max(F.when(counted, F.col("end"))).alias("end"))


def genes_and_transcripts(entries: DataFrame, use_version: bool = False, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Genes, transcripts, exons and introns of annotation entries; segments are 0-based and half-open.

    genes(gene_id, chromosome, strand, gene_name, start, end, first_seen), transcripts(transcript_id, gene_id,
    transcript_name, start, end, pseudo), exons and introns(transcript_id, start, end). The order of lines counts: a
    gene (or transcript) line sets the extent, later lines widen it; chromosome and strand are of the last gene line,
    else of the first line; names are the last that aren't empty. Overlapping exons are merged, touching ones are not.
    A transcript id of several genes gets the gene's id in front, for each of them. A gene without transcripts becomes
    its own transcript and exon. Introns are what exons leave free, all of a transcript without exons. A transcript line
    may leave exons before it outside the extent; for the introns they are clipped to it, or an error with ``strict``.
    """
    f = _features(entries, use_version)
    is_gene = F.col("feature") == "gene"
    about = f.groupBy("gene_id").agg(
        *[F.coalesce(F.max_by(c, F.when(is_gene, F.col("line_no"))), F.min_by(c, "line_no")).alias(c) for c in ("chromosome", "strand")],
        F.coalesce(F.max_by("gene_name", F.when(F.col("gene_name") != "", F.col("line_no"))), F.lit("")).alias("gene_name"),
        F.min("line_no").alias("first_seen"),
    )
    genes = about.join(_extent(f, "gene_id", "gene"), "gene_id")
    t = f.where(F.col("transcript_id").isNotNull() & ~is_gene)
    shared = t.groupBy("transcript_id").agg((F.min("gene_id") != F.max("gene_id")).alias("_shared"))
    own = F.when(F.col("_shared"), F.concat_ws("-", "gene_id", "transcript_id")).otherwise(F.col("transcript_id"))
    t = t.join(shared, "transcript_id").withColumn("transcript_id", own).drop("_shared")
    named = t.groupBy("transcript_id").agg(
        F.min("gene_id").alias("gene_id"), F.coalesce(F.max_by("transcript_name", F.when(F.col("transcript_name") != "", F.col("line_no"))), F.lit("")).alias("transcript_name")
    )
    real = named.join(_extent(t, "transcript_id", "transcript"), "transcript_id").withColumn("pseudo", F.lit(False))
    lone = genes.join(real.select("gene_id").distinct(), "gene_id", "left_anti").select(F.col("gene_id").alias("transcript_id"), "gene_id", F.lit("").alias("transcript_name"), "start", "end", F.lit(True).alias("pseudo"))
    transcripts = real.unionByName(lone)
    exons = intervals.collapse(t.where("feature = 'exon'").select("transcript_id", "start", "end"), ["transcript_id"])
    exons = exons.unionByName(lone.select("transcript_id", "start", "end"))
    inner = exons
    if not strict:
        bound = transcripts.select("transcript_id", F.col("start").alias("_from"), F.col("end").alias("_to"))
        inner = exons.join(bound, "transcript_id").select("transcript_id", F.greatest("start", "_from").alias("start"), F.least("end", "_to").alias("end"))
    introns = intervals.invert(inner, transcripts.select("transcript_id", "start", "end"), ["transcript_id"])
    return genes, transcripts, exons, introns


def cut_segments(genome: DataFrame, segments: DataFrame, chromosome: str = "chromosome") -> DataFrame:
    """The segments with ``sequence``, their part of the genome(chromosome, sequence); 0-based, half-open.

    Chromosomes are cut into windows, segments meet the windows they touch, and their parts are joined in order, so that
    no chromosome is copied per segment. A segment beyond its chromosome's end has the part that there is, which may be
    empty; segments of chromosomes that the genome lacks are left out.
    """
    size = 1 << WINDOW_BITS
    windows = genome.select(F.col(chromosome).alias("_c"), F.posexplode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.char_length("sequence") - 1) / size), F.lit(0)).cast("int")),
        lambda i: F.substring(F.col("sequence"), i * size + 1, F.lit(size)),
    )).alias("_n", "_part"))
    columns = segments.columns
    touched = segments.withColumn("_id", F.monotonically_increasing_id()).withColumn(
        "_w", F.explode(F.sequence(F.shiftright("start", WINDOW_BITS), F.greatest(F.shiftright("start", WINDOW_BITS), F.shiftright(F.col("end") - 1, WINDOW_BITS))).cast("array<int>"))
    )
    base = F.col("_w").cast("bigint") * size
    begin = F.greatest(F.col("start") - base, F.lit(0))
    known = touched.join(genome.select(chromosome).distinct(), chromosome, "left_semi")
    met = known.join(windows, (F.col(chromosome) == F.col("_c")) & (F.col("_w") == F.col("_n")), "left").select(
        *columns, "_id", "_w", F.substring("_part", (begin + 1).cast("int"), (F.least(F.col("end") - base, F.lit(size)) - begin).cast("int")).alias("_s")
    )
    joined = met.groupBy("_id", *columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_w", F.coalesce("_s", F.lit("")).alias("_s")))), lambda x: x["_s"]), "").alias("sequence"))
    return joined.drop("_id")


def header_parts(header: Column) -> tuple[Column, Column]:
    """Name and attributes of a FASTA header with its mark; only a blank ends the name, of repeated attributes the last holds."""
    h = F.trim(header)
    name = F.substring_index(F.substring(h, F.lit(2), F.char_length(h)), " ", 1)
    rest = F.when(F.instr(h, " ") > 0, F.substring(h, F.instr(h, " ") + 1, F.char_length(h))).otherwise("")
    found = [F.regexp_extract_all(rest, F.lit(r"(\S+?):(\S*)"), F.lit(i)) for i in (1, 2)]
    pairs = F.reverse(F.arrays_zip(found[0].alias("k"), found[1].alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    return name, F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1))


def make_header(name: Column, *pairs: tuple[str, Column]) -> Column:
    """A FASTA header of a name and attributes."""
    return F.concat_ws(" ", F.concat(F.lit(">"), name), *[F.concat(F.lit(f"{k}:"), v.cast("string")) for k, v in pairs])


def _stranded(sequence: str = "sequence") -> Column:
    return F.when(F.col("strand") == "-", complement(sequence, reverse=True)).otherwise(F.col(sequence))


def _place() -> list[tuple[str, Column]]:
    return [("chr", F.col("chromosome")), ("start", F.col("start") + 1), ("end", F.col("end")), ("strand", F.col("strand"))]


def cdna(genome: DataFrame, genes: DataFrame, transcripts: DataFrame, exons: DataFrame) -> DataFrame:
    """(chromosome, first_seen, transcript_id, header, sequence): each transcript's exons, joined; empty ones left out."""
    about = transcripts.join(genes.select("gene_id", "chromosome", "strand", "gene_name", "first_seen"), "gene_id")
    parts = cut_segments(genome, exons.join(about.select("transcript_id", "chromosome"), "transcript_id"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "sequence"))), lambda x: x["sequence"])
    whole = parts.groupBy("transcript_id").agg(F.array_join(ordered, "").alias("sequence")).where("sequence <> ''")
    header = make_header(F.col("transcript_id"), ("gene_id", F.col("gene_id")), ("gene_name", F.col("gene_name")), ("transcript_name", F.col("transcript_name")), *_place())
    return whole.join(about, "transcript_id").select("chromosome", "first_seen", "transcript_id", header.alias("header"), _stranded().alias("sequence"))


def introns_flanked(genome: DataFrame, genes: DataFrame, transcripts: DataFrame, introns: DataFrame, length: int = 30) -> DataFrame:
    """(chromosome, first_seen, transcript_id, intron_no, header, sequence): introns, flanked within their transcript.

    Introns are numbered from 1 along the genome, on both strands; the header has the transcript's place.
    """
    about = transcripts.join(genes.select("gene_id", "chromosome", "strand", "gene_name", "first_seen"), "gene_id")
    bound = introns.join(transcripts.select("transcript_id", F.col("start").alias("_from"), F.col("end").alias("_to")), "transcript_id")
    wide = intervals.flank_collections(bound, ["transcript_id"], length, F.col("_from"), F.col("_to"))
    numbered = wide.withColumn("intron_no", F.row_number().over(Window.partitionBy("transcript_id").orderBy("start")))
    parts = cut_segments(genome, numbered.join(about.select("transcript_id", "chromosome"), "transcript_id")).select("transcript_id", "intron_no", "sequence")
    name = F.concat(F.col("transcript_id"), F.lit("-I."), F.col("intron_no").cast("string"))
    header = make_header(name, ("gene_id", F.col("gene_id")), ("gene_name", F.col("gene_name")), ("transcript_name", F.col("transcript_name")), *_place())
    return parts.join(about, "transcript_id").select("chromosome", "first_seen", "transcript_id", "intron_no", header.alias("header"), _stranded().alias("sequence"))


def nascent(genome: DataFrame, genes: DataFrame, suffix: str = "") -> DataFrame:
    """(chromosome, first_seen, gene_id, header, sequence): each gene's whole segment; empty ones left out."""
    parts = cut_segments(genome, genes).where("sequence <> ''")
    header = make_header(F.concat(F.col("gene_id"), F.lit(suffix)), ("gene_id", F.col("gene_id")), ("gene_name", F.col("gene_name")), *_place())
    return parts.select("chromosome", "first_seen", "gene_id", header.alias("header"), _stranded().alias("sequence"))
