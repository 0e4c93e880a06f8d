"""Queries for the sequence, interval, annotation, layout and record operators.

Where the tables hold no such data, sequences are derived from keys by rules that any engine can apply: the digits of a
key's MD5 as bases (``dna``), as codes (``codes``), or as qualities (``qual``). Every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import layouts
from strandweave.functions import sequence as sq
from strandweave.functions.keys import as_integer
from strandweave.operators import consensus, correction, intervals, records
from strandweave.plans import annotation
from strandweave.session import table

HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"
#: The barcodes of the matrix and whitelist queries: the first bases of the MD5 of 0 to 39.
BARCODES = 40


def md5(k: Column) -> Column:
    return F.md5(k.cast("string").cast("binary"))


def dna(k: Column) -> Column:
    return F.translate(md5(k), HEX, BASES)


def codes(k: Column) -> Column:
    return F.translate(md5(k), HEX, sq.CODES)


def qual(k: Column) -> Column:
    return F.translate(md5(k), "abcdef", "!/AEI#")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id")


def seq_dna(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", dna(F.col("event_id")).alias("dna"), codes(F.col("event_id")).alias("codes"))


def seq_complement(spark: SparkSession, d: str) -> DataFrame:
    s = F.regexp_replace(codes(F.col("event_id")), "-", "N")
    return _events(spark, d).select("event_id", sq.complement(s).alias("complement"), sq.complement(s, reverse=True).alias("reverse_complement"))


def fasta_complement(spark: SparkSession, d: str) -> DataFrame:
    """Real sequences; gaps and unknown codes, which have no complement, become N first."""
    known = F.regexp_replace(F.upper("sequence"), "[^ACGTNRYSWKMBDHV]", "N")
    return table(spark, d, "fasta_entries").select("entry_no", F.md5(sq.complement(known, reverse=True).cast("binary")).alias("md5"))


def seq_hamming(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", sq.hamming(dna(F.col("event_id")), dna(F.col("user_id"))).alias("distance"))


def seq_hamming_iupac(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", sq.hamming(codes(F.col("event_id")), codes(F.col("user_id"))).alias("distance"))


def _barcodes(spark: SparkSession, size: int = 12) -> DataFrame:
    return spark.range(BARCODES).select(F.substring(dna(F.col("id")), 1, size).alias("barcode"), F.col("id").alias("barcode_no"))


def seq_hamming_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every part against a fixed list of barcodes."""
    p = table(spark, d, "part").select("p_partkey", F.substring(codes(F.col("p_partkey")), 1, 12).alias("s"))
    listed = _barcodes(spark).withColumn("barcode_no", F.col("barcode_no").cast("int"))
    return sq.hamming_matrix(p, "p_partkey", "s", listed, "barcode_no", "barcode")


def seq_pairwise_hamming(spark: SparkSession, d: str) -> DataFrame:
    """The symmetric distances of one fixed list, each pair compared once."""
    return sq.hamming_pairwise(table(spark, d, "nation").select("n_nationkey", F.substring(codes(F.col("n_nationkey")), 1, 16).alias("s")), "n_nationkey", "s")


def seq_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", sq.levenshtein(dna(F.col("event_id")), dna(F.col("user_id"))).alias("distance"))


def seq_levenshtein_iupac(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", codes(F.col("event_id")).alias("a"), codes(F.col("user_id")).alias("b"))
    return e.select("event_id", sq.levenshtein("a", "b").alias("distance"))


def seq_cigar(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", sq.cigar(dna(F.col("event_id")), dna(F.col("user_id")), mismatch=True).alias("cigar"))


def seq_cigar_gapped(spark: SparkSession, d: str) -> DataFrame:
    """Gaps at a third of the reference's positions and, where it has none, at a third of the query's."""
    e = _events(spark, d).select("event_id", F.translate(md5(F.col("event_id")), HEX, "ACGTACGTACG-----").alias("r"), F.translate(md5(F.col("user_id")), HEX, "ACGTACGTACG-----").alias("q"))
    q = F.array_join(F.zip_with(F.split("r", ""), F.split("q", ""), lambda x, y: F.when((x == "-") & (y == "-"), "N").otherwise(y)), "")
    return e.select("event_id", sq.cigar(F.col("r"), q).alias("cigar"))


def seq_disambiguate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.regexp_replace(F.substring(codes(F.col("p_partkey")), 1, 5), "-", "A").alias("s"))
    return p.select("p_partkey", F.posexplode(sq.disambiguate("s")).alias("form_no", "form"))


def qual_values(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", qual(F.col("event_id")).alias("q"))
    return e.select("event_id", F.array_join(sq.quality_values("q"), ",").alias("quality_values"), F.round(F.aggregate(sq.quality_probs("q"), F.lit(0.0), lambda a, x: a + x), 6).alias("expected_errors"))


def qual_median(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", F.explode(sq.quality_values(qual(F.col("event_id")))).alias("q"))
    return e.groupBy("user_id").agg(F.median("q").alias("median_quality"))


def _reads(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.select("event_id", F.pmod("user_id", F.lit(200)).alias("group_no"), F.substring(codes(F.col("event_id")), 1, 12).alias("s"), F.substring(qual(F.col("event_id")), 1, 12).alias("q"))


def positional_weights(spark: SparkSession, d: str) -> DataFrame:
    return consensus.positional_weights(_reads(spark, d), "group_no", "s", "q")


def consensus_first(spark: SparkSession, d: str) -> DataFrame:
    """The unrestricted consensus of each group, and the code of its ties, from built-in aggregates."""
    w = positional_weights(spark, d)
    cols = [F.col(b) for b in "acgt"]
    parts = w.select("group_no", "position", sq.likely_code(*cols).alias("one"), sq.likely_code(*cols, ambiguous=True).alias("all"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c]), "")
    return parts.groupBy("group_no").agg(joined("one").alias("consensus"), joined("all").alias("ambiguous"))


def consensus_full(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus_by_group(_reads(spark, d), "group_no", "event_id", "s", "q", proportion=0.3, allow_ambiguous=True)


def _barcoded(spark: SparkSession, d: str) -> DataFrame:
    """Reads whose barcode is one of the list, with the base at a position of the key's choice replaced in half of them."""
    key = F.col("event_id")
    clean = F.substring(dna(F.pmod(key, F.lit(BARCODES))), 1, 12)
    at = (F.pmod(F.floor(key / BARCODES), F.lit(12)) + 1).cast("int")
    spoiled = F.concat(F.substring(clean, F.lit(1), at - 1), F.element_at(F.split(F.lit("G,A,T,T,A,C,A,N"), ","), (F.pmod(F.floor(key / 7), F.lit(8)) + 1).cast("int")), F.substring(clean, at + 1, F.lit(12)))
    read = F.when(F.pmod(F.floor(key / 3), F.lit(2)) == 0, clean).otherwise(spoiled)
    return _events(spark, d).select("event_id", read.alias("barcode"), F.substring(qual(key), 1, 12).alias("quality"))


def whitelist_simple(spark: SparkSession, d: str) -> DataFrame:
    return correction.correct_simple(_barcoded(spark, d), "barcode", _barcodes(spark), "barcode")


def whitelist_posterior(spark: SparkSession, d: str) -> DataFrame:
    return correction.correct_posterior(_barcoded(spark, d), "event_id", "barcode", "quality", _barcodes(spark), "barcode")


def whitelist_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Barcodes of 16 bases with 0 to 16 of them unread, within two mismatches."""
    key = F.col("event_id")
    clean = F.substring(dna(F.pmod(key, F.lit(BARCODES))), 1, 16)
    unread = F.pmod(key, F.lit(17)).cast("int")
    read = F.concat(F.substring(clean, F.lit(1), 16 - unread), F.repeat(F.lit("N"), unread))
    spoiled = F.when(F.pmod(F.floor(key / 3), F.lit(2)) == 0, read).otherwise(F.concat(F.lit("A"), F.substring(read, 2, 15)))
    return correction.correct_simple(_events(spark, d).select(spoiled.alias("barcode")), "barcode", _barcodes(spark, 16), "barcode", d=2)


def barcode_counts(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: reads cut by a layout, barcodes corrected to the list, reads and distinct UMIs per barcode."""
    layout = layouts.Chemistry("short", 1, layouts.Strand.FORWARD, {"cell_barcode": layouts.Parser((layouts.Slice(0, 0, 12),)), "umi": layouts.Parser((layouts.Slice(0, 12, 8),))})
    reads = _barcoded(spark, d).withColumn("read", F.concat("barcode", F.substring(dna(F.floor(F.col("event_id") / 5)), 1, 8)))
    cut = layout.parse([F.col("read")], concatenate=True)
    parsed = reads.select("event_id", cut["cell_barcode"].alias("barcode"), cut["umi"].alias("umi"))
    fixed = correction.correct_simple(parsed, "barcode", _barcodes(spark), "barcode")
    return parsed.join(fixed, "barcode").where(F.col("corrected").isNotNull()).groupBy("corrected").agg(F.count(F.lit(1)).alias("n_reads"), F.countDistinct("umi").alias("n_umis"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    start = F.col("l_partkey").cast("bigint")
    return t.select(F.col("l_suppkey").alias("k"), F.pmod("l_orderkey", F.lit(2)).alias("half"), start.alias("start"), (start + F.floor(F.col("l_quantity") / 10)).alias("end"))


def seg_predicates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    s1, e1 = F.col("l_partkey"), F.col("l_partkey") + F.floor(F.col("l_quantity"))
    s2, e2 = F.col("l_partkey") + F.floor(F.col("l_tax") * 100) * 5, F.col("l_partkey") + F.floor(F.col("l_tax") * 100) * 5 + F.floor(F.col("l_discount") * 100)
    return t.select(
        "l_orderkey", "l_linenumber", intervals.width(s1, e1).alias("width"), intervals.is_in(s2, s1, e1).alias("holds"), intervals.is_overlapping(s1, e1, s2, e2).alias("overlapping"),
        intervals.is_exclusive(s1, e1, s2, e2).alias("exclusive"), intervals.is_subset(s2, e2, s1, e1).alias("subset"), intervals.is_superset(s2, e2, s1, e1).alias("superset"),
    )


def seg_flank(spark: SparkSession, d: str) -> DataFrame:
    """Every segment, flanked within its key's first start and last end."""
    rows = _segments(spark, d)
    bounds = rows.groupBy("k").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    s, e = intervals.flank(F.col("start"), F.col("end"), 7, F.col("lo"), F.col("hi"))
    return rows.join(bounds, "k").select("k", "start", "end", s.alias("flank_start"), e.alias("flank_end"))


def seg_collapse(spark: SparkSession, d: str) -> DataFrame:
    return intervals.collapse(_segments(spark, d), ["k"])


def seg_invert(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    bounds = s.groupBy("k").agg((F.min("start") - 2).alias("start"), (F.max("end") + 3).alias("end"))
    return intervals.invert(s, bounds, ["k"])


def seg_span(spark: SparkSession, d: str) -> DataFrame:
    return intervals.collection_span(_segments(spark, d), ["k"])


def seg_collection_flank(spark: SparkSession, d: str) -> DataFrame:
    return intervals.flank_collections(_segments(spark, d), ["k"], 2)


def seg_from_positions(spark: SparkSession, d: str) -> DataFrame:
    return intervals.from_positions(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_partkey"), ["k"], "l_partkey")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _segments(spark, d)
    return s.where("half = 0").drop("half"), s.where("half = 1").drop("half")


def seg_union_collapse(spark: SparkSession, d: str) -> DataFrame:
    return intervals.from_collections(list(_halves(spark, d)), ["k"])


def seg_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """The segments of one half that overlap the other half's of their key."""
    a, b = _halves(spark, d)
    return intervals.overlapping_rows(intervals.collapse(a, ["k"]), b, ["k"])


def seg_overlapping_collections(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlapping_collections(*_halves(spark, d), ["k"])


def seg_subset_collections(spark: SparkSession, d: str) -> DataFrame:
    """Whether one half's segments lie within the other half's, flanked."""
    a, b = _halves(spark, d)
    return intervals.subset_collections(a, intervals.flank_collections(b, ["k"], 25), ["k"])


def seg_span_exclusive(spark: SparkSession, d: str) -> DataFrame:
    return intervals.span_exclusive(*_halves(spark, d), ["k"])


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Annotation entries of the lines that the line parser loads, as the annotation plans take them."""
    from strandweave.operators.annotation_lines import parse_lines

    good = parse_lines(table(spark, d, "gtf_lines"), "raw_no", "line").where("reason is null")
    return good.select(F.col("raw_no").alias("line_no"), "chromosome", "feature", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "strand", "attributes")


def gtf_parse(spark: SparkSession, d: str) -> DataFrame:
    """Lines as the pattern takes them, without the stricter checks of p4."""
    e = annotation.parse_entries(table(spark, d, "gtf_lines"), order="raw_no")
    return e.select("line_no", "chromosome", "feature", "start", "end", "strand")


def gtf_attributes(spark: SparkSession, d: str) -> DataFrame:
    e = annotation.parse_entries(table(spark, d, "gtf_lines"), order="raw_no")
    return e.select("line_no", *[F.col("attributes")[k].alias(k) for k in ("gene_id", "transcript_id", "gene_biotype", "note")])


def gtf_filter(spark: SparkSession, d: str) -> DataFrame:
    e = annotation.parse_entries(table(spark, d, "gtf_lines"), order="raw_no")
    return e.where("feature = 'exon' and strand = '+'").groupBy("chromosome").agg(F.count(F.lit(1)).alias("n_exons"), F.sum(F.col("end") - F.col("start") + 1).alias("bases"))


def gene_info(spark: SparkSession, d: str) -> DataFrame:
    return annotation.genes_and_transcripts(_entries(spark, d))[0]


def transcript_info(spark: SparkSession, d: str) -> DataFrame:
    return annotation.genes_and_transcripts(_entries(spark, d))[1]


def transcript_exons(spark: SparkSession, d: str) -> DataFrame:
    return annotation.genes_and_transcripts(_entries(spark, d))[2]


def transcript_introns(spark: SparkSession, d: str) -> DataFrame:
    return annotation.genes_and_transcripts(_entries(spark, d))[3]


def _genome(spark: SparkSession, d: str) -> DataFrame:
    """A made-up genome: each chromosome's bases are its documents' MD5s in order, as many as there are documents."""
    t = table(spark, d, "documents").select(F.concat(F.lit("LG0"), F.pmod("doc_id", F.lit(5)).cast("string")).alias("chromosome"), "doc_id")
    parts = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: dna(x))
    return t.groupBy("chromosome").agg(F.array_join(parts, "").alias("sequence"))


def _small_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Entries folded onto the made-up genome: starts and lengths of real ones taken modulo their chromosome's length."""
    gene = F.col("attributes")["gene_id"]
    e = _entries(spark, d).withColumn("place", F.pmod(F.char_length(gene) + F.ascii(F.reverse(gene)), F.lit(5)))
    lengths = table(spark, d, "documents").groupBy(F.pmod("doc_id", F.lit(5)).cast("int").alias("place")).agg((F.count(F.lit(1)) * 32).alias("bases"))
    folded = e.join(F.broadcast(lengths), "place")  # five rows
    start = F.pmod("start", F.col("bases")) + 1
    return folded.withColumns({"start": start, "end": start + F.pmod(F.col("end") - F.col("start"), F.col("bases")), "chromosome": F.concat(F.lit("LG0"), F.col("place").cast("string"))}).drop("place", "bases")


def _cut(spark: SparkSession, d: str, what: str) -> DataFrame:
    genes, transcripts, exons, introns = annotation.genes_and_transcripts(_small_annotation(spark, d))
    genome = _genome(spark, d)
    if what == "cdna":
        return annotation.cdna(genome, genes, transcripts, exons).select("transcript_id", "header", "sequence")
    if what == "introns":
        return annotation.introns_flanked(genome, genes, transcripts, introns, 5).select("transcript_id", "intron_no", "header", "sequence")
    return annotation.nascent(genome, genes).select("gene_id", "header", "sequence")


def fasta_cdna(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d, "cdna")


def fasta_introns(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d, "introns")


def fasta_nascent(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d, "nascent")


def fasta_headers(spark: SparkSession, d: str) -> DataFrame:
    """Names and attributes read from headers, and headers made from both."""
    name, attributes = annotation.header_parts(F.col("header"))
    made = annotation.make_header(name, ("n", F.coalesce(F.char_length("sequence"), F.lit(0))))
    return table(spark, d, "fasta_entries").where(F.col("header").startswith(">")).select("entry_no", name.alias("parsed_name"), F.size(attributes).alias("n_attributes"), made.alias("made_header"))


def _fastq(spark: SparkSession, d: str, salt: str) -> DataFrame:
    """Reads of 64 bases, one per event, named alike in every file."""
    key = F.concat(F.lit(salt), F.col("event_id").cast("string"))
    two = lambda f: F.concat(f(key), f(F.concat(key, F.lit("b"))))
    return _events(spark, d).select(
        F.col("event_id").alias("read_index"), F.concat(F.lit("read"), F.col("event_id").cast("string")).alias("name"), F.lit("extra").alias("attributes"), two(dna).alias("sequence"), two(qual).alias("quality")
    )


def _chem(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = layouts.get_chemistry(name)
        zipped = records.zip_reads([_fastq(spark, d, str(i)) for i in range(c.n)])
        cut = c.parse([F.rpad(F.col("reads")[i]["sequence"], 96, "ACGT") for i in range(c.n)], concatenate=True)
        return zipped.select("read_index", *[x.alias(k) for k, x in cut.items()])

    query.__name__ = "chem_parse_" + "".join(x if x.isalnum() else "_" for x in name.lower())
    return query


def chem_registry(spark: SparkSession, d: str) -> DataFrame:
    return layouts.registry_frame(spark).withColumnRenamed("end", "slice_end").withColumnRenamed("start", "slice_start").withColumnRenamed("length", "slice_length")


def chem_lengths(spark: SparkSession, d: str) -> DataFrame:
    r = layouts.registry_frame(spark)
    ends = r.groupBy("name", "read_index").agg(F.max("end").alias("e"), F.count(F.when(F.col("end").isNull(), 1)).alias("open"))
    return ends.select("name", "read_index", F.when(F.col("open") == 0, F.col("e")).alias("read_length"))


def _lanes(spark: SparkSession, d: str, salt: str) -> DataFrame:
    """The reads of a side in three files, each with indices of its own."""
    lane, index = F.pmod("read_index", F.lit(3)).cast("int"), F.floor(F.col("read_index") / 3)
    return _fastq(spark, d, salt).withColumns({"file": F.concat(F.lit(f"side{salt}_lane"), lane.cast("string")), "read_index": index})


def fastq_zip_multi(spark: SparkSession, d: str) -> DataFrame:
    z = records.zip_reads([_lanes(spark, d, "0"), _lanes(spark, d, "1")])
    return z.select("file_no", "read_index", F.col("reads")[0]["name"].alias("name"), F.col("reads")[0]["sequence"].alias("s0"), F.col("reads")[1]["sequence"].alias("s1"))


def rec_split_multi(spark: SparkSession, d: str) -> DataFrame:
    """Records of three files split as one."""
    made = records.reads_to_records(_lanes(spark, d, "0"), "rg")
    return records.split_records(made, n=7, check_pairs=False).select("file", "record_index", "split_id")


def fastq_zip(spark: SparkSession, d: str) -> DataFrame:
    z = records.zip_reads([_fastq(spark, d, "0"), _fastq(spark, d, "1")])
    return z.select("read_index", F.col("reads")[0]["name"].alias("name"), F.col("reads")[0]["sequence"].alias("s0"), F.col("reads")[1]["sequence"].alias("s1"))


def rec_from_layout(spark: SparkSession, d: str) -> DataFrame:
    made = records.layout_records([_fastq(spark, d, "0"), _fastq(spark, d, "1")], layouts.get_chemistry("10xv3"), {"cell_barcode": ("CR", "CY"), "umi": ("UR", "UY")}, "rg1")
    return made.select("record_index", "qname", "flag", "seq", "qual", *[F.col("tags")[t].alias(t.lower()) for t in ("RG", "CR", "CY", "UR", "UY")])


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Two mates per name, of which every fifth name is unpaired instead."""
    made = records.reads_to_records(_fastq(spark, d, "0"), "rg").withColumn("tags", F.create_map(F.lit("RG"), F.concat(F.lit("g"), F.pmod(F.floor(F.col("record_index") / 2), F.lit(3)).cast("string"))))
    pair = F.floor(F.col("record_index") / 2)
    lone = (F.pmod(pair, F.lit(5)) == 0) | (F.count(F.lit(1)).over(Window.partitionBy(pair)) < 2)
    return made.withColumns({"flag": F.when(lone, F.lit(4)).otherwise(F.lit(5)), "qname": F.concat(F.lit("p"), pair.cast("string"))})


def rec_map(spark: SparkSession, d: str) -> DataFrame:
    return records.map_records(_records(spark, d), record_index=F.col("record_index"), n_bases=F.char_length("seq"), mean_quality=F.round(F.aggregate(sq.quality_values("qual"), F.lit(0), lambda a, x: a + x) / F.char_length("qual"), 4))


def rec_apply(spark: SparkSession, d: str) -> DataFrame:
    kept = F.when(F.col("seq").startswith("A"), F.struct("record_index", F.reverse("seq").alias("seq")))
    return records.apply_records(_records(spark, d), kept)


def rec_filter(spark: SparkSession, d: str) -> DataFrame:
    """Null keeps a record: names divisible by seven have no verdict."""
    verdict = F.when(F.pmod("record_index", F.lit(7)) != 0, F.col("seq").startswith("C"))
    return records.filter_records(_records(spark, d), verdict).select("record_index", "qname", "flag")


def rec_count(spark: SparkSession, d: str) -> DataFrame:
    return records.count_records(_records(spark, d), F.col("seq").startswith("G"))


def rec_split_key(spark: SparkSession, d: str) -> DataFrame:
    return records.split_records(_records(spark, d), F.col("tags")["RG"]).groupBy("split_id").agg(F.count(F.lit(1)).alias("n_records"))


def rec_split_n(spark: SparkSession, d: str) -> DataFrame:
    return records.split_records(_records(spark, d), n=7, check_pairs=False).select("record_index", "split_id")


def rec_split_n_pairs(spark: SparkSession, d: str) -> DataFrame:
    return records.split_records(_records(spark, d), n=7).select("record_index", "split_id")


def rec_tag_join(spark: SparkSession, d: str) -> DataFrame:
    base = records.reads_to_records(_fastq(spark, d, "0"), "rg")
    tags = [F.create_map(F.lit("CR"), F.substring("sequence", 1, 16)), F.create_map(F.lit("UR"), F.substring("sequence", 1, 10), F.lit("CR"), F.substring("sequence", 3, 16))]
    tagged = records.tag_records(base, [_fastq(spark, d, "0"), _fastq(spark, d, "1")], tags)
    return tagged.select("record_index", *[F.col("tags")[t].alias(t.lower()) for t in ("RG", "CR", "UR")])


def dict_merge(spark: SparkSession, d: str) -> DataFrame:
    """Counts per key of two tables, merged with a default of 0."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return c.join(s, "k", "full").select("k", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))


def dict_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Nested maps as rows of a key path and a value."""
    r = table(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("inner"))
    return r.select("n_regionkey", F.explode("inner").alias("key", "value")).select(F.concat_ws("/", F.col("n_regionkey").cast("string"), "key").alias("path"), "value")


def validators(spark: SparkSession, d: str) -> DataFrame:
    """Validators as predicates: integer, and integer and positive."""
    t = table(spark, d, "gtf_attributes").select("line_no", "attr_no", "loaded_at", "attr_value")
    number = as_integer(F.trim("attr_value"))
    return t.groupBy("attr_no").agg(F.count(F.when(number.isNotNull(), 1)).alias("n_integer"), F.count(F.when(number > 0, 1)).alias("n_positive"), F.count(F.lit(1)).alias("n"))


_PLAIN = (
    seq_dna, seq_complement, fasta_complement, seq_hamming, seq_hamming_iupac, seq_hamming_matrix, seq_pairwise_hamming, seq_levenshtein, seq_levenshtein_iupac, seq_cigar,
    seq_cigar_gapped, seq_disambiguate, qual_values, qual_median, positional_weights, consensus_first, consensus_full, whitelist_simple, whitelist_posterior, whitelist_ambiguous, barcode_counts,
    seg_predicates, seg_flank, seg_collapse, seg_invert, seg_span, seg_collection_flank, seg_from_positions, seg_union_collapse, seg_overlapping, seg_overlapping_collections,
    seg_subset_collections, seg_span_exclusive, gtf_parse, gtf_attributes, gtf_filter, gene_info, transcript_info, transcript_exons, transcript_introns, fasta_cdna, fasta_introns,
    fasta_nascent, fasta_headers, chem_registry, chem_lengths, fastq_zip, fastq_zip_multi, rec_split_multi, rec_from_layout, rec_map, rec_apply, rec_filter, rec_count, rec_split_key, rec_split_n, rec_split_n_pairs,
    rec_tag_join, dict_merge, dict_flatten, validators,
)
LAYOUTS = [c.name for c in layouts.registry() if isinstance(c, layouts.Chemistry) and c.n]
QUERIES = {f.__name__: f for f in (*_PLAIN, *map(_chem, LAYOUTS))}
