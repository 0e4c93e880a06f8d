"""Sequences, segments, annotation, layouts, records, files and helpers: published examples, round trips, brute force."""

import gzip
import random
import subprocess
from datetime import datetime

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandweave.errors import ArgumentError, BamError, BinaryError, ChemistryError, SequenceError, SubSequenceDefinitionError
from strandweave.functions import layouts
from strandweave.functions import sequence as sq
from strandweave.operators import consensus, correction, intervals, records
from strandweave.plans import annotation
from strandweave.sources import formats, sam
from strandweave.support import dicts, executables, files, log, processes


def one(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_cigar(spark):
    pairs = [("ACGT", "----"), ("ACGT", "A--T"), ("----", "AAAT"), (None, "A"), ("", "")]
    assert one(spark, pairs, "r string, q string", sq.cigar("r", "q")) == [("4D",), ("1M2D1M",), ("4I",), (None,), ("",)]
    assert one(spark, [("ACGT", "ACNV")], "r string, q string", sq.cigar("r", "q", mismatch=True)) == [("3M1X",)]
    with pytest.raises(Exception, match="gaps in both"):
        one(spark, [("A-", "A-")], "r string, q string", sq.cigar("r", "q"))


def test_distances(spark):
    assert one(spark, [("ACTG", "ACTT"), ("ACTG", "ACTN"), ("acgt" * 20, "ACGA" * 20), (None, "A"), ("--", "--"), ("", "")], "a string, b string", sq.hamming("a", "b")) == [(1,), (0,), (20,), (None,), (2,), (0,)]
    assert one(spark, [("AC", "AT"), ("AT", "AN"), ("XZ", "ZX"), ("ACGT", "AGT"), (None, "A"), ("", "AN")], "a string, b string", sq.levenshtein("a", "b")) == [(1,), (0,), (2,), (1,), (None,), (2,)]
    with pytest.raises(Exception, match="equal length"):
        one(spark, [("A", "AA")], "a string, b string", sq.hamming("a", "b"))


def test_complement_qualities_disambiguation(spark):
    assert one(spark, [("acgtN",), (None,), ("",)], "s string", sq.complement("s", reverse=True)) == [("NACGT",), (None,), ("",)]
    with pytest.raises(Exception, match="no complement"):
        one(spark, [("A-",)], "s string", sq.complement("s"))
    assert one(spark, [("AAAB",), ("///!",), ("",)], "q string", sq.quality_values("q")) == [([32, 32, 32, 33],), ([14, 14, 14, 0],), ([],)]
    assert one(spark, [("RYA",), ("A-",)], "s string", sq.disambiguate("s")) == [(["ACA", "GCA", "ATA", "GTA"],), ([],)]


def test_consensus():
    assert consensus.call_consensus(["AAAC", "AAAG"], [[32] * 4] * 2, allow_ambiguous=True)[:2] == (["AAAS"], [0, 0])
    texts, numbers, qualities = consensus.call_consensus(["ACGT"] * 3 + ["TTTT"] * 5 + ["AC"])
    assert texts[0] == "TTTT" and numbers[3:8] == [0] * 5 and numbers[0] == numbers[8] == 1 and qualities[0] == [1, 1, 1, 1]
    assert consensus.call_consensus([]) == ([], [], [])
    with pytest.raises(SequenceError):
        consensus.call_consensus(["AX"])


def test_consensus_by_group(spark):
    data = [(g, i, s, "I" * len(s) if s else None) for g in "ab" for i, s in enumerate(["ACGT", "ACGT", "TTTT", None])]
    df = spark.createDataFrame(data, "k string, o int, s string, q string")
    assert rows(consensus.consensus_by_group(df, "k", "o", "s", "q").select("k", "consensus", "n_sequences")) == [("a", "ACGT", 2), ("a", "TTTT", 1), ("b", "ACGT", 2), ("b", "TTTT", 1)]
    assert rows(consensus.consensus_by_group(df.limit(0), "k", "o", "s", "q")) == []


def test_correction(spark):
    wl = spark.createDataFrame([("ACTG",), ("TTTN",), ("ACTG",)], "w string")
    reads = spark.createDataFrame([(i, s, "IIII") for i, s in enumerate(["ACTG", "ACTT", "AGCC", "TTTT", None, "AC"])], "id int, s string, q string")
    assert rows(correction.correct_simple(reads, "s", wl, "w")) == [("AC", None), ("ACTG", "ACTG"), ("ACTT", "ACTG"), ("AGCC", None), ("TTTT", "TTTN")]
    got = {r.id: r.corrected for r in correction.correct_posterior(reads, "id", "s", "q", wl, "w").collect()}
    assert got == {0: "ACTG", 1: "ACTG", 2: None, 3: "TTTN", 5: None}
    tied = spark.createDataFrame([("AAAC",), ("AAAG",)], "w string")
    assert rows(correction.correct_posterior(spark.createDataFrame([(1, "AAAA", "IIII")], "id int, s string, q string"), "id", "s", "q", tied, "w")) == [(1, "AAAA", None)]


def _merge(segments):
    out = []
    for s, e in sorted(x for x in segments if x[1] > x[0]):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def test_segment_collections_against_brute_force(spark):
    rng = random.Random(0)
    make = lambda n: [(rng.choice("ab"), s, s + rng.randrange(0, 9)) for s in (rng.randrange(0, 120) for _ in range(n))]
    a, b = make(60), make(30)
    da, db = (spark.createDataFrame(x, "k string, start long, end long") for x in (a, b))
    of = lambda x, k: _merge([(s, e) for g, s, e in x if g == k])
    assert rows(intervals.collapse(da, ["k"])) == [(k, *x) for k in "ab" for x in of(a, k)]
    bounds = spark.createDataFrame([("a", 0, 200), ("b", 0, 200), ("c", 5, 9)], "k string, start long, end long")
    free = [(k, s, e) for k in "ab" for (_, s), (e, _) in zip([(0, 0), *of(a, k)], [*of(a, k), (200, 200)]) if e > s] + [("c", 5, 9)]
    assert rows(intervals.invert(da, bounds, ["k"])) == sorted(free)
    met = [(k, *x) for k in "ab" for x in of(a, k) if any(x[0] < e and s < x[1] for s, e in of(b, k))]
    assert rows(intervals.overlapping_rows(intervals.collapse(da, ["k"]), db, ["k"], bits=3)) == met
    subset = [(k,) for k in "ab" if of(b, k) and all(any(s <= x and y <= e for s, e in of(a + b, k)) for x, y in of(b, k))]
    assert rows(intervals.subset_collections(db, da.unionByName(db), ["k"])) == subset
    with pytest.raises(Exception, match="within their bounds"):
        intervals.invert(da, bounds.withColumn("start", F.lit(100).cast("long")), ["k"]).collect()


def test_touching_stay_apart_and_positions(spark):
    df = spark.createDataFrame([("a", 0, 3), ("a", 3, 5), ("a", 4, 4)], "k string, start long, end long")
    assert rows(intervals.collapse(df, ["k"])) == [("a", 0, 3), ("a", 3, 5)]
    p = spark.createDataFrame([("a", x) for x in (1, 2, 2, 3, 7)], "k string, p long")
    assert rows(intervals.from_positions(p, ["k"], "p")) == [("a", 1, 4), ("a", 7, 8)]
    with pytest.raises(Exception, match="segment"):
        df.select(intervals.valid(F.col("end"), F.lit(1))).collect()


LINES = [
    "#c", '1\th\tgene\t1\t50\t.\t+\t.\tgene_id "G1"; gene_name "n1"; gene_version "2";', '1\th\ttranscript\t10\t40\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; transcript_name "x";',
    '1\th\texon\t10\t15\t.\t+\t.\tgene_id "G1"; transcript_id "T1";', '1\th\texon\t16\t20\t.\t+\t.\tgene_id "G1"; transcript_id "T1";', '1\th\texon\t5\t8\t.\t-\t.\tgene_id "G2"; transcript_id "S";',
    '1\th\texon\t30\t33\t.\t-\t.\tgene_id "G3"; transcript_id "S";', '2\th\ttranscript\t3\t9\t.\t-\t.\tgene_id "G4"; transcript_id "T4";', '2\th\tgene\t1\t4\t.\t-\t.\tgene_id "G5"; tag "a b";', 'broken "',
]


def test_annotation(spark):
    e = annotation.parse_entries(spark.createDataFrame(list(enumerate(LINES)), "line_no long, line string"))
    genes, transcripts, exons, introns = annotation.genes_and_transcripts(e)
    assert rows(genes.select("gene_id", "chromosome", "strand", "gene_name", "start", "end")) == [("G1", "1", "+", "n1", 0, 50), ("G2", "1", "-", "", 4, 8), ("G3", "1", "-", "", 29, 33), ("G4", "2", "-", "", 2, 9), ("G5", "2", "-", "", 0, 4)]
    assert rows(transcripts.select("transcript_id", "gene_id", "start", "end", "pseudo")) == [("G2-S", "G2", 4, 8, False), ("G3-S", "G3", 29, 33, False), ("G5", "G5", 0, 4, True), ("T1", "G1", 9, 40, False), ("T4", "G4", 2, 9, False)]
    assert ("T1", 9, 15) in rows(exons) and ("T1", 15, 20) in rows(exons)
    assert rows(introns) == [("T1", 20, 40), ("T4", 2, 9)]
    assert rows(annotation.genes_and_transcripts(e, use_version=True)[0].select("gene_id"))[0] == ("G1",)
    genome = spark.createDataFrame([("1", "ACGTTGCA" * 20_000), ("2", "AAACCCGGGTTT")], "chromosome string, sequence string")
    cdna = {r.transcript_id: r.sequence for r in annotation.cdna(genome, genes, transcripts, exons).collect()}
    text = "ACGTTGCA" * 20_000
    assert cdna["T1"] == text[9:20] and cdna["G5"] == "GTTT"
    far = spark.createDataFrame([("x", "1", 65_530, 131_080), ("y", "1", 159_990, 170_000), ("z", "9", 0, 5)], "id string, chromosome string, start long, end long")
    assert rows(annotation.cut_segments(genome, far).select("id", "sequence")) == [("x", text[65_530:131_080]), ("y", text[159_990:])]


def test_layouts(spark):
    get = layouts.get_chemistry
    assert get("10xv3").lengths == (28, None) and get("indropsv3").lengths == (8, 14, None) and get("10x2").name == "10xv2"
    assert get("10xv3").to_kallisto_bus_arguments() == {"-x": "0,0,16:0,16,28:1,0,0"}
    assert get("indropsv3").to_kallisto_bus_arguments() == {"-x": "0,0,8,1,0,8:1,8,14:2,0,0"}
    assert get("slideseq2").to_starsolo_arguments() == {"--soloType": "CB_UMI_Complex", "--soloCBposition": ["0_0_0_7", "0_26_0_31"], "--soloUMIposition": ["0_32_0_40"], "--soloCBwhitelist": "None"}
    assert get("smartseqv2").to_starsolo_arguments() == {"--soloType": "SmartSeq"} and get("10xFB").chemistry("GEX").n == 2
    for bad in (lambda: get("10x"), get("smartseq2").to_kallisto_bus_arguments, get("indropsv3").to_starsolo_arguments):
        with pytest.raises(ChemistryError):
            bad()
    with pytest.raises(SubSequenceDefinitionError):
        layouts.Slice(0, None, 1)
    assert get("10xv3").reorder([1, 0]).umi_parser[0].index == 1 and len(layouts.registry()) == 32
    reads = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNO", "QRST")], "a string, b string")
    cut = get("slideseqv2").parse([F.col("a"), F.col("b")])
    assert reads.select(*cut.values()).first() == (["abcdefgh", "ABCDEF"], ["GHIJKLMNO"], ["QRST"])
    with pytest.raises(Exception, match="too short"):
        spark.createDataFrame([("abc", "d")], "a string, b string").select(get("10xv3").parse([F.col("a"), F.col("b")])["umi"]).collect()


def _records(spark, data):
    base = spark.createDataFrame([(i, q, f) for i, (q, f) in enumerate(data)], "record_index long, qname string, flag int")
    return base.withColumn("tags", F.create_map(F.lit("RG"), F.substring("qname", 1, 1)))


def _walk(data, n):
    size, run, filled, second, out = len(data) // n, 0, 0, {}, {}
    for i, (q, f) in enumerate(data):
        if f & 1 and q not in second:
            second[q] = i
            continue
        mates = [second[q], i] if f & 1 else [i]
        for m in mates:
            out[m] = str(run)
        filled += len(mates)
        if filled > size:
            run, filled = run + 1, 0
    return out


@pytest.mark.parametrize("seed", range(3))
def test_split_like_one_pass(spark, seed):
    rng = random.Random(seed)
    data = [(f"p{i}", 5) for i in range(60) for _ in range(2)] + [(f"u{i}", 4) for i in range(50)]
    rng.shuffle(data)
    got = records.split_records(_records(spark, data), n=4 + seed)
    assert {r.record_index: r.split_id for r in got.collect()} == _walk(data, 4 + seed)


def test_split_checks_and_filters(spark):
    with pytest.raises(BamError):
        records.split_records(_records(spark, [("a", 4)]))
    with pytest.raises(Exception, match="mates"):
        records.split_records(_records(spark, [("a", 5)]), F.lit("x")).collect()
    df = _records(spark, [("a", 4), ("b", 4), ("c", 4)])
    assert rows(records.filter_records(df, F.when(F.col("qname") != "a", F.col("qname") == "b")).select("qname")) == [("a",), ("b",)]
    assert rows(records.count_records(df, F.col("qname") > "a")) == [(2,)]


def test_files_round_trip(spark, tmp_path):
    formats.register(spark)
    fastq = tmp_path / "r.fastq.txt"
    fastq.write_bytes(gzip.compress(b"@r1 x y\nACGT\n+\nIIII\n@r2\nAC\n+\nII\n@r3\nA\n"))
    reads = spark.read.format("fastq").load(str(fastq)).drop("file")
    assert rows(reads.select("read_index", "name", "attributes", "sequence")) == [(0, "r1", "x y", "ACGT"), (1, "r2", "", "AC")]
    with pytest.raises(Exception, match="incomplete"):
        spark.read.format("fastq").option("strict", "true").load(str(fastq)).collect()
    fasta = tmp_path / "g.fa"
    fasta.write_text(">c1 a:1 b:\nAC\nGT\n\n>c2\n")
    assert rows(spark.read.format("fasta").load(str(fasta)).select("name", "attributes", "sequence")) == [("c1", {"a": "1", "b": ""}, "ACGT"), ("c2", {}, "")]
    gtf = tmp_path / "a.gtf"
    gtf.write_text("\n".join(LINES[:-1]) + "\n")
    assert spark.read.format("gtf").load(str(gtf)).count() == 8
    made = records.reads_to_records(reads, "rg").withColumns({"tag_types": F.create_map(F.lit("RG"), F.lit("Z"), F.lit("NM"), F.lit("i")), "tags": F.create_map(F.lit("RG"), F.lit("rg"), F.lit("NM"), F.lit("-3"))})
    mapped = made.withColumns({"flag": F.lit(0), "rname": F.lit("c1"), "pos": F.lit(7).cast("long"), "cigar": F.lit("2M1I1D1M")})
    want = rows(made.unionByName(mapped).select("qname", "flag", "rname", "pos", "cigar", "seq", "qual", "tags"))
    header = sam.HEADER + "\n@SQ\tSN:c1\tLN:1000"
    for kind in ("sam", "bam"):
        out = str(tmp_path / kind)
        made.unionByName(mapped).coalesce(1).write.format(kind).mode("append").option("header", header).save(out)
        back = spark.read.format(kind).load(out)
        assert rows(back.select("qname", "flag", "rname", "pos", "cigar", "seq", "qual", "tags")) == want
        assert rows(back.select("record_index")) == [(0,), (1,), (2,), (3,)]
    reads.write.format("fastq").mode("append").save(str(tmp_path / "again"))
    assert rows(spark.read.format("fastq").load(str(tmp_path / "again")).select("name", "sequence", "quality")) == rows(reads.select("name", "sequence", "quality"))


def test_layout_records_and_tags(spark):
    read = lambda s: spark.createDataFrame([(0, "r0", s, "I" * len(s))], "read_index long, name string, sequence string, quality string")
    pair = [read("A" * 16 + "C" * 12), read("GGTT")]
    r = records.layout_records(pair, layouts.get_chemistry("10xv3"), {"cell_barcode": ("CR", "CY"), "umi": "UR"}, "rg").first()
    assert (r.seq, r.flag, r.tags) == ("GGTT", 4, {"RG": "rg", "CR": "A" * 16, "CY": "I" * 16, "UR": "C" * 12})
    with pytest.raises(BamError):
        records.layout_records(pair, layouts.get_chemistry("10xv3"), {"nope": "CR"}, "rg")
    base = records.reads_to_records(read("ACGT"), "rg")
    tag = [F.create_map(F.lit("XX"), F.col("sequence"))]
    assert records.tag_records(base, [read("TT")], tag).first().tags == {"XX": "TT"}
    assert records.tag_records(base, [read("TT")], tag, merge=True).first().tags == {"RG": "rg", "XX": "TT"}
    other = read("TT").withColumn("name", F.lit("zz"))
    assert records.tag_records(base, [other], tag, check_name=False).first().tags == {"RG": "rg"}
    with pytest.raises(Exception, match="no read"):
        records.tag_records(base, [other], tag).collect()


def test_stream_counts(spark, tmp_path):
    from strandweave.streaming import reads as stream

    layout = layouts.Chemistry("s", 1, layouts.Strand.FORWARD, {"cell_barcode": layouts.Parser((layouts.Slice(0, 0, 4),)), "umi": layouts.Parser((layouts.Slice(0, 4, 2),))})
    data = [(i, f"r{i % 5}", ("ACGT" if i % 2 else "TTTT") + "AC", "IIIIII", datetime(2024, 1, 1, 0, 0, i % 5)) for i in range(10)]
    spark.createDataFrame(data, stream.SCHEMA).write.parquet(str(tmp_path / "in"))
    wl = spark.createDataFrame([("ACGT",)], "w string")
    parsed = stream.barcodes(stream.read_stream(spark, str(tmp_path / "in")), layout, wl, "w")
    q = stream.counts_by_window(parsed).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.exception() is None
    batch = spark.createDataFrame(data, stream.SCHEMA)
    assert stream.barcodes(batch, layout, wl, "w").where("corrected is not null").count() == 5


def test_helpers(tmp_path):
    assert dicts.merge_dictionaries({"a": {"x": 1}, "b": 2}, {"a": {"x": 3, "y": 4}}) == {"a": {"x": 4, "y": 4}, "b": 2}
    assert list(dicts.flatten_iter([1, ["ab", (2, [3])]])) == [1, "ab", 2, 3] and dicts.flatten_dict_values({"a": {"b": 1}, "c": 2}) == [1, 2]
    tries = []
    assert processes.retry(lambda: tries.append(1) or (1 / 0 if len(tries) < 3 else "ok"), 3) == "ok"
    with pytest.raises(ZeroDivisionError):
        processes.retry_decorator(1)(lambda: 1 / 0)()
    assert processes.run_executable(["echo", "hi"])[1] == "hi\n"
    with pytest.raises(subprocess.CalledProcessError):
        processes.run_executable(["false"])
    a = tmp_path / "a"
    a.write_text(" x \n\ny\n")
    packed = files.compress(str(a), str(tmp_path / "b"))
    assert files.is_gzip(packed) and not files.is_gzip(str(a)) and files.is_gzip("none.gz") and files.is_remote("http://x/y")
    files.concatenate_text(str(a), packed, out=str(tmp_path / "c"))
    assert (tmp_path / "c").read_text() == "x\ny\nx\ny\n"
    assert files.read_pickle(files.write_pickle({"k": 1}, str(tmp_path / "p"))) == {"k": 1}
    both = executables.IS_INTEGER & executables.IS_POSITIVE
    assert str(both) == "(IsInteger AND IsPositive)" and both("3") and not both("-3") and not executables.IS_FLOAT("3.0") and not executables.IS_INTEGER("inf")
    echo = executables.BinaryExecutor(executables.Binary("echo"), {"n": executables.Argument.named("-x", before=both), "f": executables.Argument.constant("--flag"), "p": executables.Argument.positional(required=True)})
    assert echo({"f": None, "n": 2, "p": "end"}).stdout == "--flag -x 2 end\n"
    with pytest.raises(ArgumentError):
        echo({"n": -2, "p": "x"})
    for bad in ({"p": 1, "z": 1}, {"n": 1}):
        with pytest.raises(BinaryError):
            echo(bad)
    with pytest.raises(BinaryError):
        executables.Binary("no-such-program")
    with pytest.raises(ValueError), log.logger.namespaced_context("x"):
        raise ValueError
    assert log.logger.namespace == "" and np is not None


def test_entry_names(spark):
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {"p1_found", "p3_found", "p4_found", "p5_found", "p6_found"} <= set(q)
