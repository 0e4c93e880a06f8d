"""Files to files, with headers, and records of several files."""

from conftest import rows
from pyspark.sql import functions as F

from strandweave.functions import layouts
from strandweave.operators import records
from strandweave.sources import conversion, formats


def _fastq(path, names, sequence):
    path.write_text("".join(f"@{n} x\n{sequence(i)}\n+\n{'I' * len(sequence(i))}\n" for i, n in enumerate(names)))
    return str(path)


def test_reads_become_records_with_a_group(spark, tmp_path):
    formats.register(spark)
    a = _fastq(tmp_path / "a.fastq", ["r0", "r1", "r2"], lambda i: "ACGT"[: i + 1])
    out = conversion.fastq_to_bam(spark, a, str(tmp_path / "one"), "g")
    assert conversion.header_like(out).splitlines()[1] == "@RG\tID:g\tSM:g"
    back = spark.read.format("bam").load(out)
    assert rows(back.select("qname", "flag", "seq", "tags")) == [("r0", 4, "A", {"RG": "g"}), ("r1", 4, "AC", {"RG": "g"}), ("r2", 4, "ACG", {"RG": "g"})]
    kept = records.filter_records(back, F.col("qname") != "r1")
    again = conversion.write_like(kept, out, str(tmp_path / "kept"))
    assert conversion.header_like(again) == conversion.header_like(out)
    assert rows(spark.read.format("bam").load(again).select("qname")) == [("r0",), ("r2",)]


def test_several_files_a_side(spark, tmp_path):
    formats.register(spark)
    sides = []
    for side, bases in (("R1", "A" * 28), ("R2", "C" * 20)):
        folder = tmp_path / side
        folder.mkdir()
        for lane in range(2):
            _fastq(folder / f"L{lane}.fastq", [f"l{lane}r{i}" for i in range(3 - (side == "R2" and lane))], lambda i, b=bases: b[: len(b) - (b[0] == "C") * i])
        sides.append(str(folder))
    zipped = records.zip_reads([spark.read.format("fastq").load(s) for s in sides])
    assert rows(zipped.select("file_no", "read_index", F.col("reads")[0]["name"], F.col("reads")[1]["name"])) == [(n, i, f"l{n}r{i}", f"l{n}r{i}") for n, i in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1))]
    record = F.when(F.col("reads")[1]["name"] != "l0r1", F.struct(F.col("reads")[0]["name"].alias("qname"), F.col("reads")[1]["sequence"].alias("seq"), F.col("reads")[1]["quality"].alias("qual")))
    out = spark.read.format("bam").load(conversion.fastqs_to_bam(spark, sides, record, str(tmp_path / "zip"), "g"))
    assert [r[0] for r in out.orderBy("file", "record_index").select("qname").collect()] == ["l0r0", "l0r2", "l1r0", "l1r1"]
    cut = conversion.fastqs_to_bam_with_chemistry(spark, sides, layouts.get_chemistry("10xv3"), {"umi": ("UR", "UY")}, str(tmp_path / "cut"), "g")
    assert rows(spark.read.format("bam").load(cut).select("qname", F.col("tags")["UR"])) == [(f"l{n}r{i}", "A" * 12) for n, i in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1))]
    made = records.reads_to_records(spark.read.format("fastq").load(sides[0]), "g")
    split = records.split_records(made, n=2, check_pairs=False)
    assert [r[0] for r in split.orderBy("file", "record_index").select("split_id").collect()] == ["0"] * 4 + ["1"] * 2
