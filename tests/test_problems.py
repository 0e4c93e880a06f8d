"""The core operators on dirty fixtures, against brute force, and the queries against their SQL."""

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

from strandweave.operators import annotation_lines, coverage, key_totals, references, widen
from strandweave.plans import problem_sql, problems

DEFS = [("n_exons", "integer", False, "NA"), ("gc", "double", False, "-"), ("ok", "boolean", False, "unset"), ("day", "date", False, "0000-00-00"), ("name", "string", False, "-"), ("tag", "string", True, "-")]


def defs(spark):
    return spark.createDataFrame(DEFS, "attr_key string, value_type string, is_multi boolean, missing_marker string")


EAV = "line_no long, attr_key string, attr_value string, entity string, value string, faults string"


def eav(spark, data):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in data], EAV)


def test_widen_types_and_faults(spark):
    data = [
        (1, "N-Exons", " 07 "), (1, "n_exons", "7"), (1, "n exons", None), (1, "GC", "1.50"), (1, "gc", "1.5e0"), (1, "ok", "YES"), (1, "ok", "1"), (1, "day", "2024-02-29"), (1, "tag", "b"), (1, "tag", "a"), (1, "tag", "b"),
        (2, "n_exons", "2147483648"), (2, "gc", "."), (2, "ok", "maybe"), (2, "day", "2023-02-29"), (2, "name", "Na"), (2, "name", "na"),
        (3, "n_exons", "3"), (3, "n_exons", "x"), (3, "gc", "-"), (3, "ok", "UNSET"), (3, "tag", ""),
        (4, "unknown", "1"), (5, None, "1"), (None, "gc", "1"), (6, "name", "a" * 100_000), (7, "gc", "-0"), (7, "gc", "0.0"), (8, "n_exons", "5\n"),
    ]
    wide = widen.widen(eav(spark, data), defs(spark), "line_no")
    by = {r.line_no: r for r in wide.collect()}
    assert set(by) == {1, 2, 3, 4, 5, 6, 7, 8}
    assert (by[1].n_exons, by[1].gc, by[1].ok, str(by[1].day), by[1].name, by[1].tag, by[1].faults) == (7, 1.5, True, "2024-02-29", None, ["a", "b"], {})
    assert by[2].faults == {"n_exons": "unreadable", "gc": "unreadable", "ok": "unreadable", "day": "unreadable", "name": "conflict"}
    assert by[3].n_exons == 3 and by[3].faults == {} and by[3].tag is None
    assert by[4].faults == {} and by[6].name == "a" * 100_000 and by[7].faults == {} and by[8].faults == {"n_exons": "unreadable"}
    assert rows(widen.cell_faults(wide, "line_no", ["gc"])) == [(2, "gc", "unreadable")]


def test_widen_empty_and_skewed(spark):
    assert rows(widen.widen(eav(spark, []), defs(spark), "line_no")) == []
    assert rows(widen.widen(eav(spark, [(1, "a", "b")]), defs(spark).limit(0), "line_no")) == [(1, None)]
    hot = [(1, "n_exons", str(i % 2)) for i in range(5000)] + [(i, "n_exons", "4") for i in range(2, 50)]
    wide = widen.widen(eav(spark, hot), defs(spark), "line_no")
    assert wide.where("faults['n_exons'] = 'conflict'").count() == 1 and wide.count() == 49


def test_widen_joins_without_moving(spark):
    plan = widen.widen(eav(spark, [(1, "gc", "1")]), defs(spark), "line_no")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "CartesianProduct" not in plan


def test_key_totals_against_brute_force(spark):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    data = [(rng.choice(["hot"] * 20 + ["a", "b", None, "", "ß"]), rng.choice([None, 0, 5, 2**60 if rng.random() < 0.001 else 7]), None if rng.random() < 0.1 else t0 + timedelta(microseconds=rng.randrange(10**12)), 1) for _ in range(4000)]
    got = {r[0]: tuple(r)[1:] for r in key_totals.key_totals(spark.createDataFrame(data, "k string, n long, at timestamp, key long"), "k", "n", "at").collect()}
    want = defaultdict(lambda: [0, 0, None, None])
    for k, n, at, _ in data:
        w = want[k]
        w[0] += 1
        w[1] += n or 0
        if at:
            w[2], w[3] = min(w[2] or at, at), max(w[3] or at, at)
    assert got == {k: tuple(v) for k, v in want.items()}


def test_key_totals_blocks_and_empty(spark, monkeypatch):
    empty = spark.createDataFrame([], "k string, n long, at timestamp")
    assert rows(key_totals.key_totals(empty, "k", "n", "at")) == []
    assert rows(key_totals.frequent_keys(key_totals.key_totals(empty, "k", "n", "at"), 0.05)) == []
    monkeypatch.setattr(key_totals, "BLOCK_KEYS", 10)
    import pyarrow as pa

    batch = lambda a: pa.RecordBatch.from_arrays([pa.array(list(map(str, range(a, a + 40)))), pa.array([1] * 40), pa.array([5] * 40)], names=["key", "length", "us"])
    blocks = list(key_totals._accumulate(iter([batch(0), batch(20)])))
    assert len(blocks) == 2 and sum(sum(b.column(1).to_pylist()) for b in blocks) == 80


def test_frequent_keys_are_exact(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 5 + [(None,)] * 50 + [(str(i),) for i in range(89)], "k string").selectExpr("k", "1L as n", "timestamp'2024-01-01' as at")
    assert rows(key_totals.frequent_keys(key_totals.key_totals(df, "k", "n", "at"), 0.05).select("key_value")) == [("a",)]


GOOD = 'c\ts\texon\t5\t9\t.\t+\t0\tgene_id "g;1"; n 5; n "6" ; ;'
LINES = [
    (GOOD, None), (GOOD + "\r", None), ("#x", "comment"), (None, "columns"), ("", "columns"), ("   ", "columns"), (GOOD + "\t", "columns"), (GOOD.replace("\t", " ", 1), "columns"),
    (GOOD.replace('"g;1"', '"g;1'), "quoting"), (GOOD.replace("n 5", "n"), "quoting"), (GOOD.replace("n 5", 'n 5"'), "quoting"), (GOOD.replace('"6"', '"6"7'), "quoting"), (GOOD + "\r\r", "quoting"),
    (GOOD.replace("\t5\t", "\t0\t"), "value"), (GOOD.replace("\t5\t", "\t10\t"), "value"), (GOOD.replace("\t5\t", "\t+5\t"), "value"), (GOOD.replace("\t9\t", "\t9223372036854775807\t"), None),
    (GOOD.replace("\t9\t", "\t9223372036854775808\t"), "value"), (GOOD.replace("\t9\t", "\t" + "0" * 40 + "9\t"), None), (GOOD.replace("\t.\t", "\t1e5\t"), None), (GOOD.replace("\t.\t", "\t.5\t"), "value"),
    (GOOD.replace("\t+\t", "\t?\t"), "value"), (GOOD.replace("\t0\t", "\t3\t"), "value"), (" " + GOOD, None), (GOOD.replace("c\t", " \t", 1), "value"), (GOOD.replace("\t9\t", "\t９\t"), "value"),
    ("c\ts\texon\t5\t9\t.\t+\t0\t", None), ("c\ts\texon\t0\t9\t.\t+\t0\tbad", "quoting"), (GOOD.replace("5", "5" * 3).replace("\t9\t", "\t999\t"), None), ("x" * 200_000, "columns"), (GOOD.replace("g;1", "g" * 200_000), None),
]


def test_lines_are_parsed_or_set_apart(spark):
    df = spark.createDataFrame([(i, line, "clash") for i, (line, _) in enumerate(LINES)], "raw_no long, line string, reason string")
    got = {r.raw_no: r for r in annotation_lines.parse_lines(df, "raw_no", "line").collect()}
    for i, (line, reason) in enumerate(LINES):
        if reason == "comment":
            assert i not in got
        else:
            assert got[i].reason == reason, (line[:80] if line else line, got[i])
    first = got[0]
    assert (first.chromosome, first.feature, first.start_pos, first.end_pos, first.strand, first.attributes) == ("c", "exon", 5, 9, "+", {"gene_id": "g;1", "n": "6"})


def test_lines_bisected_like_strict(spark):
    rng = random.Random(1)
    lines = [rng.choice(LINES)[0] if rng.random() < 0.1 else GOOD for _ in range(9000)]
    lines = [x for x in lines if x is None or not x.startswith("#") and not x.endswith("\r")]
    df = spark.createDataFrame(list(enumerate(lines)), "raw_no long, line string").coalesce(1)
    got = {r.raw_no: r.reason for r in annotation_lines.parse_lines(df, "raw_no", "line").collect()}
    assert got == {i: (x if isinstance(x := annotation_lines.diagnose(line), str) else None) for i, line in enumerate(lines)}
    assert rows(annotation_lines.parse_lines(df.limit(0), "raw_no", "line")) == []


def _orphans(refs, parents):
    out = set()
    for i, key, at in refs:
        k = (key or "").strip(" ").upper()
        if not k:
            continue
        own = [(a, r) for p, a, r in parents if (p or "").strip(" ").upper() == k]
        if at is not None and any(a is not None and a <= at and (r is None or r > at) for a, r in own):
            continue
        late = own and at is not None and all(a is not None and a > at for a, r in own)
        out.add((i, "missing" if not own else "late" if late else "deleted"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_orphans_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    moment = lambda: t0 + timedelta(microseconds=rng.randrange(40))
    keys = [f"VX{i:04d}" for i in range(30)] + ["LGX", "lg01", " LG01 ", "9" * 40, "A1", "A01", "", " ", None, "Ä5"]
    parents = [(rng.choice(keys), None if rng.random() < 0.05 else moment(), None if rng.random() < 0.5 else moment()) for _ in range(60)]
    refs = [(i, rng.choice(keys + ["VX0003"] * 40), None if rng.random() < 0.05 else moment()) for i in range(600)]
    if seed == 2:
        monkeypatch.setattr(references, "_hot_blocks", lambda r: {(x.ref_table, x.prefix, x.width, x.block): 3 for x in r.select("ref_table", "prefix", "width", "block").distinct().collect()})
    r = spark.createDataFrame([(*x, "c") for x in refs], "id long, genes string, at timestamp, ref_table string")
    p = spark.createDataFrame([(*x, 1) for x in parents], "k string, added timestamp, removed timestamp, extra int")
    got = references.orphan_references(r, {"genes": p}, "id", "at")
    assert {(x.id, x.fault) for x in got.collect()} == _orphans(refs, parents)
    assert got.count() == len(_orphans(refs, parents))


def test_orphans_of_empty_tables(spark):
    r = spark.createDataFrame([(1, "a", datetime(2024, 5, 6))], "id long, genes string, at timestamp")
    p = spark.createDataFrame([], "k string, added timestamp, removed timestamp")
    got = references.orphan_references(r, {"genes": p}, "id", "at")
    assert rows(got.select("id", "ref_key", "fault")) == [(1, "A", "missing")]
    assert rows(references.orphans_by_period(got, "at")) == [("genes", "2024-05", "missing", 1)]
    assert rows(references.orphan_references(r.limit(0), {"genes": p}, "id", "at")) == []


def _merged(intervals):
    out = []
    for key in {k for k, _, _ in intervals if k is not None}:
        blocks = []
        for s, e in sorted((s, e) for k, s, e in intervals if k == key and s is not None and e is not None and s <= e):
            if blocks and s <= blocks[-1][1]:
                blocks[-1][1] = max(blocks[-1][1], e)
            else:
                blocks.append([s, e])
        out += [(key, "block", s, e) for s, e in blocks]
        out += [(key, "gap", a[1] + 1, b[0] - 1) for a, b in zip(blocks, blocks[1:]) if b[0] - a[1] > 1]
    return sorted(out)


@pytest.mark.parametrize("seed,bits", [(0, 3), (1, 4), (2, 16), (3, 2), (4, 3)])
def test_coverage_against_brute_force(spark, seed, bits):
    rng = random.Random(seed)
    data = []
    for _ in range(800):
        s = rng.choice([None, rng.randrange(-50, 900)]) if rng.random() < 0.05 else rng.randrange(-50, 900)
        e = None if s is None or rng.random() < 0.02 else s + rng.choice([0, 0, 1, 2, 3, 7, 8, 30, 200 if rng.random() < 0.1 else 1, -1])
        data.append((rng.choice(["t1", "t2", "t3", "t3", None, ""]), s, e))
    data += [("t4", 1, 2**62), ("t4", 5, 6), ("t4", 2**62 + 1, 2**62 + 5), ("t5", 1, 2), ("t5", 3, 4), ("t5", 4, 4)]
    df = spark.createDataFrame([(*x, "c", 1) for x in data + data[:50]], "entity string, a long, b long, kind string, shard int")
    assert rows(coverage.merge_intervals(df, "entity", "a", "b", bits)) == _merged(data)


def test_coverage_empty(spark):
    assert rows(coverage.merge_intervals(spark.createDataFrame([], "k string, s long, e long"), "k", "s", "e")) == []


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in ("gtf_entries", "gtf_attributes", "gtf_attribute_defs", "gtf_lines", "genes", "transcripts", "chromosomes", "fasta_entries"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = problems.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    df = df.select(*[F.unix_micros(c).alias(c) if dict(df.dtypes)[c] == "timestamp" else F.col(c) for c in cols])
    want = con.execute(f"select {', '.join(cols)} from ({problem_sql.SQL[name]})").fetchall()
    micros = lambda x: int(x.timestamp() * 1_000_000 + 0.5) if isinstance(x, datetime) else x
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted((tuple(map(micros, r)) for r in want), key=key)


def test_line_pattern_of_found_reasons():
    assert re.fullmatch(annotation_lines.ITEMS, 'a "b;c" ; d e; ')


def test_widen_leaves_no_table_and_takes_many_attributes(spark, monkeypatch):
    monkeypatch.setattr(widen, "MAX_FILES", 8)
    many = spark.createDataFrame([(f"a{i}", "integer", False, "-") for i in range(30)], "attr_key string, value_type string, is_multi boolean, missing_marker string")
    data = [(e, f"A-{i}", str(e * i)) for e in range(20) for i in range(30) if (e + i) % 3] + [(99, "a1", "x"), (98, "other", "1")]
    got = {r.line_no: r for r in widen.widen(eav(spark, data), many, "line_no").collect()}
    assert all(got[e][f"a{i}"] == (e * i if (e + i) % 3 else None) for e in range(20) for i in range(30))
    assert got[99].faults == {"a1": "unreadable"} and got[98].faults == {} and len(got) == 22
    assert not [t for t in spark.catalog.listTables() if "narrow" in t.name]


def test_blocks_are_parsed_as_units(monkeypatch):
    seen = []
    parse = annotation_lines.parse_block
    monkeypatch.setattr(annotation_lines, "parse_block", lambda lines: seen.append(len(lines)) or parse(lines))
    assert annotation_lines.isolate([GOOD] * 64) == (list(range(64)), []) and seen == [64]
    seen.clear()
    parsed, alone = annotation_lines.isolate([GOOD] * 20 + [None] + [GOOD] * 43)
    assert parsed == [i for i in range(64) if i != 20] and alone == [(20, "columns")]
    # The block, then at each level the failing half and its other half.
    assert sorted(seen, reverse=True) == [64, 32, 32, 16, 16, 8, 8, 4, 4, 2, 2, 1, 1]
    seen.clear()
    assert annotation_lines.isolate([GOOD + "\n" + GOOD, GOOD])[1] == [(0, "columns")]


def test_bad_lines_of_a_line_break(spark):
    lines = [GOOD.replace("g;1", "g\n1"), GOOD + "\n", "\n"]
    df = spark.createDataFrame(list(enumerate(lines)), "raw_no long, line string")
    got = {r.raw_no: r.reason for r in annotation_lines.parse_lines(df, "raw_no", "line").collect()}
    assert got == {i: (x if isinstance(x := annotation_lines.diagnose(line), str) else None) for i, line in enumerate(lines)}


def test_salts_of_hot_blocks():
    assert references.salts_of([("a", 500), ("b", 100), ("c", 25), ("d", 26)], 1000, 40) == {"a": 20, "b": 4, "d": 2}
    assert references.salts_of([("a", 1)], 1, 8) == {"a": 8} and references.salts_of([], 0, 8) == {}


def test_hot_blocks_are_found_at_any_size(spark):
    data = [("genes", "G", 4, 0)] * 30 + [("genes", "G", 4, i) for i in range(1, 71)]
    refs = spark.createDataFrame(data, "ref_table string, prefix string, width int, block long")
    slots = references.HOT_SHARE * 4
    assert references._hot_blocks(refs) == {("genes", "G", 4, 0): -(-30 * slots // 100)}
    assert references._hot_blocks(refs.limit(0)) == {}


def test_key_totals_do_not_wrap(spark):
    df = spark.createDataFrame([("a", 2**62), ("a", 2**62), ("a", 2**62)], "k string, n long").coalesce(1).selectExpr("k", "n", "timestamp'2024-01-01' as at")
    with pytest.raises(Exception, match="64 bits"):
        key_totals.key_totals(df, "k", "n", "at").collect()
