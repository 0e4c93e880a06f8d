"""What the queries of ``reference`` give, as SQL over the same tables."""

from strandweave.functions import layouts
from strandweave.plans.problem_sql import LINES

_HEX = "0123456789abcdef"


def _md5(k: str) -> str:
    return f"md5(cast({k} as varchar))"


def _dna(k: str) -> str:
    return f"translate({_md5(k)}, '{_HEX}', 'ACGTACGTACGTACGT')"


def _codes(k: str) -> str:
    return f"translate({_md5(k)}, '{_HEX}', 'ACGTRYSWKMBDHVN-')"


def _qual(k: str) -> str:
    return f"translate({_md5(k)}, 'abcdef', '!/AEI#')"


def _bit(c: str) -> str:
    """The number of a code's bit set."""
    return f"cast(strpos('0123456789ABCDEF', translate(upper({c}), 'ACGTRYSWKMBDHVN-', '12485A69C3EDB7F0')) - 1 as integer)"


def _hamming(a: str, b: str, n: str) -> str:
    return f"cast(list_sum([case when ({_bit(f'substr({a}, i, 1)')} & {_bit(f'substr({b}, i, 1)')}) = 0 then 1 else 0 end for i in range(1, {n} + 1)]) as integer)"


def _complement(s: str) -> str:
    return f"translate(upper({s}), 'ACGTNRYSWKMBDHV', 'TGCANYRWSMKVHDB')"


def _cigar(r: str, q: str, mismatch: bool) -> str:
    x = f"when ({_bit(f'substr({r}, i, 1)')} & {_bit(f'substr({q}, i, 1)')}) = 0 then 'X' " if mismatch else ""
    states = f"array_to_string([case when substr({r}, i, 1) = '-' then 'I' when substr({q}, i, 1) = '-' then 'D' {x}else 'M' end for i in range(1, length({r}) + 1)], '')"
    return f"array_to_string([length(x) || x[1] for x in regexp_extract_all({states}, 'M+|I+|D+|X+')], '')"


_BARCODES = f"select cast(i as bigint) as barcode_no, substr({_dna('i')}, 1, 12) as barcode from range(40) t(i)"
_READS = f"select event_id, user_id % 200 as group_no, substr({_codes('event_id')}, 1, 12) as s, substr({_qual('event_id')}, 1, 12) as q from events"
_BARCODED = f"""barcoded as (
  select event_id, substr({_qual('event_id')}, 1, 12) as quality,
    case when (event_id // 3) % 2 = 0 then clean else substr(clean, 1, p - 1) || ['G','A','T','T','A','C','A','N'][(event_id // 7) % 8 + 1] || substr(clean, p + 1) end as barcode
  from (select event_id, substr({_dna('event_id % 40')}, 1, 12) as clean, cast((event_id // 40) % 12 + 1 as integer) as p from events)
),
wl as (select distinct barcode as w from ({_BARCODES})),
near as (
  select s, w, mm from (select s, w, {_hamming('s', 'w', '12')} as mm
    from (select distinct barcode as s from barcoded where barcode not in (select w from wl)), wl) where mm <= 1
)"""
_SIMPLE = f"""{_BARCODED},
fixed as (
  select s, case when count(case when mm = 0 then 1 end) = 1 then min(case when mm = 0 then w end)
    when count(case when mm = 0 then 1 end) = 0 and count(*) = 1 then min(w) end as w from near group by s
),
simple as (select b.barcode, coalesce(wl.w, f.w) as corrected from (select distinct barcode from barcoded) b
  left join wl on wl.w = b.barcode left join fixed f on f.s = b.barcode)"""
_WEIGHTS = f"""weights as (
  select group_no, position, {', '.join(f"cast(sum(case when (m & {bit}) > 0 then q else 0 end) as bigint) as {b}" for b, bit in zip('acgt', (1, 2, 4, 8)))}
  from (select group_no, cast(i - 1 as integer) as position, {_bit('substr(s, i, 1)')} as m, ascii(substr(q, i, 1)) - 33 as q
        from ({_READS}) r, range(1, 13) t(i)) group by group_no, position
)"""
_SEGMENTS = "seg as (select l_suppkey as k, l_orderkey % 2 as half, l_partkey as s, cast(l_partkey + floor(l_quantity / 10) as bigint) as e from lineitem)"


def _collapsed(name: str, source: str, keys: str = "k") -> str:
    """A chain of CTEs that merges overlapping segments (keys, s, e)."""
    return f"""{name}_r as (select *, max(e) over (partition by {keys} order by s, e rows between unbounded preceding and 1 preceding) as reach from ({source}) where e > s),
{name}_i as (select *, sum(case when reach is null or s >= reach then 1 else 0 end) over (partition by {keys} order by s, e rows unbounded preceding) as island from {name}_r),
{name} as (select {keys}, min(s) as s, max(e) as e from {name}_i group by {keys}, island)"""


def _gaps(segments: str, bounds: str, keys: str) -> str:
    """The free parts of bounds (keys, s, e) between collapsed segments."""
    return f"""select {keys}, a as "start", b as "end" from (
  select x.{keys}, coalesce(lag(x.e) over w, o.s) as a, x.s as b from {segments} x join {bounds} o on o.{keys} = x.{keys} window w as (partition by x.{keys} order by x.s)
  union all select o.{keys}, coalesce(m.e, o.s), o.e from {bounds} o left join (select {keys}, max(e) as e from {segments} group by {keys}) m on m.{keys} = o.{keys}
) where b > a"""


_LINE = r"^([^\t]+)\t[^\t]*\t([^\t]+)\t(\d+)\t(\d+)\t[^\t]*\t([+.-])\t[^\t]*\t(.*)$"
_PARSED = rf"""parsed as (
  select raw_no as line_no, {', '.join(f"nullif(regexp_extract(line, '{_LINE}', {i}), '') as {n}" for i, n in ((1, 'chromosome'), (2, 'feature'), (3, 'start_text'), (4, 'end_text'), (5, 'strand'), (6, 'attributes')))}
  from gtf_lines where line is not null and not starts_with(line, '#')
),
numbered as (select *, try_cast(start_text as bigint) as "start", try_cast(end_text as bigint) as "end" from parsed)"""
_PAIR = r'(\S+?)\s*"(.+?)";?'


def _attribute(name: str) -> str:
    plain = "replace(coalesce(attributes, ''), ' ', '')"
    return f"list_filter(list_zip(regexp_extract_all({plain}, '{_PAIR}', 1), regexp_extract_all({plain}, '{_PAIR}', 2)), lambda x: x[1] = '{name}')[-1][2] as {name}"


def _item(name: str) -> str:
    """The last value of a name in a well-formed ninth column."""
    return f"""list_filter([[regexp_extract(x, '^ *([^ ;"]+)', 1), coalesce(nullif(regexp_extract(x, '"([^"]*)"', 1), ''), trim(regexp_extract(x, '^ *[^ ;"]+ +([^";]*)', 1), ' '))]
  for x in regexp_extract_all(c[9], '[^ ;"]+ +("[^"]*"|[^ ;"][^;"]*)')], lambda y: y[1] = '{name}')[-1][2]"""


def _features(place: str, joined: str = "") -> str:
    return rf"""{LINES},
entries as (
  select raw_no as line_no, trim(c[1], ' ') as chromosome, trim(c[3], ' ') as feature, cast(trim(c[4], ' ') as bigint) as p, cast(trim(c[5], ' ') as bigint) as q, trim(c[7], ' ') as strand,
    {_item('gene_id')} as gene_id, {_item('transcript_id')} as transcript_id, coalesce({_item('gene_name')}, '') as gene_name, coalesce({_item('transcript_name')}, '') as transcript_name
  from judged where reason is null
),
f as (select line_no, feature, strand, gene_id, transcript_id, gene_name, transcript_name, {place} from entries {joined} where feature in ('exon', 'transcript', 'gene') and gene_id is not null),
gene_last as (select gene_id, max(case when feature = 'gene' then line_no end) as l from f group by gene_id),
genes_ as (
  select f.gene_id,
    coalesce(max_by(chromosome, line_no) filter (where feature = 'gene'), min_by(chromosome, line_no)) as chromosome,
    coalesce(max_by(strand, line_no) filter (where feature = 'gene'), min_by(strand, line_no)) as strand,
    coalesce(max_by(gene_name, line_no) filter (where gene_name <> ''), '') as gene_name,
    min(line_no) as first_seen, min(s) filter (where line_no >= coalesce(l, -1)) as s, max(e) filter (where line_no >= coalesce(l, -1)) as e
  from f join gene_last g on g.gene_id = f.gene_id group by f.gene_id
),
t0 as (select * from f where transcript_id is not null and feature <> 'gene'),
t as (select t0.* exclude (transcript_id), case when n > 1 then gene_id || '-' || t0.transcript_id else t0.transcript_id end as transcript_id
      from t0 join (select transcript_id, count(distinct gene_id) as n from t0 group by 1) c on c.transcript_id = t0.transcript_id),
t_last as (select transcript_id, max(case when feature = 'transcript' then line_no end) as l from t group by 1),
real_ as (
  select t.transcript_id, min(gene_id) as gene_id, coalesce(max_by(transcript_name, line_no) filter (where transcript_name <> ''), '') as transcript_name,
    min(s) filter (where line_no >= coalesce(l, -1)) as s, max(e) filter (where line_no >= coalesce(l, -1)) as e, false as pseudo
  from t join t_last x on x.transcript_id = t.transcript_id group by t.transcript_id
),
lone as (select gene_id as transcript_id, gene_id, '' as transcript_name, s, e, true as pseudo from genes_ where gene_id not in (select gene_id from real_)),
transcripts_ as (select * from real_ union all select * from lone),
{_collapsed('ex', "select transcript_id, s, e from t where feature = 'exon'", 'transcript_id')},
exons_ as (select transcript_id, s, e from ex union all select transcript_id, s, e from lone),
{_collapsed('inner_', "select x.transcript_id, greatest(x.s, o.s) as s, least(x.e, o.e) as e from exons_ x join transcripts_ o on o.transcript_id = x.transcript_id", 'transcript_id')},
introns_ as ({_gaps('inner_', 'transcripts_', 'transcript_id')})"""


_OWN = _features("chromosome, p - 1 as s, q as e")
_FOLDED = _features("'LG0' || ((length(gene_id) + ascii(right(gene_id, 1))) % 5) as chromosome, p % bases as s, p % bases + 1 + (q - p) % bases as e", "join (select doc_id % 5 as place, count(*) * 32 as bases from documents group by 1) l on l.place = (length(gene_id) + ascii(right(gene_id, 1))) % 5")
_GENOME = f"genome as (select 'LG0' || (doc_id % 5) as chromosome, string_agg({_dna('doc_id')}, '' order by doc_id) as sequence from documents group by 1)"
_STRANDED = f"case when strand = '-' then reverse({_complement('sq')}) else sq end as sequence"
_ABOUT = "' gene_id:' || g.gene_id || ' gene_name:' || g.gene_name"
_PLACE = "' chr:' || g.chromosome || ' start:' || (o.s + 1) || ' end:' || o.e || ' strand:' || g.strand as header"


def _fastq(salt: str) -> str:
    k = f"('{salt}' || event_id)"
    two = lambda f: f"{f(k)} || {f(f'({k} || {chr(39)}b{chr(39)})')}"
    return f"select event_id as read_index, 'read' || event_id as name, {two(_dna)} as sequence, {two(_qual)} as quality from events"


_RECORDS = f"""rec as (
  select read_index as record_index, sequence as seq, quality as qual, 'p' || (read_index // 2) as qname,
    case when (read_index // 2) % 5 = 0 or count(*) over (partition by read_index // 2) < 2 then 4 else 5 end as flag, 'g' || ((read_index // 2) % 3) as rg from ({_fastq('0')})
)"""


def _layout_sql(c: layouts.Chemistry) -> str:
    reads = ", ".join(f"rpad(r{i}.sequence, 96, 'ACGT') as s{i}" for i in range(c.n))
    joins = f"({_fastq('0')}) r0 " + " ".join(f"join ({_fastq(str(i))}) r{i} on r{i}.read_index = r0.read_index" for i in range(1, c.n))

    def part(s: layouts.Slice) -> str:
        if s.start is None:
            return f"s{s.index}"
        return f"substr(s{s.index}, {s.start + 1}" + (")" if s.length is None else f", {s.length})")

    fields = ", ".join(f"{' || '.join(map(part, p))} as {k}" for k, p in c.parsers.items())
    # The padding repeats its pattern from its own start, in both engines.
    return f"select read_index, {fields} from (select r0.read_index, {reads} from {joins})"


def _value(x: object) -> str:
    return "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_REGISTRY = "select * from (values " + ", ".join(
    "(" + ", ".join(map(_value, (c.name, c.kind, c.n, c.strand.name, field, i, s.index, s.start, s.length, s.end, c.whitelist))) + ")"
    for x in layouts.registry() for c in (x.chemistries.values() if isinstance(x, layouts.Multimodal) else [x]) for field, p in c.parsers.items() for i, s in enumerate(p)
) + ") t(name, kind, n_reads, strand, field, part_no, read_index, slice_start, slice_length, slice_end, whitelist)"
_AMBIGUOUS = f"""reads as (
  select distinct case when (event_id // 3) % 2 = 0 then r else 'A' || substr(r, 2) end as s
  from (select event_id, substr(substr({_dna('event_id % 40')}, 1, 16), 1, cast(16 - event_id % 17 as integer)) || repeat('N', cast(event_id % 17 as integer)) as r from events)
),
wl as (select distinct substr({_dna('i')}, 1, 16) as w from range(40) t(i)),
near as (select * from (select s, w, {_hamming('s', 'w', '16')} as mm from reads, wl where s not in (select w from wl)) where mm <= 2)"""


SQL = {
    "whitelist_ambiguous": f"""with {_AMBIGUOUS}
select r.s as barcode, coalesce(wl.w, f.w) as corrected from reads r left join wl on wl.w = r.s left join (
  select s, case when count(case when mm = 0 then 1 end) = 1 then min(case when mm = 0 then w end)
    when count(case when mm = 0 then 1 end) = 0 and count(*) = 1 then min(w) end as w from near group by s) f on f.s = r.s""",
    "seq_dna": f"select event_id, {_dna('event_id')} as dna, {_codes('event_id')} as codes from events",
    "seq_complement": f"""select event_id, {_complement('s')} as complement, reverse({_complement('s')}) as reverse_complement
from (select event_id, replace({_codes('event_id')}, '-', 'N') as s from events)""",
    "fasta_complement": f"select entry_no, md5(reverse({_complement('s')})) as md5 from (select entry_no, regexp_replace(upper(sequence), '[^ACGTNRYSWKMBDHV]', 'N', 'g') as s from fasta_entries)",
    "seq_hamming": f"select event_id, {_hamming('a', 'b', '32')} as distance from (select event_id, {_dna('event_id')} as a, {_dna('user_id')} as b from events)",
    "seq_hamming_iupac": f"select event_id, {_hamming('a', 'b', '32')} as distance from (select event_id, {_codes('event_id')} as a, {_codes('user_id')} as b from events)",
    "seq_hamming_matrix": f"""select p_partkey, cast(barcode_no as integer) as barcode_no, {_hamming('s', 'barcode', '12')} as distance
from (select p_partkey, substr({_codes('p_partkey')}, 1, 12) as s from part), ({_BARCODES})""",
    "seq_pairwise_hamming": f"""with n as (select n_nationkey, substr({_codes('n_nationkey')}, 1, 16) as s from nation)
select x.n_nationkey as i, y.n_nationkey as j, {_hamming('x.s', 'y.s', '16')} as distance from n x, n y""",
    "seq_levenshtein": f"select event_id, cast(levenshtein({_dna('event_id')}, {_dna('user_id')}) as integer) as distance from events",
    "seq_cigar": f"select event_id, {_cigar('a', 'b', True)} as cigar from (select event_id, {_dna('event_id')} as a, {_dna('user_id')} as b from events)",
    "seq_cigar_gapped": f"""select event_id, {_cigar('r', 'q', False)} as cigar
from (select event_id, r, array_to_string([case when substr(r, i, 1) = '-' and substr(q, i, 1) = '-' then 'N' else substr(q, i, 1) end for i in range(1, 33)], '') as q
  from (select event_id, translate({_md5('event_id')}, '{_HEX}', 'ACGTACGTACG-----') as r, translate({_md5('user_id')}, '{_HEX}', 'ACGTACGTACG-----') as q from events))""",
    "seq_disambiguate": f"""with recursive sets(code, bases) as (values {', '.join(f"('{c}', '{b}')" for c, b in (('A', 'A'), ('C', 'C'), ('G', 'G'), ('T', 'T'), ('R', 'AG'), ('Y', 'CT'), ('S', 'CG'), ('W', 'AT'), ('K', 'GT'), ('M', 'AC'), ('B', 'CGT'), ('D', 'AGT'), ('H', 'ACT'), ('V', 'ACG'), ('N', 'ACGT')))}),
p as (select p_partkey, replace(substr({_codes('p_partkey')}, 1, 5), '-', 'A') as s from part),
grown as (
  select p_partkey, s, 0 as n, '' as form, 0 as form_no, 1 as size from p
  union all
  select p_partkey, s, n + 1, form || substr(bases, cast(k as integer), 1), cast(form_no + (k - 1) * size as integer), cast(size * length(bases) as integer)
  from grown join sets on code = substr(s, n + 1, 1), range(1, 5) r(k) where n < 5 and k <= length(bases)
)
select p_partkey, form_no, form from grown where n = 5""",
    "qual_values": f"""select event_id, array_to_string([ascii(substr(q, i, 1)) - 33 for i in range(1, 33)], ',') as quality_values,
  round(list_sum([pow(10.0::double, -(ascii(substr(q, i, 1)) - 33) / 10.0::double) for i in range(1, 33)]), 6) as expected_errors from (select event_id, {_qual('event_id')} as q from events)""",
    "qual_median": f"select user_id, median(ascii(substr({_qual('event_id')}, i, 1)) - 33) as median_quality from events, range(1, 33) t(i) group by user_id",
    "positional_weights": f"with {_WEIGHTS} select * from weights",
    "consensus_first": f"""with {_WEIGHTS},
best as (select *, greatest(a, c, g, t) as m from weights)
select group_no, string_agg(case when a = m then 'A' when c = m then 'C' when g = m then 'G' else 'T' end, '' order by position) as consensus,
  string_agg(substr('-ACMGRSVTWYHKDBN', cast(1 + (a = m)::int + 2 * (c = m)::int + 4 * (g = m)::int + 8 * (t = m)::int as integer), 1), '' order by position) as ambiguous
from best group by group_no""",
    "whitelist_simple": f"with {_SIMPLE} select barcode, corrected from simple",
    "whitelist_posterior": f"""with {_BARCODED},
per as (select barcode as s, count(*) as reads from barcoded group by 1),
zero as (select s, w, count(*) over (partition by s) as shared from near where mm = 0),
settled as (select s, s as w from per where s in (select w from wl) union all select s, w from zero where shared = 1),
counted as (select w, sum(n) as n from (
  select s as w, cast(reads as double) as n from per where s in (select w from wl)
  union all select w, reads / cast(shared as double) from zero join per on per.s = zero.s
  union all select w, 0.0::double from wl) group by w),
prior as (select w, log10((n + 1) / (select sum(n) + count(*) from counted)) as prior from counted),
scored as (
  select b.event_id, near.w, prior - list_sum([case when ({_bit('substr(b.barcode, i, 1)')} & {_bit('substr(near.w, i, 1)')}) = 0 then ascii(substr(quality, i, 1)) - 33 else 0 end for i in range(1, 13)]) / 10.0::double as ll
  from barcoded b join near on near.s = b.barcode join prior on prior.w = near.w where b.barcode not in (select s from settled)
),
ranked as (select event_id, w, ll - log10(sum(pow(10.0::double, ll)) over (partition by event_id)) as sure, row_number() over (partition by event_id order by ll desc, w) as rn from scored)
select b.event_id, b.barcode, coalesce(s.w, r.w) as corrected from barcoded b left join settled s on s.s = b.barcode
left join ranked r on r.event_id = b.event_id and rn = 1 and sure >= log10(0.95::double)""",
    "barcode_counts": f"""with {_SIMPLE}
select s.corrected, count(*) as n_reads, count(distinct substr({_dna('b.event_id // 5')}, 1, 8)) as n_umis
from barcoded b join simple s on s.barcode = b.barcode where s.corrected is not null group by s.corrected""",
    "seg_predicates": """select l_orderkey, l_linenumber, e1 - s1 as width, s1 <= s2 and s2 < e1 as holds, s1 < e2 and s2 < e1 as overlapping, not (s1 < e2 and s2 < e1) as "exclusive",
  s2 >= s1 and e2 <= e1 as subset, s1 >= s2 and e1 <= e2 as superset
from (select *, s2 + cast(floor(l_discount * 100) as bigint) as e2 from (select *, l_partkey as s1, cast(l_partkey + floor(l_quantity) as bigint) as e1, cast(l_partkey + floor(l_tax * 100) * 5 as bigint) as s2 from lineitem))""",
    "seg_flank": f'with {_SEGMENTS} select k, s as "start", e as "end", greatest(min(s) over (partition by k), s - 7) as flank_start, least(e + 7, max(e) over (partition by k)) as flank_end from seg',
    "seg_collapse": f'with {_SEGMENTS}, {_collapsed("c", "from seg")} select k, s as "start", e as "end" from c',
    "seg_invert": f"""with {_SEGMENTS}, {_collapsed("c", "from seg")}, bounds as (select k, min(s) - 2 as s, max(e) + 3 as e from seg group by k)
{_gaps("c", "bounds", "k")}""",
    "seg_span": f"""with {_SEGMENTS}, {_collapsed("c", "from seg")}
select x.k, coalesce(min(c.s), 0) as span_start, coalesce(max(c.e), 0) as span_end, count(c.s) as n_segments from (select distinct k from seg) x left join c on c.k = x.k group by x.k""",
    "seg_collection_flank": f"""with {_SEGMENTS}, {_collapsed("c", "select k, greatest(0, s - 2) as s, e + 2 as e from seg where e > s")} select k, s as "start", e as "end" from c""",
    "seg_from_positions": """select k, min(p) as "start", max(p) + 1 as "end" from (select k, p, p - row_number() over (partition by k order by p) as run
  from (select distinct l_suppkey as k, l_partkey as p from lineitem)) group by k, run""",
    "seg_union_collapse": f'with {_SEGMENTS}, {_collapsed("c", "from seg")} select k, s as "start", e as "end" from c',
    "seg_overlapping": f"""with {_SEGMENTS}, {_collapsed("c", "select k, s, e from seg where half = 0")}
select k, s as "start", e as "end" from c where exists (select 1 from seg b where b.half = 1 and b.k = c.k and b.e > b.s and c.s < b.e and b.s < c.e)""",
    "seg_overlapping_collections": f"""with {_SEGMENTS}
select distinct a.k from seg a join seg b on a.k = b.k and a.half = 0 and b.half = 1 and a.e > a.s and b.e > b.s and a.s < b.e and b.s < a.e""",
    "seg_subset_collections": f"""with {_SEGMENTS}, {_collapsed("a", "select k, s, e from seg where half = 0")}, {_collapsed("b", "select k, greatest(0, s - 25) as s, e + 25 as e from seg where half = 1 and e > s")}
select k from (select a.k, exists (select 1 from b where b.k = a.k and b.s <= a.s and a.e <= b.e) as inside from a) group by k having bool_and(inside)""",
    "seg_span_exclusive": f"""with {_SEGMENTS},
span as (select k, half, coalesce(min(case when e > s then s end), 0) as s, coalesce(max(case when e > s then e end), 0) as e from seg group by k, half)
select a.k, a.e <= b.s or a.s >= b.e as "exclusive" from span a join span b on a.k = b.k and a.half = 0 and b.half = 1""",
    "gtf_parse": f'with {_PARSED} select line_no, chromosome, feature, "start", "end", strand from numbered',
    "gtf_attributes": f"with {_PARSED} select line_no, {', '.join(map(_attribute, ('gene_id', 'transcript_id', 'gene_biotype', 'note')))} from numbered",
    "gtf_filter": f"""with {_PARSED} select chromosome, count(*) as n_exons, cast(sum("end" - "start" + 1) as bigint) as bases from numbered where feature = 'exon' and strand = '+' group by chromosome""",
    "gene_info": f'with {_OWN} select gene_id, chromosome, strand, gene_name, s as "start", e as "end", first_seen from genes_',
    "transcript_info": f'with {_OWN} select transcript_id, gene_id, transcript_name, s as "start", e as "end", pseudo from transcripts_',
    "transcript_exons": f'with {_OWN} select transcript_id, s as "start", e as "end" from exons_',
    "transcript_introns": f'with {_OWN} select * from introns_',
    "fasta_cdna": f"""with {_FOLDED}, {_GENOME},
spliced as (select x.transcript_id, string_agg(substr(sequence, cast(x.s + 1 as integer), cast(x.e - x.s as integer)), '' order by x.s) as sq
  from exons_ x join transcripts_ o on o.transcript_id = x.transcript_id join genes_ g on g.gene_id = o.gene_id join genome n on n.chromosome = g.chromosome group by 1)
select o.transcript_id, '>' || o.transcript_id || {_ABOUT} || ' transcript_name:' || transcript_name || {_PLACE}, {_STRANDED}
from spliced x join transcripts_ o on o.transcript_id = x.transcript_id join genes_ g on g.gene_id = o.gene_id where sq <> ''""",
    "fasta_introns": f"""with {_FOLDED}, {_GENOME},
{_collapsed('wide', 'select i.transcript_id, greatest(o.s, i."start" - 5) as s, least(i."end" + 5, o.e) as e from introns_ i join transcripts_ o on o.transcript_id = i.transcript_id', 'transcript_id')},
numbered_ as (select *, cast(row_number() over (partition by transcript_id order by s) as integer) as intron_no from wide)
select x.transcript_id, intron_no, '>' || x.transcript_id || '-I.' || intron_no || {_ABOUT} || ' transcript_name:' || transcript_name || {_PLACE}, {_STRANDED}
from (select numbered_.*, substr(n.sequence, cast(numbered_.s + 1 as integer), cast(numbered_.e - numbered_.s as integer)) as sq from numbered_ join transcripts_ o on o.transcript_id = numbered_.transcript_id
  join genes_ g on g.gene_id = o.gene_id join genome n on n.chromosome = g.chromosome) x
join transcripts_ o on o.transcript_id = x.transcript_id join genes_ g on g.gene_id = o.gene_id""",
    "fasta_nascent": f"""with {_FOLDED}, {_GENOME}
select g.gene_id, '>' || g.gene_id || {_ABOUT} || {_PLACE.replace('o.', 'g.')}, {_STRANDED}
from (select genes_.*, substr(n.sequence, cast(genes_.s + 1 as integer), cast(genes_.e - genes_.s as integer)) as sq from genes_ join genome n on n.chromosome = genes_.chromosome) g
where sq <> ''""",
    "fasta_headers": r"""select entry_no, split_part(substr(h, 2), ' ', 1) as parsed_name,
  cast(len(list_distinct(regexp_extract_all(case when strpos(h, ' ') > 0 then substr(h, strpos(h, ' ') + 1) else '' end, '(\S+?):(\S*)', 1))) as integer) as n_attributes,
  '>' || split_part(substr(h, 2), ' ', 1) || ' n:' || coalesce(length(sequence), 0) as made_header
from (select *, trim(header, ' ') as h from fasta_entries where starts_with(header, '>'))""",
    "fastq_zip": f"select a.read_index, a.name, a.sequence as s0, b.sequence as s1 from ({_fastq('0')}) a join ({_fastq('1')}) b on a.read_index = b.read_index",
    "fastq_zip_multi": f"""select cast(a.read_index % 3 as integer) as file_no, a.read_index // 3 as read_index, a.name, a.sequence as s0, b.sequence as s1 from ({_fastq('0')}) a join ({_fastq('1')}) b on a.read_index = b.read_index""",
    "rec_split_multi": f"""with rec as (select 'side0_lane' || (read_index % 3) as file, read_index // 3 as record_index from ({_fastq('0')}))
select file, record_index, cast((row_number() over (order by file, record_index) - 1) // ((select count(*) from rec) // 7 + 1) as varchar) as split_id from rec""",
    "rec_split_n_pairs": f"""with recursive {_RECORDS},
mates as (select *, case when flag = 5 then max(record_index) over (partition by qname) else record_index end as last, case when flag = 5 then 2 else 1 end as weight from rec),
sums as (select record_index, sum(weight) over (order by record_index) as so_far from mates where record_index = last),
size as (select count(*) // 7 + 1 as n from rec),
closings(c) as (
  select case when n in (select so_far from sums) then n else n + 1 end from size
  union all
  select case when c + n in (select so_far from sums) then c + n else c + n + 1 end from closings, size where c < (select max(so_far) from sums)
)
select m.record_index, cast((select count(*) from closings where c < s.so_far) as varchar) as split_id from mates m join sums s on s.record_index = m.last""",
    "chem_registry": _REGISTRY,
    "chem_lengths": f"""select name, read_index, case when count(*) = count(slice_end) then max(slice_end) end as read_length from ({_REGISTRY}) group by name, read_index""",
    "rec_from_layout": f"""select a.read_index as record_index, a.name as qname, 4 as flag, b.sequence as seq, b.quality as qual, 'rg1' as rg, substr(a.sequence, 1, 16) as cr, substr(a.quality, 1, 16) as cy,
  substr(a.sequence, 17, 12) as ur, substr(a.quality, 17, 12) as uy from ({_fastq('0')}) a join ({_fastq('1')}) b on a.read_index = b.read_index""",
    "rec_map": f"""with {_RECORDS} select record_index, cast(length(seq) as integer) as n_bases, round(list_sum([ascii(substr(qual, i, 1)) - 33 for i in range(1, 65)]) / 64.0::double, 4) as mean_quality from rec""",
    "rec_apply": f"with {_RECORDS} select record_index, reverse(seq) as seq from rec where starts_with(seq, 'A')",
    "rec_filter": f"with {_RECORDS} select record_index, qname, flag from rec where record_index % 7 = 0 or starts_with(seq, 'C')",
    "rec_count": f"with {_RECORDS} select count(*) as n from rec where starts_with(seq, 'G')",
    "rec_split_key": f"with {_RECORDS} select rg as split_id, count(*) as n_records from rec group by rg",
    "rec_split_n": f"with {_RECORDS} select record_index, cast((row_number() over (order by record_index) - 1) // ((select count(*) from rec) // 7 + 1) as varchar) as split_id from rec",
    "rec_tag_join": f"""select a.read_index as record_index, cast(null as varchar) as rg, substr(b.sequence, 3, 16) as cr, substr(b.sequence, 1, 10) as ur from ({_fastq('0')}) a join ({_fastq('1')}) b on a.name = b.name""",
    "dict_merge": """select k, coalesce(a, 0) + coalesce(b, 0) as n from (select c_nationkey as k, count(*) as a from customer group by 1) full join (select s_nationkey as k, count(*) as b from supplier group by 1) using (k)""",
    "dict_flatten": "select n_regionkey || '/' || n_name as path, n_nationkey as value from nation",
    "validators": """select attr_no, count(case when ok then 1 end) as n_integer, count(case when ok and try_cast(v as bigint) > 0 then 1 end) as n_positive, count(*) as n
from (select *, regexp_full_match(v, '[+-]?[0-9]+') and try_cast(v as bigint) between -2147483648 and 2147483647 as ok from (select *, trim(attr_value, ' ') as v from gtf_attributes)) group by attr_no""",
    **{f"chem_parse_{''.join(x if x.isalnum() else '_' for x in c.name.lower())}": _layout_sql(c) for c in layouts.registry() if isinstance(c, layouts.Chemistry) and c.n},
}
