"""What the queries of ``problems`` give, as SQL over the same tables."""

_INT = r"[+-]?[0-9]+"
_DOUBLE = r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"

_SAID = rf"""
said as (
  select a.line_no, d.attr_key, d.value_type, d.is_multi, trim(a.attr_value, ' ') as v
  from gtf_attributes a
  join gtf_attribute_defs d
    on regexp_replace(lower(a.attr_key), '[^a-z0-9]', '', 'g') = regexp_replace(lower(d.attr_key), '[^a-z0-9]', '', 'g')
  where a.line_no is not null and trim(a.attr_value, ' ') <> '' and lower(trim(a.attr_value, ' ')) <> lower(d.missing_marker)
),
typed as (
  select line_no, attr_key, value_type, is_multi, v,
    case when value_type = 'integer' then
        case when regexp_full_match(v, '{_INT}') and try_cast(v as bigint) between -2147483648 and 2147483647 then cast(try_cast(v as bigint) as varchar) end
      when value_type = 'double' then case when regexp_full_match(v, '{_DOUBLE}') then cast(try_cast(v as double) as varchar) end
      when value_type = 'boolean' then case when lower(v) in ('true', 'yes', '1') then 'true' when lower(v) in ('false', 'no', '0') then 'false' end
      when value_type = 'date' then case when regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(v as date) is not null then v end
      else v end as r
  from said
),
cells as (
  select line_no, attr_key, value_type, is_multi, count(r) as n_readable, count(distinct r) as n_different, min(r) as r,
    string_agg(distinct r, '|' order by r) as items
  from typed group by all
)"""

_COLUMNS = {
    "gene_version": "integer", "gene_name": "varchar", "gene_source": "varchar", "gene_biotype": "varchar",
    "transcript_version": "integer", "transcript_support_level": "integer", "level": "integer", "exon_count": "integer",
    "gc_content": "double", "mean_depth": "double", "canonical": "boolean", "readthrough": "boolean", "curated_on": "varchar",
    "protein_id": "varchar",
}
_WIDE = ", ".join(
    f"cast(max(case when attr_key = '{k}' and n_different = 1 then r end) as {t}) as {k}" for k, t in _COLUMNS.items()
) + ", " + ", ".join(f"max(case when attr_key = '{k}' then items end) as {k}" for k in ("tag", "db_xref"))

_KEYED = """
keyed as (
  select 'gtf_entries' as table_name, nullif(upper(trim(chromosome, ' ')), '') as key_value,
    case when end_pos >= start_pos then end_pos - start_pos + 1 end as len, loaded_at from gtf_entries
  union all
  select 'fasta_entries', nullif(upper(trim(name, ' ')), ''), length(sequence), loaded_at from fasta_entries
)"""

_ITEM = r' *([^ ;"]+ +([^ ;"][^;"]*|"[^"]*" *))?'
LINES = rf"""
lines as (
  select raw_no, case when right(line, 1) = chr(13) then left(line, length(line) - 1) else line end as line
  from gtf_lines where line is null or not starts_with(line, '#')
),
parts as (select raw_no, line, string_split(line, chr(9)) as c from lines),
judged as (
  select raw_no, c,
    case when line is null or len(c) <> 9 then 'columns'
      when not regexp_full_match(c[9], '{_ITEM}(;{_ITEM})*') then 'quoting'
      when trim(c[1], ' ') = '' or trim(c[3], ' ') = ''
        or not regexp_full_match(trim(c[4], ' '), '[0-9]+') or not regexp_full_match(trim(c[5], ' '), '[0-9]+')
        or coalesce(try_cast(trim(c[4], ' ') as bigint), 0) < 1 or coalesce(try_cast(trim(c[5], ' ') as bigint), 0) < 1
        or try_cast(trim(c[4], ' ') as bigint) > try_cast(trim(c[5], ' ') as bigint)
        or not regexp_full_match(trim(c[6], ' '), '\.|{_DOUBLE}')
        or trim(c[7], ' ') not in ('+', '-', '.') or trim(c[8], ' ') not in ('.', '0', '1', '2') then 'value' end as reason
  from parts
)"""

_ORPHANS = """
refs as (
  select line_no, loaded_at, 'genes' as ref_table, upper(trim(gene_id, ' ')) as k from gtf_entries
  union all select line_no, loaded_at, 'transcripts', upper(trim(transcript_id, ' ')) from gtf_entries
  union all select line_no, loaded_at, 'chromosomes', upper(trim(chromosome, ' ')) from gtf_entries
),
parents as (
  select 'genes' as ref_table, upper(trim(gene_id, ' ')) as k, added_at, removed_at from genes
  union all select 'transcripts', upper(trim(transcript_id, ' ')), added_at, removed_at from transcripts
  union all select 'chromosomes', upper(trim(chromosome, ' ')), added_at, removed_at from chromosomes
),
matched as (
  select r.line_no, r.ref_table, r.loaded_at, count(p.k) as n,
    count(case when p.added_at <= r.loaded_at and (p.removed_at is null or p.removed_at > r.loaded_at) then 1 end) as n_there,
    count(case when p.added_at > r.loaded_at then 1 end) as n_later
  from refs r left join parents p on p.ref_table = r.ref_table and p.k = r.k
  where r.k <> '' group by all
),
orphans as (
  select line_no, ref_table, strftime(loaded_at, '%Y-%m') as loaded_month,
    case when n = 0 then 'missing' when n = n_later then 'late' else 'deleted' end as fault
  from matched where n_there = 0
)"""

SQL = {
    "p1_found": f"""with {_SAID}
select line_no, attr_key, case when n_readable = 0 then 'unreadable' else 'conflict' end as fault
from cells where not is_multi and (n_readable = 0 or n_different > 1)""",
    "p1_wide": f"""with {_SAID}
select e.line_no, {_WIDE}
from (select distinct line_no from gtf_attributes where line_no is not null) e left join cells c on c.line_no = e.line_no
group by e.line_no""",
    "p3_found": f"""with {_KEYED}
select table_name, key_value from keyed k where key_value is not null
group by table_name, key_value
having count(*) * 20 > (select count(*) from keyed x where x.table_name = k.table_name and x.key_value is not null)""",
    "p3_totals": f"""with {_KEYED}
select table_name, key_value, count(*) as n_rows, cast(coalesce(sum(len), 0) as bigint) as total_length,
  min(loaded_at) as first_at, max(loaded_at) as last_at
from keyed group by table_name, key_value""",
    "p4_found": f"with {LINES} select raw_no, reason from judged where reason is not null",
    "p4_entries": rf"""with {LINES}
select raw_no, trim(c[1], ' ') as chromosome, trim(c[2], ' ') as source, trim(c[3], ' ') as feature,
  cast(trim(c[4], ' ') as bigint) as start_pos, cast(trim(c[5], ' ') as bigint) as end_pos, trim(c[6], ' ') as score,
  trim(c[7], ' ') as strand, trim(c[8], ' ') as frame,
  nullif(regexp_extract(c[9], '(^|;) *gene_id +"([^"]*)"', 2), '') as gene_id
from judged where reason is null""",
    "p5_found": f"with {_ORPHANS} select * from orphans",
    "p5_by_month": f"""with {_ORPHANS}
select ref_table, loaded_month as period, fault, count(*) as n_references from orphans group by all""",
    "p6_found": """with exons as (
  select distinct upper(trim(transcript_id, ' ')) as transcript_id, start_pos, end_pos from gtf_entries
  where lower(trim(feature, ' ')) = 'exon' and trim(transcript_id, ' ') <> '' and start_pos <= end_pos
),
reached as (
  select *, max(end_pos) over (partition by transcript_id order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach
  from exons
),
islands as (
  select *, sum(case when reach is null or start_pos > reach then 1 else 0 end) over (partition by transcript_id order by start_pos, end_pos rows unbounded preceding) as island
  from reached
),
blocks as (select transcript_id, island, min(start_pos) as s, max(end_pos) as e from islands group by transcript_id, island),
following as (select transcript_id, e + 1 as s, lead(s) over (partition by transcript_id order by s) - 1 as e from blocks)
select transcript_id, 'block' as kind, s as start_pos, e as end_pos from blocks
union all select transcript_id, 'gap', s, e from following where s <= e""",
}
