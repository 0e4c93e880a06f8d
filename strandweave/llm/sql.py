"""What some of the text queries give, as SQL; the others are tested against brute force and round trips."""

_RUNS = r"""
select distinct {id}, array_to_string(list_slice(w, i, i + 12), ' ') as run
from (select {id}, w, unnest(range(1, len(w) - 11)) as i
      from (select {id}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from {table} where text is not null))
"""

_ENDS = "[i for i in range({n}, length(sequence) + 1) if regexp_full_match(substr(sequence, i - {n} + 1, {n}), '[{c}]+') and not regexp_full_match(substr(sequence, i + 1, 1), '[{c}]')]"
_END = """case when n - {s} <= 2000 then n else coalesce(list_max(list_filter(gaps, lambda x: x > {s} + 100 and x <= {s} + 2000)),
  list_max(list_filter(lows, lambda x: x > {s} + 100 and x <= {s} + 2000)), {s} + 2000) end"""

SQL: dict[str, str] = {
    "p2_found": f"""with recursive long as (
  select entry_no, length(sequence) as n, {_ENDS.format(n=10, c="Nn")} as gaps, {_ENDS.format(n=20, c="a-z")} as lows from fasta_entries where length(sequence) > 2000
),
pieces as (
  select entry_no, n, gaps, lows, cast(1 as bigint) as piece_no, cast(0 as bigint) as s, cast({_END.format(s="0")} as bigint) as e from long
  union all
  select entry_no, n, gaps, lows, piece_no + 1, e - 100, cast({_END.format(s="(e - 100)")} as bigint) from pieces where e < n
)
select entry_no, piece_no, s as piece_start, e as piece_end from pieces""",
    "p8_found": f"""select distinct d.doc_id, e.eval_id
from ({_RUNS.format(id="doc_id", table="documents")}) d join ({_RUNS.format(id="eval_id", table="eval_items")}) e on d.run = e.run""",
}
