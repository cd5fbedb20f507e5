"""SQL for DuckDB that states the results of those queries that SQL can express, over whole tables."""

_GROUPS = r"""
with recursive t as (
  select row_id, regexp_extract_all(lower(coalesce(question, '') || ' ' || context), '[\p{L}\p{N}]+') as w
  from example_asqa where context is not null and context <> ''
), g as (
  select distinct row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as run
  from (select row_id, w, unnest(range(1, len(w) - 1)) as i from t)
), n as (select row_id, count(*) as n from g group by row_id
), e as (
  select a.row_id as a, b.row_id as b, count(*) as c from g a join g b on a.run = b.run and a.row_id < b.row_id group by 1, 2
), l as (
  select a, b from e join n x on x.row_id = a join n y on y.row_id = b where c >= 0.6 * (x.n + y.n - c) - 1e-9
), s as (select a, b from l union select b, a from l
), r as (
  select row_id, row_id as g from t
  union
  select s.b, r.g from r join s on s.a = r.row_id
), c as (select row_id, min(g) as group_id from r group by row_id)
"""

_COPIES = r"""
with recursive t as (
  select id, question as q, factoid as f, regexp_replace(lower(upper(question)), '[^\p{L}\p{N}]', '', 'g') as q1, regexp_replace(lower(upper(factoid)), '[^\p{L}\p{N}]', '', 'g') as f1
  from example_dataset where question is not null and factoid is not null
), u as (
  select id, q1, f1,
    array_to_string(list_sort(list_filter(list_transform(string_split(q, ';'), lambda x: regexp_replace(lower(upper(x)), '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '')), '') as q2,
    array_to_string(list_sort(list_filter(list_transform(string_split(f, ';'), lambda x: regexp_replace(lower(upper(x)), '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '')), '') as f2
  from t where q1 <> '' and f1 <> ''
), v as (
  select id, unnest([[q1, f1], [q1, f2], [q2, f1], [q2, f2]]) as p from u
), k as (select distinct id, least(p[1], p[2]) || '|' || greatest(p[1], p[2]) as key from v
), m as (select key, min(id) as m from k group by key
), e as (select distinct k.id as a, m.m as b from k join m on k.key = m.key
), s as (select a, b from e union select b, a from e
), r as (
  select id, id as g from u
  union
  select s.b, r.g from r join s on s.a = r.id
), c as (select id, min(g) as g from r group by id)
"""

_CELLS = r"""
with d as (
  select regexp_replace(lower(factoid_type), '\s', '', 'g') as a, regexp_replace(lower(answer_type), '\s', '', 'g') as b, context_support as c from example_dataset
), s as (
  select *, regexp_replace(lower(factoid_type), '\s', '', 'g') as a, regexp_replace(lower(answer_type), '\s', '', 'g') as b, context_support as c from sampling_target
), n as (
  select s.plan_id, s.cell_id, count(d.key) as available, cast(round(any_value(s.target_share) * any_value(s.sample_rows)) as bigint) as wanted, any_value(s.min_rows) as min_rows
  from s left join (select *, 1 as key from d) d on (s.a is null or s.a = d.a) and (s.b is null or s.b = d.b) and (s.c is null or s.c = d.c)
  group by 1, 2
)
"""

# The sample by sorting every record: random ranks, floors first, then the smallest divisor priorities.
_MIXED = "xor({x}, {x} >> 16)"
_DRAW = "xor(xor(id % 4294967296, (id >> 32) % 4294967296), 42)"
for _ in range(2):
    _DRAW = f"({_MIXED.format(x=_DRAW)} * 73244475 % 4294967296)"
_SAMPLE = r"""
with d as (
  select id, regexp_replace(lower(factoid_type), '\s', '', 'g') as a, regexp_replace(lower(answer_type), '\s', '', 'g') as b, context_support as c, {draw} as o from example_dataset
), s as (
  select *, regexp_replace(lower(factoid_type), '\s', '', 'g') as a, regexp_replace(lower(answer_type), '\s', '', 'g') as b, context_support as c from sampling_target
), m as (
  select s.plan_id, s.cell_id, d.id, row_number() over (partition by s.cell_id order by o, d.id) as rank, s.target_share, s.sample_rows, coalesce(s.min_rows, 0) as floor
  from s join d on (s.a is null or s.a = d.a) and (s.b is null or s.b = d.b) and (s.c is null or s.c = d.c)
), p as (
  select *, rank <= floor as is_floor, case when target_share > 0 then (rank - 0.5) / target_share end as priority from m
), g as (
  select *, row_number() over (partition by plan_id order by is_floor desc, priority nulls last, cell_id) as place from p where is_floor or priority is not null
), k as (select * from g where place <= sample_rows)
""".format(draw=_MIXED.format(x=_DRAW))

_LEAKS = r"""
with d as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null
), i as (
  select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as w from eval_item where passage is not null
), x as (select doc_id, array_to_string(w[i:i + 11], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)
), y as (select item_id, array_to_string(w[i:i + 11], ' ') as run from (select item_id, w, unnest(range(1, len(w) - 10)) as i from i)
)
"""


# Length hazards by window functions, Chernoff bounds, and the false discovery rate over all tests sorted at once.
_LIMITS = """
with l as (
  select source, length(text) as chars, strlen(text) as bytes from documents where text is not null and text <> ''
), u as (select source, 'chars' as unit, chars as length from l union all select source, 'bytes', bytes from l
), c as (select source, unit, length, count(*) as n from u group by all
), r as (
  select *, cast(sum(n) over (w rows between current row and unbounded following) as bigint) as at_risk from c window w as (partition by source, unit order by length)
), t as (
  select *, sum(n) over v - n as ends, sum(at_risk) over v - at_risk as risks, count(*) over v - 1 as others
  from r window v as (partition by source, unit order by length range between 25 preceding and 25 following)
), h as (
  select *, (ends + 0.5::double) / (coalesce(risks::double / nullif(others, 0), at_risk) * 50 + at_risk) as near from t
), p as (
  select *, case when n > at_risk * near then n - at_risk * near - n * ln(n / (at_risk * near)) else 0.0 end as log_p from h
), m as (
  select *, exp(log_p) * (select count(*) from p) / row_number() over (order by log_p, source nulls first, unit, length) as p_m from p
), q as (select *, min(p_m) over (order by log_p, source nulls first, unit, length rows between current row and unbounded following) as q from m
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _GROUPS + "select group_id as row_id_a, row_id as row_id_b from c where group_id <> row_id",
        "p1_groups": _GROUPS + "select row_id, group_id from c",
        "p3_found": _COPIES + "select g as id_a, id as id_b from c where g <> id",
        "p3_records": _COPIES + "select g as id, count(*) as copies from c group by g",
        "p3_hashes": _COPIES + "select count(*) as rows, count(distinct least(q1, f1) || '|' || greatest(q1, f1)) as keys, cast(0 as bigint) as collisions from u",
        "p4_found": _CELLS + "select plan_id, cell_id from n where available < wanted or available < min_rows",
        "p4_report": _CELLS + "select plan_id, cell_id, available, wanted, available < wanted or available < min_rows as unmet from n",
        "p4_sample": _SAMPLE + "select plan_id, cell_id, id, rank, is_floor, round(priority, 6) as priority from k",
        "p4_shortfall": _SAMPLE
        + """, n as (
  select s.plan_id, s.cell_id, coalesce(cast(round(s.target_share * s.sample_rows) as bigint), 0) as wanted, coalesce(s.min_rows, 0) as floor,
    (select count(*) from m where m.cell_id = s.cell_id) as available, (select count(*) from k where k.cell_id = s.cell_id) as seats
  from s
) select plan_id, cell_id, seats, greatest(wanted - seats, 0) as short, case when available < wanted then 'rows' when available < floor then 'floor' when seats < wanted then 'other cells' end as reason from n""",
        "p8_limits": _LIMITS + "select source, unit, length, n, at_risk, round(n / at_risk, 6) as hazard, round(near, 6) as near, round(q, 6) as q from q where q <= 0.01",
        "p7_found": _LEAKS + "select distinct doc_id, item_id from x join y on x.run = y.run",
    }
