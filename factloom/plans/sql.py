"""SQL for DuckDB that states the results of the core queries."""

from __future__ import annotations

from factloom.functions.text import STOP_WORDS
from factloom.operators.dataset import FALLBACK, TAXONOMY

_RAW = "case row_id % 6 when 0 then 'Yes, ' || coalesce(right_answer, '') when 1 then 'no. ' || coalesce(right_answer, '') when 2 then 'NO. I am not sure: ' || coalesce(right_answer, '') when 3 then 'NOTSURE' when 4 then 'YESNO' else right_answer end"
_VERDICT = r"""
with r as (select row_id, upper(coalesce({raw}, '')) as u from example_asqa), v as (
  select row_id, u, case when contains(u, 'NOT SURE') then 'NOT SURE'
    else coalesce(nullif(regexp_extract(u, '(?:^|[^\p{{L}}\p{{N}}_])(YES|NO)(?:[^\p{{L}}\p{{N}}_]|$)', 1), ''), 'NOT SURE') end as v from r
)
""".format(raw=_RAW)

_LISTS = """
with l as (
  select *, coalesce(from_json(stage1_syn_decisions, '["VARCHAR"]'), []) as syn1, coalesce(from_json(stage1_ant_decisions, '["VARCHAR"]'), []) as ant1,
    coalesce(from_json(final_syn_decisions, '["VARCHAR"]'), []) as syn2, coalesce(from_json(final_ant_decisions, '["VARCHAR"]'), []) as ant2
  from factoid_log
), s as (
  select *,
    coalesce(list_sum(list_transform(syn1, lambda x: case x when 'NO' then 1.0 when 'YES' then 0.0 else 0.5 end) || list_transform(ant1, lambda x: case x when 'YES' then 1.0 when 'NO' then 0.0 else 0.5 end))::double / nullif(len(syn1) + len(ant1), 0), 0.0) as score1,
    coalesce(list_sum(list_transform(syn2, lambda x: case x when 'NO' then 1.0 when 'YES' then 0.0 else 0.5 end) || list_transform(ant2, lambda x: case x when 'YES' then 1.0 when 'NO' then 0.0 else 0.5 end))::double / nullif(len(syn2) + len(ant2), 0), 0.0) as score2
  from l
), a as (
  select fact_log_id, len(list_filter(syn1, lambda x: x in ('NO', 'NOT SURE'))) as sc, len(list_filter(ant1, lambda x: x in ('YES', 'NOT SURE'))) as ac,
    greatest(len(syn1), 1) as sn, greatest(len(ant1), 1) as an,
    list_contains(syn1, 'YES') and list_contains(ant1, 'YES') as ys, list_contains(syn1, 'NO') and list_contains(ant1, 'NO') as ns
  from l
)
"""


def _escalated(reasons: str) -> str:
    return _LISTS + f"""
, e as (select *, list_filter([{reasons}], lambda x: x is not null) as r from a)
select fact_log_id, len(r) > 0 as escalated, array_to_string(r, ' | ') as reasons, cast(sc as integer) as syn_anomaly_count, cast(ac as integer) as ant_anomaly_count,
  round(sc::double / sn, 4) as syn_anomaly_ratio, round(ac::double / an, 4) as ant_anomaly_ratio, ys or ns as logical_paradox, ys as both_yes, ns as both_no from e
"""


def _fixture(name: str, shift: int = 0) -> str:
    e = f"(event_id + {shift})"
    verdict = lambda k: f"(['YES', 'NO', 'NOT SURE'])[1 + ({e} // {3**k}) % 3]"
    return f"""
{name}_f as (
  select event_id, case when event_id % 13 <> 0 then event_type end as category, {verdict(0)} as orig,
    list_slice([{verdict(1)}, {verdict(2)}], 1, ({e} // 486) % 9 // 3) as syn, list_slice([{verdict(3)}, {verdict(4)}], 1, ({e} // 486) % 9 % 3) as ant,
    case when event_id % 11 <> 0 then (event_id // 243) % 2 = 1 end as t0
  from events
), {name}_g as (
  select *, coalesce(t0, false) as truth, coalesce(t0, false) = (orig = 'YES') and orig <> 'NOT SURE' as correct,
    coalesce(t0 = (orig = 'YES') and orig <> 'NOT SURE', false) as correct_null,
    (orig = 'YES' or list_contains(syn, 'YES')) and list_contains(ant, 'YES') as py, (orig = 'NO' or list_contains(syn, 'NO')) and list_contains(ant, 'NO') as pn,
    len(syn) > 0 and len(ant) > 0 and len(list_filter(syn || ant, lambda x: x <> 'NOT SURE')) = 0 as unsure,
    case when orig = 'YES' then 'NO' else 'YES' end as opp
  from {name}_f
)"""


_QUIET = "case when truth and orig <> 'YES' then 'Silent Failure' when not truth and orig = 'YES' then 'Silent Failure' else 'None' end", "case when truth and orig <> 'YES' then 'Missed True Fact' when not truth and orig = 'YES' then 'Missed Hallucination' else 'Success' end"


def _policy(name: str, policy: str) -> str:
    """name_p with escalated, trigger and failure."""
    keep = lambda *x: f"list_filter([{', '.join(x)}], lambda x: x is not null)"
    if policy == "paradox":
        t = f"case when unsure then ['confidence collapse'] else {keep("case when py or pn then 'logical paradox' end")} end"
        f = f"case when unsure then ['All NOT SURE'] else {keep("case when py then 'Contradictory Both YES' end", "case when pn then 'Contradictory Both NO' end")} end"
    elif policy == "strict":
        bad = lambda c, a, b: f"case when len(list_filter({c}, lambda x: case when truth then x in {a} else x in {b} end)) > 0 then"
        o, s, a = "case when (truth and orig <> 'YES') or (not truth and orig <> 'NO') then", bad("syn", "('NO', 'NOT SURE')", "('YES', 'NOT SURE')"), bad("ant", "('YES', 'NOT SURE')", "('NO', 'NOT SURE')")
        t = keep(f"{o} 'original' end", f"{s} 'synonym inconsistency' end", f"{a} 'antonym inconsistency' end")
        f = keep(f"{o} case when truth then 'False Negative / Not Sure' else 'False Positive / Not Sure' end end", f"{s} case when truth then 'Inconsistent on Synonym' else 'Inconsistent on Synonym (False Positive)' end end", f"{a} case when truth then 'Failed to reject Antonym' else 'Inconsistent on Antonym' end end")
    else:
        so, ao = "len(list_filter(syn, lambda x: x <> orig))", "len(list_filter(ant, lambda x: x <> opp))"
        br, du = f"orig <> 'NOT SURE' and {ao} >= 2", f"orig <> 'NOT SURE' and {ao} >= 1 and {so} >= 1"
        t = keep("case when orig = 'NOT SURE' then 'original uncertainty' end", "case when py or pn then 'logical paradox' end", f"case when ({br}) or ({du}) then 'threshold anomaly' end")
        f = keep("case when orig = 'NOT SURE' then 'Original Factoid NOT SURE' end", "case when py then 'Contradictory Both YES' end", "case when pn then 'Contradictory Both NO' end", f"case when {br} then 'Antonym Defense Breached (>=2 errors)' end", f"case when {du} then 'Dual-sided Defense Breached (Syn>=1 & Ant>=1)' end")
    quiet = ("'None'", "'None'") if policy == "strict" else _QUIET
    return f"""
{name}_t as (select *, {t} as ts, {f} as fs from {name}_g),
{name}_p as (select *, len(ts) > 0 as escalated, case when len(ts) > 0 then array_to_string(ts, ' + ') else {quiet[0]} end as "trigger", case when len(ts) > 0 then array_to_string(fs, ' + ') else {quiet[1]} end as failure from {name}_t)
"""


def _batch(policy: str, shift: int = 0, name: str = "b") -> str:
    return _fixture(name, shift) + "," + _policy(name, policy)


def _status(correct: str = "correct") -> dict[str, str]:
    return {"valid_escalation": f"escalated and not {correct}", "over_escalation": f"escalated and {correct}", "success_pass": f"not escalated and {correct}", "missed_detection": f"not escalated and not {correct}"}


def _counts(correct: str = "correct") -> str:
    return ", ".join(f"count(*) filter ({c}) as {k}" for k, c in _status(correct).items())


_HITS = ", ".join(f"count(*) filter (contains(\"trigger\", '{h}')) as hit_{n}" for h, n in (("category prior", "category_prior"), ("original uncertainty", "original_uncertainty"), ("logical paradox", "logical_paradox"), ("threshold anomaly", "threshold_anomaly"), ("+", "combined")))
_STRICT_HITS = ", ".join(f"count(*) filter (contains(\"trigger\", '{h}')) as hit_{n}" for h, n in (("original", "original"), ("synonym", "synonym"), ("antonym", "antonym"), ("+", "combined")))
_PAIRED = "with" + _batch("structure", 0, "b") + "," + _batch("structure", 1, "d") + ", q as (select b_p.event_id, b_p.category, b_p.escalated, b_p.correct_null as s, d_p.correct_null as l from b_p join d_p using (event_id))"
_CASE_STATUS = "case when escalated and not s then 'Valid Escalation' when escalated then 'Over_escalation' when s then 'Success Pass' else 'Missed Detection' end"

_CORE = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z]{{2,}}')), lambda x: x not in (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "))"
_COVER = f"""
with w as (select row_id, {_CORE.format("right_answer")} as a, {_CORE.format("hallucinated_answer")} as h, {_CORE.format("context")} as c from example_asqa),
v as (select row_id, cast(len(a) as integer) as answer_words, cast(len(list_intersect(a, c)) as integer) as covered_words, len(list_intersect(a, c))::double / nullif(len(a), 0) as coverage, len(list_intersect(h, c))::double / nullif(len(h), 0) as hc from w)
"""
_TYPE = "case when factoid is null then null " + " ".join("when regexp_matches(lower(factoid), '" + p.replace("'", "''") + f"') then '{n}'" for n, p in TAXONOMY) + f" else '{FALLBACK}' end"
_ORDER = "((id + 42) * 2654435761) % 4294967296"


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::double / nullif(({b}), 0), 0.0)"


def _prf(p: str) -> str:
    tp, fp, tn, fn = (f"{p}{k}" for k in ("tp", "fp", "tn", "fn"))
    return f"round({_ratio(tp, f'{tp} + {fp}')}, 6) as {p}precision, round({_ratio(tp, f'{tp} + {fn}')}, 6) as {p}recall, round({_ratio(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')}, 6) as {p}f1, round({_ratio(f'{tp} + {tn}', f'{tp} + {fp} + {tn} + {fn}')}, 6) as {p}accuracy"


def _cells(p: str, pred: str) -> str:
    return f"count(*) filter ({pred} = 1 and gold_label) as {p}tp, count(*) filter ({pred} = 1 and not gold_label) as {p}fp, count(*) filter ({pred} <> 1 and not gold_label) as {p}tn, count(*) filter ({pred} <> 1 and gold_label) as {p}fn"


_RATES = """
with r as (
  select model, count(*) as responses, cast(sum(response_escalated) as bigint) as escalated, cast(sum(response_rescued) as bigint) as rescued, cast(sum(response_hurt) as bigint) as hurt,
    count(*) filter (response_escalated = 1 and stage1_correct = 0) as escalated_wrong, sum(factoids_total) as f, sum(factoid_escalation_count) as fe, sum(cascade_correct) - sum(stage1_correct) as gain
  from response_log group by model
)
"""


# --- the experiments through the lexical stand-in ---
_WS = r"[\t\n\x0b\f\r\x1c-\x20\x85\p{Z}]"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _core(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda w: w not in ({_STOPS})))"


def _words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^\\t\\n\\x0b\\f\\r\\x1c-\\x20\\x85\\p{{Z}}]+'))"


def _said(x: str) -> str:
    return _core(f"regexp_replace({x}, '^(It is (true|false) that|Put differently:|Nobody holds that)', '')")


def _verdict_of(yes: float, no: float) -> str:
    plain = f"case when share > {yes} then 'YES' when share < {no} then 'NO' else 'NOT SURE' end"
    turned = f"case when share > {yes} then 'NO' when share < {no} then 'YES' else 'NOT SURE' end"
    return f"case when starts_with(probe, 'It is false that') or starts_with(probe, 'Nobody holds that') then {turned} else {plain} end"


def _lines(x: str) -> str:
    return f"list_slice(list_filter(list_transform(string_split({x}, chr(10)), lambda y: regexp_replace(y, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda y: y <> ''), 1, 2)"


_SYN, _ANT = "'It is true that ' || {f} || chr(10) || 'Put differently: ' || {f}", "'It is false that ' || {f} || chr(10) || 'Nobody holds that ' || {f}"
_SHARE = "case when len(said) = 0 then 0.0 else len(list_intersect(said, known))::double / len(said) end"


def _responses_of(evidence: str) -> str:
    """x_r: responses; x_f: factoids; x_p: probes with the share of their words in the evidence."""
    return f"""
with s as (select row_id as sample, coalesce(question, '') as q0, question, {evidence} as evidence, right_answer, hallucinated_answer from example_asqa
), k as (select sample, {_core('evidence')} as known, {_words('evidence')} as evidence_words from s
), x_r as (
  select sample, question, evidence, unnest(['hallucinated', 'right']) as answer_type, unnest([true, false]) as gold_label, unnest([coalesce(hallucinated_answer, ''), coalesce(right_answer, '')]) as answer_text from s
), y as (
  select *, list_filter(string_split(regexp_replace({_strip('answer_text')}, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda z: z <> '') as facts from x_r
), x_f as (select sample, answer_type, unnest(facts) as factoid, unnest(range(len(facts))) as fact_idx from y
), m as (
  select *, 'syn' as kind, {_lines(_SYN.format(f='factoid'))} as l from x_f union all select *, 'ant', {_lines(_ANT.format(f='factoid'))} from x_f
), u as (select sample, answer_type, fact_idx, kind, unnest(l) as probe, unnest(range(len(l))) as ord from m
), v as (select u.*, known, evidence_words, {_said('probe')} as said from u join k using (sample)
), x_p as (select *, {_SHARE} as share from v)"""


def _cost(verdict: str) -> str:
    return f"case {verdict} when 'NOT SURE' then 0.5 when case kind when 'syn' then 'NO' else 'YES' end then 1.0 else 0.0 end"


_SINGLE = _responses_of("coalesce(context, '')") + f"""
, d as (select *, {_verdict_of(0.75, 0.4)} as d1 from x_p
), g as (select sample, answer_type, fact_idx, avg({_cost('d1')}) as score from d group by all
), t as (select sample, answer_type, max(score) as score from g group by all
), c as (select sample, answer_type, sum(2 + evidence_words + {_words('probe')} + case d1 when 'NOT SURE' then 2 else 1 end) as local, count(*) as probes from d group by all
), n as (select sample, answer_type, count(*) as facts, sum(6 * {_words('factoid')} + 13) as mutation from x_f group by all
), o as (
  select y.*, coalesce(t.score, 0.0) as final_score, coalesce(c.local, 0) as local, coalesce(c.probes, 0) as probes, coalesce(n.facts, 0) as n_facts,
    {_words('answer_text')} + case when len(y.facts) = 0 then 1 else len(list_filter(string_split('["' || array_to_string(y.facts, '", "') || '"]', ' '), lambda z: z <> '')) end + coalesce(n.mutation, 0) as cloud
  from y left join t using (sample, answer_type) left join c using (sample, answer_type) left join n using (sample, answer_type)
)
"""
_SINGLE_LOG = _SINGLE + "select h.sample as id, h.question, case when length(h.evidence) > 50 then h.evidence[1:50] || '...' else h.evidence end as context_snippet, " + ", ".join(
    f"{x}.answer_text as {x}_answer, round({x}.final_score, 6) as {x}_score, {x}.final_score >= 0.5 as {d}, 0.0::double as {x}_latency_s, cast({x}.cloud + {x}.local + 1 + 2 * {x}.n_facts + {x}.probes as bigint) as {x}_tokens, cast({x}.cloud as bigint) as {x}_cloud_tokens, cast({x}.local as bigint) as {x}_local_tokens"
    for x, d in (("h", "h_detected"), ("r", "r_false_alarm"))
) + " from o h join o r on h.sample = r.sample and h.answer_type = 'hallucinated' and r.answer_type = 'right'"

_CASCADE = _responses_of("coalesce(nullif(knowledge, ''), context, '')") + f"""
, d as (select *, {_verdict_of(0.9, 0.5)} as d1, {_verdict_of(0.75, 0.4)} as d2, 2 + evidence_words + {_words('probe')} as asked from x_p
), g as (
  select sample, answer_type, fact_idx, coalesce(list(d1 order by ord) filter (kind = 'syn'), []) as syn1, coalesce(list(d1 order by ord) filter (kind = 'ant'), []) as ant1,
    coalesce(list(d2 order by ord) filter (kind = 'syn'), []) as syn2, coalesce(list(d2 order by ord) filter (kind = 'ant'), []) as ant2, avg({_cost('d1')}) as score1, avg({_cost('d2')}) as score2,
    sum(asked + case d1 when 'NOT SURE' then 2 else 1 end) as used1, sum(asked + case d2 when 'NOT SURE' then 2 else 1 end) as used2
  from d group by sample, answer_type, fact_idx
), a as (
  select *, len(list_filter(syn1, lambda z: z in ('NO', 'NOT SURE'))) as sc, len(list_filter(ant1, lambda z: z in ('YES', 'NOT SURE'))) as ac, greatest(len(syn1), 1) as sn, greatest(len(ant1), 1) as an,
    list_contains(syn1, 'YES') and list_contains(ant1, 'YES') as ys, list_contains(syn1, 'NO') and list_contains(ant1, 'NO') as ns
  from x_f left join g using (sample, answer_type, fact_idx)
), b as (
  select *, list_filter([case when ys or ns then 'StructureAware: Logical paradox' end, case when sc >= 2 or sc::double / sn >= 0.4 then 'StructureAware: Synonym anomaly threshold reached (' || sc || '/' || sn || ')' end,
    case when ac >= 2 or ac::double / an >= 0.4 then 'StructureAware: Antonym anomaly threshold reached (' || ac || '/' || an || ')' end], lambda z: z is not null) as reasons
  from a
), e as (select *, len(reasons) > 0 as escalated, case when len(reasons) > 0 then score2 else score1 end as score_c from b
), t as (
  select sample, answer_type, max(score1) as m1, max(score_c) as m2, count(*) as factoids, count(*) filter (escalated) as esc, string_agg(case when escalated then array_to_string(reasons, ' | ') end, ' | ' order by fact_idx) as why,
    sum(used1) as local, sum(used2) filter (escalated) as stage2, sum(6 * {_words('factoid')} + 13) as mutation
  from e group by all
), o as (
  select y.*, coalesce(m1, 0.0) as s1, coalesce(m2, 0.0) as s2, coalesce(factoids, 0) as factoids_total, coalesce(esc, 0) as esc, coalesce(why, '') as why, coalesce(local, 0) as local, coalesce(stage2, 0) as stage2, coalesce(mutation, 0) as mutation,
    {_words('answer_text')} + case when len(y.facts) = 0 then 1 else len(list_filter(string_split('["' || array_to_string(y.facts, '", "') || '"]', ' '), lambda z: z <> '')) end as decompose
  from y left join t using (sample, answer_type)
), l as (
  select sample as id, question, case when length(evidence) > 80 then evidence[1:80] || '...' else evidence end as context_snippet, answer_type, cast(gold_label as integer) as gold_label, answer_text, round(s1, 4) as stage1_final_score, round(s2, 4) as cascade_final_score,
    cast(s1 >= 0.5 as integer) as stage1_pred, cast(s2 >= 0.5 as integer) as cascade_pred, cast((s1 >= 0.5) = gold_label as integer) as stage1_correct, cast((s2 >= 0.5) = gold_label as integer) as cascade_correct, cast(esc > 0 as integer) as response_escalated,
    cast(esc > 0 and (s1 >= 0.5) <> gold_label and (s2 >= 0.5) = gold_label as integer) as response_rescued, cast(esc > 0 and (s1 >= 0.5) = gold_label and (s2 >= 0.5) <> gold_label as integer) as response_hurt, factoids_total, esc as factoid_escalation_count, why as escalation_reasons,
    0.0::double as latency_s, cast(decompose + mutation + stage2 + local as bigint) as tokens_total, cast(decompose + mutation + stage2 as bigint) as tokens_cloud_total, cast(local as bigint) as tokens_local_verify, cast(decompose as bigint) as tokens_api_decompose, cast(mutation as bigint) as tokens_api_mutation, cast(stage2 as bigint) as tokens_api_stage2_verify
  from o
)
"""


def _json_list(x: str) -> str:
    return f"""'[' || array_to_string(list_transform({x}, lambda z: '"' || z || '"'), ', ') || ']'"""


_FACTOID_LOG = _CASCADE + f"""
select e.sample as id, question, e.answer_type, cast(gold_label as integer) as gold_label, cast(fact_idx + 1 as integer) as factoid_id, factoid as factoid_text, cast(escalated as integer) as escalated, array_to_string(reasons, ' | ') as trigger_reasons,
  round(coalesce(score1, 0.0), 4) as stage1_factoid_score, round(coalesce(score_c, 0.0), 4) as cascade_factoid_score, {_json_list('syn1')} as stage1_syn_decisions, {_json_list('ant1')} as stage1_ant_decisions,
  {_json_list('case when escalated then syn2 else syn1 end')} as final_syn_decisions, {_json_list('case when escalated then ant2 else ant1 end')} as final_ant_decisions, cast(sc as integer) as syn_anomaly_count, cast(ac as integer) as ant_anomaly_count,
  round(sc::double / sn, 4) as syn_anomaly_ratio, round(ac::double / an, 4) as ant_anomaly_ratio, cast(ys or ns as integer) as logical_paradox, cast(ys as integer) as both_yes, cast(ns as integer) as both_no, '' as risk_prior
from e join x_r using (sample, answer_type)
"""
_COST_NAMES = ("latency_s", "tokens_total", "tokens_cloud_total", "tokens_local_verify", "tokens_api_decompose", "tokens_api_mutation", "tokens_api_stage2_verify")
_SUMMARY = _CASCADE + f"""
, w as (
  select 'large' as model, {_cells('stage1_', 'stage1_pred').replace('not gold_label', 'gold_label = 0').replace('and gold_label)', 'and gold_label = 1)')}, {_cells('cascade_', 'cascade_pred').replace('not gold_label', 'gold_label = 0').replace('and gold_label)', 'and gold_label = 1)')},
    count(*) as responses, cast(sum(response_escalated) as bigint) as escalated, cast(sum(response_rescued) as bigint) as rescued, cast(sum(response_hurt) as bigint) as hurt, count(*) filter (response_escalated = 1 and stage1_correct = 0) as escalated_wrong,
    sum(factoids_total) as f, sum(factoid_escalation_count) as fe, sum(cascade_correct) - sum(stage1_correct) as gain, count(distinct id) as sample_size, {', '.join(f'round(avg({c}), 6) as {c}_avg' for c in _COST_NAMES)}
  from l
)
select * exclude (f, fe, gain), {_prf('stage1_')}, {_prf('cascade_')}, round({_ratio('escalated', 'responses')}, 6) as response_escalation_rate, round({_ratio('fe', 'f')}, 6) as factoid_escalation_rate, round({_ratio('rescued', 'escalated')}, 6) as rescue_rate,
  round({_ratio('rescued', 'escalated_wrong')}, 6) as conditional_rescue_rate, round({_ratio('hurt', 'escalated')}, 6) as harm_rate, cast(gain as bigint) as net_gain, round({_ratio('gain', 'escalated')} * 100, 6) as efficiency_per_100,
  'structure_aware' as policy, 'small' as small_verifier, 'large' as stage2_verifier, 0.5::double as threshold, 2 as n_mutations
from w
"""


def _batch_of(name: str, yes: float, no: float, made: bool) -> str:
    """name_f: a record's verdicts as the batch runs have them, from its own mutations, or made ones where it has none."""
    listed = lambda part, made_of: f"case when mutations_list is null then {_lines(made_of.format(f='factoid')) if made else '[]'} else list_slice(coalesce(mutations_list.{part}, []), 1, 2) end"
    return f"""
{name}_b as (select id, factoid, context_support, coalesce(context, '') as evidence, {listed('synonyms', _SYN)} as syns, {listed('antonyms', _ANT)} as ants from example_dataset where factoid is not null
), {name}_k as (select id, {_core('evidence')} as known from {name}_b
), {name}_l as (
  select id, 'orig' as kind, factoid as probe, 0 as ord from {name}_b union all select id, 'syn', unnest(syns), unnest(range(len(syns))) from {name}_b union all select id, 'ant', unnest(ants), unnest(range(len(ants))) from {name}_b
), {name}_s as (select id, kind, ord, coalesce(probe, '') as probe, known, {_said("coalesce(probe, '')")} as said from {name}_l join {name}_k using (id)
), {name}_h as (select *, {_SHARE} as share from {name}_s
), {name}_v as (select id, kind, ord, case when {_verdict_of(yes, no)} = 'YES' then 'YES' else 'NO' end as d from {name}_h
), {name}_a as (
  select id, max(d) filter (kind = 'orig') as orig, coalesce(list(d order by ord) filter (kind = 'syn'), []) as syn, coalesce(list(d order by ord) filter (kind = 'ant'), []) as ant from {name}_v group by id
), {name}_f as (select {name}_a.*, factoid_type, context_support as t0 from {name}_a join example_dataset using (id)
), """ + _fixture(name).split("), ", 1)[1]


def _experiments() -> dict[str, str]:
    two = "with" + _batch_of("b", 0.9, 0.5, False) + "," + _policy("b", "structure") + "," + _batch_of("d", 0.75, 0.4, False) + "," + _policy("d", "structure")
    two += ", q as (select b_p.id, b_p.factoid_type, b_p.escalated, b_p.correct_null as s, d_p.correct_null as l from b_p join d_p using (id))"
    md5 = "(('0x' || substr(md5('42|' || row_id), 1, 8))::bigint % 21)"
    order = "list_transform(range(7), lambda i: (['Entity', 'Negation', 'Quantifier', 'Time', 'Comparative', 'Numerical', 'Relational'])[1 + (i * 3 + h) % 7])"
    answers = "(select row_id, unnest(['hallucinated', 'right']) as answer_type, unnest([hallucinated_answer, right_answer]) as t from example_asqa)"
    risk = r"case when regexp_matches(lower(factoid_text), '\b\d+\b') then 'RiskPrior: Numerical/Temporal' when regexp_matches(lower(factoid_text), '\b(not|never|no|none|cannot|without|lack)\b') then 'RiskPrior: Negation' when regexp_matches(lower(factoid_text), '\b(more|less|most|least|better|worse|highest|lowest|all|every|only|always)\b') then 'RiskPrior: Scope/Comparison' end"
    return {
        "experiment_single": _SINGLE + "select sample, answer_type, gold_label, round(final_score, 6) as final_score, final_score >= 0.5 as pred from o",
        "experiment_single_log": _SINGLE_LOG,
        "experiment_cascade": _CASCADE + "select sample, answer_type, round(s1, 6) as stage1_final_score, round(s2, 6) as cascade_final_score, factoids_total, esc as factoid_escalation_count, why as escalation_reasons from o",
        "experiment_response_log": _CASCADE + "select * from l",
        "experiment_factoid_log": _FACTOID_LOG,
        "experiment_summary": _SUMMARY,
        "experiment_batch": "with" + _batch_of("b", 0.75, 0.4, True) + "," + _policy("b", "structure") + 'select id, factoid_type, escalated, "trigger", failure, correct from b_p',
        "experiment_two_verifiers": two + f"select id, factoid_type, {_CASE_STATUS} as status, escalated and not s and l as rescued, escalated and s and not l as harmed from q",
        "judge_support": f"with s as (select row_id, right_answer, context, {_said('right_answer')} as said, {_core('context')} as known from example_asqa where right_answer <> '' and context <> '') select row_id, coalesce({_SHARE} > 0.75, false) as supported from example_asqa left join s using (row_id)",
        "inject_strategies": f"select row_id, array_to_string(list_slice({order}, 1, h // 7 + 1), ', ') as strategies, 'Not so: ' || right_answer as hallucinated_answer from (select row_id, right_answer, {md5} as h from example_asqa where right_answer <> '')",
        "factoid_extraction": f"with y as (select row_id, answer_type, list_filter(string_split(regexp_replace({_strip('t')}, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda z: z <> '') as facts from {answers} where t <> ''), f as (select row_id, answer_type, cast(unnest(range(len(facts))) as integer) as fact_idx, unnest(facts) as factoid from y) select * from f where regexp_replace(factoid, '[\\s\\p{{Z}}]', '', 'g') <> ''",
        "preview_text": r"select doc_id, case when length(p) > 60 then regexp_replace(p[1:60], ' +$', '') || ' ...' else p end as preview from (select doc_id, regexp_replace(regexp_replace(text, '[\s\x0b\p{Z}]+', ' ', 'g'), '^ +| +$', '', 'g') as p from documents)",
        "probe_zip": _LISTS + "select fact_log_id, case when len(syn1) > 0 and len(ant1) > 0 then syn1[1] || '=' || ant1[1] else '' end as pairs from l",
        "map_fields": "select cast(row_id as varchar) as id, coalesce(question, '') as question, coalesce(array_to_string(list_slice(string_split(context, chr(10) || chr(10)), 1, 3), chr(10) || chr(10)), '') as context, coalesce(right_answer, '') as right_answer from example_asqa",
        "escalate_risk": _LISTS + f", e as (select a.fact_log_id, {risk} as risk, list_filter([case when sc > 0 then 'Strict: Synonym anomaly' end, case when ac > 0 then 'Strict: Antonym anomaly' end, case when ys or ns then 'Strict: Logical paradox' end, {risk}], lambda x: x is not null) as r from a join factoid_log using (fact_log_id)) select fact_log_id, len(r) > 0 as escalated, array_to_string(r, ' | ') as reasons, coalesce(risk, '') as risk_prior from e",
        "aligned_totals": "with" + _batch("structure") + f", x as (select category, count(*) as n, count(*) filter (escalated) as escalations, {_counts()}, count(*) filter (not escalated) as quiet from b_p where category is not null group by 1) select category, n, escalations, valid_escalation, over_escalation, success_pass, missed_detection, case when contains(category, 'c') then quiet else 0 end as quiet from x",
        "category_report": "with" + _batch("structure") + f", x as (select category, count(*) as n, round(avg(escalated::integer), 6) as escalation_rate, {_counts()}, {_HITS} from b_p where category is not null group by category), y as (select category, \"trigger\" || ': ' || count(*) as t from b_p where category is not null and \"trigger\" <> 'None' group by category, \"trigger\"), z as (select category, string_agg(t, '; ' order by t) as combinations from y group by category) select x.*, coalesce(combinations, '') as combinations from x left join z using (category)",
        "crosstab_wide": "with" + _batch("structure") + "select category, " + ", ".join(f"count(*) filter (\"trigger\" = '{t}') as n{i}" for i, t in enumerate(("original uncertainty", "logical paradox", "threshold anomaly", "logical paradox + threshold anomaly"))) + " from b_p where category is not null group by category",
        "markdown_report": "with" + _batch("structure") + f", x as (select category, count(*) as n, {_counts()} from b_p where category is not null group by category), y as (select cast(1 + row_number() over (order by category) as integer) as line, '| ' || concat_ws(' | ', category, n, valid_escalation, over_escalation, success_pass, missed_detection) || ' |' as text from x) select * from y union all select 0, '| category | n | valid_escalation | over_escalation | success_pass | missed_detection |' union all select 1, '|---|---|---|---|---|---|'",
        "json_roundtrip": "select row_id, question, context, right_answer from example_asqa",
        "csv_roundtrip": "select log_id, question, answer_type, gold_label, stage1_final_score, latency_s, tokens_total, escalation_reasons from response_log",
        "details_roundtrip": "select log_id, factoid_id, factoid_text, escalated from factoid_log",
    }


def oracle_sql() -> dict[str, str]:
    out = {
        "answer_unpivot": "select row_id, coalesce(nullif(knowledge, ''), context, '') as evidence, unnest(['hallucinated', 'right']) as answer_type, unnest([true, false]) as gold_label, unnest([coalesce(hallucinated_answer, ''), coalesce(right_answer, '')]) as answer_text from example_asqa",
        "context_snippet": "select row_id, case when length(c) > 50 then c[1:50] || '...' else c end as snippet_50, case when length(c) > 80 then c[1:80] || '...' else c end as snippet_80 from (select row_id, coalesce(context, '') as c from example_asqa)",
        "seeded_sample": "select row_id, question from example_asqa order by ((row_id + 42) * 2654435761) % 4294967296, row_id limit 100",
        "response_flags": "with f as (select *, cast(stage1_final_score >= 0.5 as integer) as p1, cast(cascade_final_score >= 0.5 as integer) as p2, (stage1_final_score >= 0.5) = gold_label as o1, (cascade_final_score >= 0.5) = gold_label as o2, factoid_escalation_count > 0 as e from response_log) select log_id, p1 as stage1_pred, p2 as cascade_pred, cast(o1 as integer) as stage1_correct, cast(o2 as integer) as cascade_correct, cast(e as integer) as response_escalated, cast(e and not o1 and o2 as integer) as response_rescued, cast(e and o1 and not o2 as integer) as response_hurt, cast(e and not o1 as integer) as escalated_wrong from f",
        "token_totals": "select log_id, tokens_api_decompose + tokens_api_mutation + tokens_api_stage2_verify as cloud, tokens_api_decompose + tokens_api_mutation + tokens_api_stage2_verify + tokens_local_verify as total, tokens_api_decompose + tokens_api_mutation + tokens_api_stage2_verify + tokens_local_verify + 1 + 6 * factoids_total as legacy from response_log",
        "verdict_parse": _VERDICT + "select row_id, v as verdict from v",
        "verdict_legacy": _VERDICT + r"select row_id, case when contains(v, 'YES') then 'YES' when contains(v, 'NO') then 'NO' else 'NOT SURE' end as legacy2, v as tri, regexp_matches(u, '^[\s\p{Z}]*YES') as oracle_label from v",
        "mutation_parse": r"select doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> ''), 1, 2), '|') as mutations from documents",
        "factoid_parse": """
          with f as (select fact_log_id, case fact_log_id % 4 when 0 then from_json(stage1_syn_decisions, '["VARCHAR"]') when 3 then [] else [coalesce(factoid_text, '')] end as l from factoid_log),
          g as (select fact_log_id, case when len(l) = 0 then [null] else l end as l, len(l) as n from f)
          select fact_log_id, case when n > 0 then cast(unnest(range(0, len(l))) as integer) end as fact_idx, unnest(l) as factoid from g""",
        "factoid_score": _LISTS + "select fact_log_id, round(score1, 4) as score1, round(score2, 4) as score2, score1 >= 0.5 as flagged1 from s",
        "factoid_score_long": _LISTS + "select fact_log_id, round(score1, 4) as score from s",
        "response_score": _LISTS + ", m as (select log_id, max(score1) as a, max(score2) as b from s group by log_id) select r.log_id, round(coalesce(a, 0.0), 4) as stage1_final_score, round(coalesce(b, 0.0), 4) as cascade_final_score from response_log r left join m on m.log_id = r.log_id",
        "escalate_strict": _escalated("case when sc > 0 then 'Strict: Synonym anomaly' end, case when ac > 0 then 'Strict: Antonym anomaly' end, case when ys or ns then 'Strict: Logical paradox' end"),
        "escalate_paradox": _escalated("case when ys or ns then 'ParadoxOnly: Logical paradox' end"),
        "escalate_structure": _escalated("case when ys or ns then 'StructureAware: Logical paradox' end, case when sc >= 2 or sc::double / sn >= 0.4 then 'StructureAware: Synonym anomaly threshold reached (' || sc || '/' || sn || ')' end, case when ac >= 2 or ac::double / an >= 0.4 then 'StructureAware: Antonym anomaly threshold reached (' || ac || '/' || an || ')' end"),
        "cascade_merge": _LISTS + "select fact_log_id, array_to_string(case when escalated = 1 then syn2 else syn1 end, ',') as final_syn, array_to_string(case when escalated = 1 then ant2 else ant1 end, ',') as final_ant from l",
        "reason_concat": "select log_id, coalesce(string_agg(trigger_reasons, ' | ' order by factoid_id, trigger_reasons), '') as reasons from factoid_log group by log_id",
        "factoid_nesting": "select log_id, string_agg(factoid_text, ' / ' order by factoid_id, factoid_text) as factoids from factoid_log group by log_id",
        "confusion_prf": f"with c as (select model, {_cells('stage1_', 'stage1_pred')}, {_cells('cascade_', 'cascade_pred')} from response_log group by model) select *, {_prf('stage1_')}, {_prf('cascade_')} from c",
        "paired_confusion": f"with p as (select model, id, max(case when answer_type = 'hallucinated' then stage1_pred end) = 1 as h, max(case when answer_type = 'right' then stage1_pred end) = 1 as r from response_log where id is not null group by model, id), c as (select model, count(*) filter (h) as tp, count(*) filter (not h) as fn, count(*) filter (r) as fp, count(*) filter (not r) as tn from p group by model) select *, {_prf('')} from c",
        "cascade_rates": _RATES + f"select model, responses, escalated, rescued, hurt, escalated_wrong, round({_ratio('escalated', 'responses')}, 6) as response_escalation_rate, round({_ratio('fe', 'f')}, 6) as factoid_escalation_rate, round({_ratio('rescued', 'escalated')}, 6) as rescue_rate, round({_ratio('rescued', 'escalated_wrong')}, 6) as conditional_rescue_rate, round({_ratio('hurt', 'escalated')}, 6) as harm_rate, cast(gain as bigint) as net_gain, round({_ratio('gain', 'escalated')} * 100, 6) as efficiency_per_100 from r",
        "cost_summary": "select model, " + ", ".join(f"round(avg({c}), 6) as {c}_avg" for c in ("latency_s", "tokens_total", "tokens_cloud_total", "tokens_local_verify", "tokens_api_decompose", "tokens_api_mutation", "tokens_api_stage2_verify")) + " from response_log group by model",
        "usage_by_phase": "select model, cast(coalesce(sum(tokens_api_decompose), 0) as bigint) as tokens_decompose, cast(coalesce(sum(tokens_api_mutation), 0) as bigint) as tokens_mutation, cast(coalesce(sum(tokens_local_verify), 0) as bigint) as tokens_stage1_verify, cast(coalesce(sum(tokens_api_stage2_verify), 0) as bigint) as tokens_stage2_verify, cast(sum(tokens_api_decompose + tokens_api_mutation + tokens_local_verify + tokens_api_stage2_verify) as bigint) as tokens_total, count(tokens_api_decompose) + count(tokens_api_mutation) + count(tokens_local_verify) + count(tokens_api_stage2_verify) as calls, round(sum(latency_s), 6) as latency_s from response_log group by model",
        "original_correct": "with" + _fixture("b") + "select event_id, correct_null as null_incorrect, correct as null_false from b_g",
        "escalation_by_category": "with" + _batch("paradox") + "select category, count(*) as n, round(avg(escalated::integer), 6) as escalation_rate from b_p where category is not null group by category",
        "percent_format": "with" + _batch("paradox") + "select category, printf('%.2f%%', 100 * round(round(avg(escalated::integer), 6), 4)) as escalation from b_p where category is not null group by category",
        "failure_crosstab": "with" + _batch("structure") + "select category, failure, count(*) as n from b_p where category is not null and failure <> 'None' group by 1, 2",
        "trigger_crosstab": "with" + _batch("structure") + "select category, \"trigger\", count(*) as n from b_p where category is not null and \"trigger\" <> 'None' group by 1, 2",
        "status_by_category": "with" + _batch("structure") + f"select category, count(*) as n, {_counts()} from b_p where category is not null group by category",
        "trigger_hits": "with" + _batch("structure") + f"select category, {_HITS} from b_p where category is not null group by category",
        "strict_trigger_hits": "with" + _batch("strict") + f"select category, {_STRICT_HITS} from b_p where category is not null group by category",
        "aligned_stats": "with" + _batch("structure") + ", x as (select category, count(*) as escalations from b_p where escalated and category is not null group by 1), y as (select category, count(*) as n, count(*) filter (not escalated and correct) as success_pass from b_p where event_id % 2 = 0 and category is not null group by 1) select coalesce(x.category, y.category) as category, coalesce(escalations, 0) as escalations, coalesce(n, 0) as n, coalesce(success_pass, 0) as success_pass from x full join y on x.category = y.category",
        "verifier_compare": _PAIRED + f"select event_id, {_CASE_STATUS} as status, escalated and not s and l as rescued, escalated and s and not l as harmed from q",
        "comparative_summary": _PAIRED + f", c as (select category, count(*) as n, count(*) filter (escalated) as e, {_counts('s')}, count(*) filter (escalated and not s and l) as rescued, count(*) filter (escalated and s and not l) as harmed from q where category is not null group by category) select category, n, round({_ratio('e', 'n')}, 6) as escalation_share, " + ", ".join(f"round({_ratio(k, 'n')}, 6) as {k}_share" for k in _status()) + f", round({_ratio('rescued', 'e')}, 6) as rescue_rate, round({_ratio('rescued', 'valid_escalation')}, 6) as conditional_rescue_rate, round({_ratio('harmed', 'e')}, 6) as harm_rate, round({_ratio('rescued - harmed', 'e')} * 100, 6) as efficiency from c",
        "per_verifier_report": "with" + _batch("structure", 0, "b") + "," + _batch("structure", 1, "d") + f", u as (select 'small' as verifier, category, escalated, correct, \"trigger\" from b_p union all select 'large', category, escalated, correct, \"trigger\" from d_p) select verifier, category, count(*) as n, round(avg(escalated::integer), 6) as escalation_rate, {_counts()}, {_HITS} from u where category is not null group by 1, 2",
        "resume_antijoin": "select log_id, model from response_log where log_id not in (select log_id from factoid_log where log_id is not null)",
        "summary_upsert": "with o as (select model, count(*) as n from response_log group by 1), w as (select model, count(*) as n from response_log where model = 'verifier-mid' and stage1_correct = 1 group by 1) select * from o where model not in (select model from w) union all select * from w",
        "mutation_cache": "select id, cast(case when mutations_list is not null and coalesce(len(mutations_list.synonyms), 0) + coalesce(len(mutations_list.antonyms), 0) > 0 then coalesce(len(mutations_list.synonyms), 0) else 0 end as integer) as synonyms, cast(case when mutations_list is not null and coalesce(len(mutations_list.synonyms), 0) + coalesce(len(mutations_list.antonyms), 0) > 0 then coalesce(len(mutations_list.antonyms), 0) else 0 end as integer) as antonyms from example_dataset",
        "replayed_verdicts": _LISTS + "select fact_log_id, case when escalated = 1 and len(syn2) > 0 then syn2[1] else 'NOT SURE' end as verdict, not (escalated = 1 and len(syn2) > 0) as failed from l",
        "lexical_coverage": _COVER + "select row_id, answer_words, covered_words, round(coverage, 6) as coverage from v",
        "grounding_filter": _COVER + "select row_id from v where coverage is null or coverage > 0.4",
        "dual_validation": _COVER + "select row_id from v where coverage > 0.4 and hc < 1.0",
        "statement_coverage": f"with s as (select item_id, unnest(w) as w, len(w) as n from (select item_id, {_CORE.format('question')} as w from eval_item)), d as (select doc_id, unnest({_CORE.format('text')}) as w from documents) select item_id, doc_id, count(*) as matched, round(count(*)::double / any_value(n), 6) as coverage from s join d using (w) group by 1, 2 having count(*)::double / any_value(n) > 0.6",
        "taxonomy": f"select id, {_TYPE} as fact_type from example_dataset",
        "merge_pools": "select 'dataset' as pool, count(*) as n, count(context) as with_context from example_dataset where factoid is not null union all select 'log', count(*), 0 from factoid_log where factoid_text is not null",
        "balanced_sample": f"with t as (select id, {_TYPE} as fact_type, context_support, {_ORDER} as o from example_dataset where context_support is not null), r as (select id, fact_type, context_support, row_number() over (partition by fact_type, context_support order by o, id) as rank from t where fact_type is not null) select *, row_number() over (order by fact_type, context_support, rank) as new_id from r where rank <= 50",
        "source_components": "with f as (select id, min(row_id) as m, count(*) as n from example_asqa where id is not null group by id) select a.row_id as node, f.m as component from example_asqa a join f using (id) where n > 1",
    }
    for name, policy in (("batch_paradox", "paradox"), ("batch_strict", "strict"), ("batch_structure", "structure")):
        out[name] = "with" + _batch(policy) + 'select event_id, escalated, "trigger", failure from b_p'
    return out | _experiments()
