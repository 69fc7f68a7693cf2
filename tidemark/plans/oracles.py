"""DuckDB SQL for the registered queries, written in other formulations than the operators."""

from __future__ import annotations

from tidemark.definitions import definition_set_digest
from tidemark.operators.assurance import DIAGNOSES, GATES, OFFLINE_MOVES, TELEMETRY_EVENTS
from tidemark.plans.queries import CUTOFF, FEATURE_SET, FEATURES, FIRST, MADE_AT, NAMES, OPERATION, SECOND, SOURCE

_EVENTS = """
e as (
  select event_id, user_id, event_type, value, cast(floor(epoch(ts)) as bigint) as t, cast(json_extract_string(props, '$.k') as double) as k from events
)"""
_REV = (
    _EVENTS
    + """, base as (
  select event_id, event_id || '-r1' as revision_id, user_id as customer_id, t as event_time, t + (event_id * 37) % 7200 as knowledge_time, 'upsert' as operation,
    cast(round(value * 100) as bigint) as amount_cents, case when event_type = 'error' then 'failed' else 'succeeded' end as status, k / 100 as merchant_risk
  from e where event_type <> 'view'
), rev as (
  select * from base
  union all select event_id, event_id || '-r2', customer_id, event_time + case when event_id % 14 = 0 then 3600 else 0 end, knowledge_time + 7200 + 86400 * (event_id % 5), operation, amount_cents + 100, status, merchant_risk from base where event_id % 7 = 0
  union all select event_id, event_id || '-r3', customer_id, event_time, knowledge_time + 700000 + 86400 * (event_id % 5), 'retract', null, null, null from base where event_id % 11 = 0
), lab as (
  select event_id as label_id, user_id as customer_id, t as label_time, t - (event_id % 3) * 1800 as prediction_knowledge_time, event_id % 2 as value from e where event_type = 'purchase'
), spine as (select distinct user_id as customer_id from e)"""
)
_DIRTY = """, dirty as (
  select * from rev
  union all select event_id, event_id || '-b1', customer_id, event_time, event_time - 5, operation, amount_cents, status, merchant_risk from rev where event_id % 97 = 1 and operation = 'upsert'
  union all select event_id, event_id || '-b2', customer_id, event_time, knowledge_time, operation, -1, status, 1.5 from rev where event_id % 97 = 1 and operation = 'upsert'
  union all select event_id, '', customer_id, event_time, knowledge_time, 'retract', amount_cents, status, merchant_risk from rev where event_id % 97 = 1 and operation = 'upsert'
), judged as (
  select *, concat_ws(',', case when revision_id = '' then 'EMPTY_REVISION_ID' end, case when knowledge_time < event_time then 'KNOWN_BEFORE_EVENT' end,
    case when operation = 'retract' and amount_cents is not null then 'RETRACT_WITH_PAYLOAD' end, case when operation = 'upsert' and amount_cents < 0 then 'BAD_AMOUNT' end,
    case when operation = 'upsert' and merchant_risk > 1 then 'BAD_RISK' end) as violations from dirty
)"""
_CONTRA = """, contra as (
  select * from rev
  union all select event_id, revision_id, customer_id, event_time, knowledge_time, operation, amount_cents + 1, status, merchant_risk from base where event_id % 89 = 2
  union all select event_id, event_id || '-x', customer_id, event_time, knowledge_time, operation, amount_cents, status, merchant_risk from base where event_id % 89 = 2
  union all select event_id, event_id || '-m', customer_id + 1, event_time, knowledge_time + 1, operation, amount_cents, status, merchant_risk from base where event_id % 83 = 3
  union all select * from rev where event_id % 5 = 0
), once as (select distinct * from contra)"""


def _decimal(x: str) -> str:
    """The number's text with its exponent carried out: digits, then where the point falls."""
    return f"""(select case when {x} is null or not isfinite({x}) then null when ds = '' then '0' else (case when {x} < 0 then '-' else '' end) ||
      case when p <= 0 then '0.' || repeat('0', -p) || ds when p >= length(ds) then rpad(ds, p::int, '0') else ds[1:p] || '.' || ds[p + 1:] end end
      from (select rtrim(ltrim(digits, '0'), '0') as ds, whole + e - (length(digits) - length(ltrim(digits, '0'))) as p from
        (select replace(m, '.', '') as digits, length(split_part(m, '.', 1)) as whole, coalesce(try_cast(split_part(v, 'e', 2) as int), 0) as e from (select v, split_part(v, 'e', 1) as m from (select ltrim(cast({x} as varchar), '-') as v)))))"""


def _hash(**fields: str) -> str:
    """SHA-256 of a row's canonical text; the fields are SQL texts."""
    return "sha256(" + " || chr(31) || ".join(f"'{n}=' || coalesce({x}, chr(30))" for n, x in sorted(fields.items())) + ")"


def _digest(h: str) -> str:
    lanes = " || ':' || ".join(f"coalesce(sum(('0x' || substr({h}, {1 + 16 * i}, 16))::ubigint), 0)::varchar" for i in range(4))
    return f"count(*) as row_count, sha256(count(*)::varchar || ':' || {lanes}) as rows_digest"


_REV_HASH = _hash(event_id="event_id::varchar", revision_id="revision_id", customer_id="customer_id::varchar", event_time="event_time::varchar", knowledge_time="knowledge_time::varchar", operation="operation", amount_cents="amount_cents::varchar", status="status", merchant_risk=_decimal("merchant_risk"))


def _state(at: int | str, name: str) -> str:
    return f""", {name} as (
  select * exclude (rn) from (select *, row_number() over (partition by event_id order by knowledge_time desc, revision_id desc) as rn from rev where knowledge_time <= {at}) where rn = 1
)"""


# raw value and default of each feature over the events x of a window, relative to an anchor
_VALUES = (
    ("count(x.event_id)", "0"),
    ("cast(sum(case when x.status = 'succeeded' then x.amount_cents end) as bigint)", "0"),
    ("sum(case when x.status = 'failed' then 1.0 else 0.0 end)::double / nullif(count(x.event_id), 0)", "0.0"),
    ("({anchor} - max(case when x.status = 'succeeded' then x.event_time end))::double / 3600", "null"),
    ("max(x.merchant_risk)", "null"),
)


def _gen(state: str, at: int | str, name: str, generation: str, spine: str = "spine") -> str:
    parts = []
    for d, (raw, default) in zip(FEATURES, _VALUES, strict=True):
        value = f"coalesce({raw.format(anchor=CUTOFF)}, {default})"
        integer = d.value_type == "integer"
        parts.append(f"""select s.customer_id, '{d.name}' as feature_name, {value + '::bigint' if integer else 'null::bigint'} as value_long, {'null::double' if integer else value + '::double'} as value_double,
    {CUTOFF}::bigint as event_time, {at}::bigint as knowledge_time, '{d.digest}' as definition_digest, '{generation}' as generation_id
    from {spine} s left join {state} x on x.customer_id = s.customer_id and x.operation = 'upsert' and x.event_time <= {CUTOFF} and x.event_time > {CUTOFF - d.window_seconds} group by s.customer_id""")
    return f", {name} as (" + " union all ".join(parts) + ")"


_WITH = "with" + _REV
_GEN2 = _WITH + _state(SECOND, "st2") + _gen("st2", SECOND, "gen2", "g2")
_GEN12 = _WITH + _state(FIRST, "st1") + _state(SECOND, "st2") + _gen("st1", FIRST, "gen1", "g") + _gen("st2", SECOND, "gen2", "g")

_LAST = "(select max(knowledge_time) from rev)"
_GEN_LAST = _WITH + _state(_LAST, "stl") + _gen("stl", _LAST, "genl", "g")
_VALUE_HASH = _hash(customer_id="customer_id::varchar", feature_name="feature_name", value_long="value_long::varchar", value_double=_decimal("value_double"), event_time="event_time::varchar", knowledge_time="knowledge_time::varchar", definition_digest="definition_digest", generation_id="generation_id")
_TTL = "case feature_name " + " ".join(f"when '{d.name}' then {d.ttl_seconds}" for d in FEATURES) + " end"
_IS_INT = "feature_name in (" + ", ".join(f"'{d.name}'" for d in FEATURES if d.value_type == "integer") + ")"


def _record_hash(customer: str = "customer_id", expires: str = "expires_at", key: str = "partition_key") -> str:
    return _hash(feature_set="feature_set", generation_id="generation_id", customer_id=f"({customer})::varchar", feature_name="feature_name", definition_digest="definition_digest", value_kind="value_kind", value_integer="value_integer::varchar", value_decimal="value_decimal", event_cutoff="event_cutoff::varchar", knowledge_cutoff="knowledge_cutoff::varchar", materialized_at="materialized_at::varchar", expires_at=f"({expires})::varchar", source_digest="source_digest", offline_rows_digest="offline_rows_digest", operation_id="operation_id", partition_key=key, sort_key="sort_key")


def _records(gen: str, name: str) -> str:
    return f""", {name}_whole as (select {_digest('h')} from (select {_VALUE_HASH} as h from {gen})), {name}_body as (
  select '{FEATURE_SET}' as feature_set, generation_id, customer_id, feature_name, definition_digest,
    case when value_long is null and value_double is null then 'null' when {_IS_INT} then 'integer' else 'float' end as value_kind, value_long as value_integer, {_decimal('value_double')} as value_decimal,
    event_time as event_cutoff, knowledge_time as knowledge_cutoff, {MADE_AT}::bigint as materialized_at, event_time + {_TTL} as expires_at, '{SOURCE}' as source_digest, rows_digest as offline_rows_digest, '{OPERATION}' as operation_id,
    'ENTITY#' || customer_id || '#GEN#' || generation_id as partition_key, 'FEATURE#' || feature_name || '#DEF#' || definition_digest as sort_key
  from {gen}, {name}_whole
), {name} as (select *, {_record_hash()} as record_digest from {name}_body)"""


_STORED = f""", stored as (
  select * replace (case when customer_id % 10 = 5 then sha256(record_digest) else record_digest end as record_digest) from (
    select * exclude (record_digest), {_record_hash()} as record_digest from (select * replace (case when customer_id % 10 = 4 then expires_at + 1 else expires_at end as expires_at) from rec where customer_id % 10 <> 3))
  union all
  select * exclude (record_digest), {_record_hash()} as record_digest from (select * replace (-customer_id - 1 as customer_id, 'ENTITY#' || (-customer_id - 1) || '#GEN#' || generation_id as partition_key) from rec where customer_id % 10 = 6)
)"""
_REC = _GEN2 + _records("gen2", "rec")
_RECS = _REC + _STORED


def _dataset(labels: str, known: str) -> str:
    """One grouping per label and feature, each over its own window; ``known``: which ranked revisions a label sees."""
    sub = []
    for d, (raw, default) in zip(FEATURES, _VALUES, strict=True):
        sub.append(f"coalesce((select {raw.format(anchor='l.label_time')} from seen x where x.label_id = l.label_id and x.event_time > l.label_time - {d.window_seconds}), {default}) as {d.name}")
    return f""", ranked as (
  select l.label_id, l.label_time, r.*, row_number() over (partition by l.label_id, r.event_id order by r.knowledge_time desc, r.revision_id desc) as rn
  from {labels} l join rev r on r.customer_id = l.customer_id and {known}
), seen as (select * from ranked where rn = 1 and operation = 'upsert' and event_time <= label_time),
data as (select l.*, {', '.join(sub)} from {labels} l)"""


def _cut(as_of: int) -> str:
    return f", cut as (select *, prediction_knowledge_time as requested_cutoff, least(prediction_knowledge_time, {as_of}) as effective_cutoff, {as_of}::bigint as dataset_as_of, prediction_knowledge_time > {as_of} as truncated from lab)"


_CHANGED = f""", chg as (
  select coalesce(a.event_id, b.event_id) as event_id, a.revision_id as prior, b.revision_id as current, a.customer_id as pc, b.customer_id as cc, a.event_time as pt, b.event_time as ct
  from (select * from st1 where operation = 'upsert') a full join (select * from st2 where operation = 'upsert') b on a.event_id = b.event_id where a.revision_id is distinct from b.revision_id
), defs as (select * from (values {', '.join(f"('{d.name}', {d.window_seconds})" for d in FEATURES)}) v(feature_name, win)), pairs as (
  select distinct c as customer_id, feature_name from (select unnest([pc, cc]) as c, feature_name from chg, defs where (pt <= {CUTOFF} and pt > {CUTOFF} - win) or (ct <= {CUTOFF} and ct > {CUTOFF} - win)) where c is not null
)"""
_SCOPE = _WITH + _state(FIRST, "st1") + _state(SECOND, "st2") + _CHANGED
_SCOPED = _SCOPE + f", seen_customers as (select count(distinct customer_id) as customers from rev where knowledge_time <= {SECOND})"
_MODE = "select (select count(*) from pairs) as affected_pairs, customers, customers * 5 as total_pairs, (select count(*) from pairs) / (customers * 5) as fraction, case when (select count(*) from pairs) / (customers * 5) > 0.75 then 'full' else 'incremental' end as mode"

_F = "case event_id % 5 " + " ".join(f"when {i} then '{{{i}}}'" for i in range(5)) + " end"
_REQUESTS = f""", req as (
  select event_id as request_id, '{FEATURE_SET}' as feature_set, case when event_id % 31 = 0 then 'g9' else 'g2' end as generation_id,
    case when event_id % 41 = 0 then -user_id when event_id % 43 = 0 then -user_id - 1 else user_id end as customer_id, {_F.format(*NAMES)} as feature_name,
    case when event_id % 37 = 0 then sha256({_F.format(*[d.digest for d in FEATURES])}) else {_F.format(*[d.digest for d in FEATURES])} end as definition_digest,
    {CUTOFF} + (event_id * 997) % 3000000 as request_time, case when event_id % 2 = 0 then 1000000 end as maximum_freshness_age from e
)"""
_SERVED = f""", served as (
  select q.*, s.value_kind, s.value_integer, s.value_decimal, case when q.generation_id = 'g9' then 'GENERATION_UNAVAILABLE' when s.record_digest is null then 'ABSENT' when s.definition_digest <> q.definition_digest then 'DEFINITION_MISMATCH'
    when s.record_digest <> s.actual then 'CORRUPT_RECORD' when q.request_time >= s.expires_at then 'EXPIRED' when q.request_time - s.knowledge_cutoff > q.maximum_freshness_age then 'STALE' else 'FOUND' end as status
  from req q left join (select *, {_record_hash()} as actual from stored) s on s.generation_id = q.generation_id and s.customer_id = q.customer_id and s.feature_name = q.feature_name
)"""
_HISTORY = """, hist as (
  select 'set-' || user_id as feature_set, row_number() over w + case when event_id % 61 = 0 then 1 else 0 end as pointer_version,
    case when event_id % 67 = 0 then 'g-lost' else lag('g-' || event_id) over w end as from_generation, 'g-' || event_id as to_generation, 'op-' || case when event_id % 71 = 0 then 0 else event_id end as operation_id, t as activated_at
  from e where event_type = 'purchase' window w as (partition by user_id order by t, event_id)
)"""
_GATED = (
    ", per as (select user_id, count(*) as n, sum(event_id) as s from e group by 1), gated as (select 'g-' || user_id as generation_id, 'op-' || n as operation_id, concat_ws(',', "
    + ", ".join(f"case when s % {i + 5} = 0 then '{code}' end" for i, (_, code) in enumerate(GATES))
    + ") as reasons, "
    + "concat_ws(',', "
    + ", ".join(f"case when s % {i + 5} = 0 then '{code}' end" for i, (name, code) in enumerate(GATES) if name != "parity_passed")
    + ") as other_reasons from per)"
)
_DIAG = ", diag as (select * from (values " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in DIAGNOSES) + ") v(signal, layer, impact, action))"
_COMPARED = f""", cmp as (
  select coalesce(a.customer_id, b.customer_id) as customer_id, coalesce(a.feature_name, b.feature_name) as feature_name, b.customer_id is null as missing, a.customer_id is null as extra,
    case when a.customer_id is not null and b.customer_id is not null and a.expires_at <> b.expires_at then 'expires_at' else '' end as semantic_fields,
    a.customer_id is not null and b.customer_id is not null and (a.expires_at <> b.expires_at or a.record_digest <> b.record_digest) as envelope_differs,
    case when a.customer_id is null or b.customer_id is null then null when {CUTOFF + 700_000} >= b.expires_at then 'EXPIRED' when {CUTOFF + 700_000} - b.knowledge_cutoff > 690000 then 'STALE' end as ineligible
  from rec a full join stored b on a.customer_id = b.customer_id and a.feature_name = b.feature_name
)"""
_SUMMED = """ select count(*) as compared_count, count_if(missing) as missing_count, count_if(extra) as extra_count, count_if(semantic_fields <> '') as semantic_mismatch_count, count_if(envelope_differs) as envelope_mismatch_count, count_if(ineligible is not null) as ineligible_count from """
_CODES = "concat_ws(',', case when missing_count > 0 then 'MISSING_RECORD' end, case when extra_count > 0 then 'EXTRA_RECORD' end, case when semantic_mismatch_count > 0 then 'SEMANTIC_MISMATCH' end, case when envelope_mismatch_count > 0 then 'ENVELOPE_MISMATCH' end, case when ineligible_count > 0 then 'INELIGIBLE_RECORD' end, 'AGGREGATE_MISMATCH')"
_SAMPLE = """, strat as (
  select *, row_number() over (partition by stratum order by sha256('73|' || stratum || '|' || customer_id || '|' || feature_name)) as rn
  from (select customer_id, feature_name, case when customer_id % 3 <> 0 then 's' || (customer_id % 3) else 'ordinary' end as stratum from gen2)
), sample as (select stratum, customer_id, feature_name from strat where rn <= 12)"""
_KEYED = """ select 'ENTITY#' || customer_id || '#GEN#g' as partition_key, 'FEATURE#' || feature_name || '#DEF#' || definition_digest as sort_key, customer_id,
  sha256(concat_ws('|', case when value_long is null and value_double is null then 'null' when """ + _IS_INT + """ then 'integer' else 'float' end, value_long::varchar, """ + _decimal("value_double") + ")) as digest from "
_TRIALS = """, tr as (
  select 'case-' || (user_id % 40) as case_id, event_type as operation, event_id % 6 <> 0 as warm, cast(round(value * 1000) as bigint) + 1 as duration_ns, (event_id % 2)::varchar as output_digest, event_id % 397 <> 0 as ok from e
), w as (select case_id, operation, duration_ns, row_number() over (partition by case_id, operation order by duration_ns) as i, count(*) over (partition by case_id, operation) as n from tr where warm
), q as (
  select case_id, operation, count(*) as warm_count, min(duration_ns) as minimum_ns, cast(floor(median(duration_ns)) as bigint) as median_ns, max(duration_ns) as maximum_ns,
    cast(floor(median(duration_ns) filter (where i > n - n // 2) - median(duration_ns) filter (where i <= n // 2)) as bigint) as warm_interquartile_range_ns, stddev_pop(duration_ns) / avg(duration_ns) as coefficient_of_variation from w group by all
), g as (select case_id, operation, count_if(not warm) as cold_count, count_if(not ok) as bad, 1::bigint as input_digests, count(distinct output_digest) as output_digests from tr group by all)"""
_LAG = """, c as (
  select event_id, t as event_time, t + event_id % 7200 - case when event_id % 53 = 0 then 7300 else 0 end as knowledge_time, t + 8000 as f, t + 8100 as bs, t + 8100 + event_id % 900 as bc, t + 9100 as ms, t + 9100 + event_id % 60 as mc,
    t + 9300 as cv, t + 9400 - case when event_id % 59 = 0 then 200 else 0 end as aa, t + 20000 + event_id % 5000 as rt, case when event_id % 47 = 0 then -1 else t + 7200 end as rf, t + 22000 as x from e
), v as (select *, concat_ws(',', case when rf < 0 then 'NEGATIVE_CLOCK' end, case when knowledge_time < event_time or aa < cv then 'CLOCK_REGRESSED' end) as violations from c)"""
_NAMES = "[" + ", ".join(f"'{n}'" for n in TELEMETRY_EVENTS) + "]"

SQL = {
    "revision_dedup": f"{_WITH}{_CONTRA} select * from once",
    "revision_violations": f"{_WITH}{_DIRTY} select event_id, revision_id, operation, violations from judged where violations <> ''",
    "revision_conflicts": f"""{_WITH}{_CONTRA} select 'REVISION_REUSED' as conflict, revision_id as key, count(*) as variants from once group by revision_id having count(*) > 1
      union all select 'SAME_CLOCK', event_id || '@' || knowledge_time, count(distinct revision_id) from once group by event_id, knowledge_time having count(distinct revision_id) > 1
      union all select 'CUSTOMER_CHANGED', event_id::varchar, count(distinct customer_id) from once group by event_id having count(distinct customer_id) > 1""",
    "reject_split": f"{_WITH}{_DIRTY} select count(*) as total_rows, count_if(violations <> '') as rejected_rows, case when count_if(violations <> '') > 0 then 'REJECTED' else 'ACCEPTED' end as verdict, (select string_agg(c, ',' order by c) from (select distinct unnest(string_split(violations, ',')) as c from judged where violations <> '')) as codes from judged",
    "strict_decode": f"{_WITH} select case when event_id % 101 = 1 then 'MALFORMED' when event_id % 101 = 2 then 'UNKNOWN_FIELD' when event_id % 101 = 3 and operation = 'upsert' then 'UNKNOWN_OPERATION' else '' end as violations, count(*) as rows from rev group by 1",
    "legacy_upgrade": f"{_WITH} select event_id, event_id || '@' || knowledge_time as revision_id, customer_id, event_time, knowledge_time, 'upsert' as operation, amount_cents, status, merchant_risk from base",
    "label_checks": f"""{_WITH}, both_ as (select *, label_id % 50 = 0 as late from lab union all select *, label_id % 50 = 0 from lab where label_id % 40 = 0)
      select case when late then 'CUTOFF_AFTER_LABEL' else '' end as code, count(*) as rows from both_ group by 1 union all select 'DUPLICATE_LABEL', count(*) from (select label_id from both_ group by 1 having count(*) > 1)""",
    "latest_known_state": f"{_WITH}{_state(SECOND, 'st')} select * from st",
    "standing_events": f"{_WITH}{_state(SECOND, 'st')} select * from st where operation = 'upsert' and event_time <= {CUTOFF}",
    "validity_intervals": f"{_WITH} select a.event_id, a.revision_id, a.knowledge_time as known_from, coalesce(min(b.knowledge_time), {(1 << 62) - 1})::bigint as known_to from rev a left join rev b on a.event_id = b.event_id and b.knowledge_time > a.knowledge_time group by all",
    "generation_long": f"{_GEN2} select * from gen2",
    "expected_projection": f"{_GEN2} select * from gen2",
    "generation_spine_defaults": f"{_WITH}, cust as (select c_custkey as customer_id from customer){_state(SECOND, 'st2')}{_gen('st2', SECOND, 'gen2', 'g2', 'cust')} select customer_id, " + ", ".join(f"max({'value_long' if d.value_type == 'integer' else 'value_double'}) filter (where feature_name = '{d.name}') as {d.name}" for d in FEATURES) + " from gen2 group by 1",
    "pit_training_dataset": f"{_WITH}{_cut(SECOND)}{_dataset('cut', 'r.knowledge_time <= l.effective_cutoff')} select * from data",
    "pit_training_tiled": f"{_WITH}{_cut(SECOND)}{_dataset('cut', 'r.knowledge_time <= l.effective_cutoff')} select * from data",
    "rolling_features": f"{_WITH}, cut as (select customer_id || '@' || ({CUTOFF} - 604800 * w) as label_id, customer_id, {CUTOFF} - 604800 * w as label_time, {CUTOFF} - 604800 * w as effective_cutoff from spine, range(12) x(w)){_dataset('cut', 'r.knowledge_time <= l.effective_cutoff')} select customer_id, label_time, {', '.join(NAMES)} from data",
    "digest_tree": f"{_GEN2} select count(*)::bigint as rows, 1::bigint as damaged from gen2",
    "pit_training_dealt": f"{_WITH}, hot_rev as (select * replace (case when event_id % 5 < 4 then 0 else customer_id end as customer_id) from rev), hot_lab as (select * replace (case when label_id % 5 < 4 then 0 else customer_id end as customer_id) from lab){_cut(SECOND).replace('from lab', 'from hot_lab')}{_dataset('cut', 'r.knowledge_time <= l.effective_cutoff').replace('join rev r', 'join hot_rev r')} select * from data",
    "sql_training_set": f"{_WITH}{_cut(SECOND)}{_dataset('cut', 'r.knowledge_time <= l.effective_cutoff')} select label_id, customer_id, label_time, prediction_knowledge_time, value, effective_cutoff, {', '.join(NAMES)} from data where label_id % 2 = 0",
    "sql_features_at": f"{_GEN12} select a.customer_id, a.value_long as before, b.value_long as after, c.value_double as ratio from gen1 a join gen2 b on a.customer_id = b.customer_id and a.feature_name = '{NAMES[0]}' and b.feature_name = '{NAMES[0]}' join gen2 c on c.customer_id = a.customer_id and c.feature_name = '{NAMES[2]}'",
    "sql_state_at": f"{_WITH}{_state(FIRST, 'st1')}{_state(SECOND, 'st2')} select 'first' as at, operation, count(*) as events, sum(amount_cents)::bigint as cents from st1 group by operation union all select 'second', operation, count(*), sum(amount_cents)::bigint from st2 group by operation",
    "pit_label_cutoffs": f"{_WITH}{_cut(CUTOFF)} select * from cut",
    "pit_leakage_report": f"{_WITH}{_cut(2_000_000_000)}{_dataset('cut', 'r.knowledge_time <= l.effective_cutoff').replace('data as', 'right_ as')}{_dataset('cut', 'true').replace('ranked', 'ranked2').replace('seen', 'seen2').replace('data as', 'wrong as')} "
    + " union all ".join(f"select '{n}' as feature_name, count(*) as labels, count_if(a.{n} is distinct from b.{n}) as leaked from right_ a join wrong b using (label_id)" for n in NAMES),
    "state_diff": f"{_SCOPE} select event_id, prior, current from chg",
    "affected_pairs": f"{_SCOPE} select * from pairs",
    "affected_mode": f"{_SCOPED} {_MODE} from seen_customers",
    "incremental_generation": f"{_GEN2} select * from gen2",
    "kept_refresh": f"{_GEN2} select * from gen2",
    "layered_refresh": f"{_GEN2} select * from gen2",
    "kept_layers": f"{_WITH}{_state(SECOND, 'st')} select * from st",
    "incremental_work_summary": f"{_SCOPED}, w as ({_MODE} from seen_customers), ac as (select count(distinct customer_id) as affected_customers from pairs) select w.*, affected_customers, (select count(*) * 5 from spine) as predecessor_rows, affected_customers * 5 as recomputed_rows, (select count(*) * 5 from spine) - affected_pairs as preserved_rows from w, ac",
    "changed_within_scope": f"{_SCOPE}{_gen('st1', FIRST, 'gen1', 'g')}{_gen('st2', SECOND, 'gen2', 'g')}, ch as (select a.customer_id, a.feature_name from gen1 a join gen2 b on a.customer_id = b.customer_id and a.feature_name = b.feature_name where a.value_long is distinct from b.value_long or a.value_double is distinct from b.value_double) select count_if(p.customer_id is not null and c.customer_id is not null) as common, count(*) as either, count_if(c.customer_id is null) as only_expected, count_if(p.customer_id is null) as only_actual, count_if(p.customer_id is null) = 0 as actual_is_subset from pairs p full join ch c on p.customer_id = c.customer_id and p.feature_name = c.feature_name",
    "snapshot_stats": f"{_WITH} select count(*) as revisions, count(distinct event_id) as events, min(event_time) as minimum_event_time, max(event_time) as maximum_event_time, min(knowledge_time) as minimum_knowledge_time, max(knowledge_time) as maximum_knowledge_time, (select rows_digest from (select {_digest('h')} from (select {_REV_HASH} as h from rev))) as rows_digest from rev",
    "label_snapshot": f"{_WITH} select count(*) as labels, min(label_time) as minimum_label_time, max(label_time) as maximum_label_time, min(prediction_knowledge_time) as minimum_cutoff, max(prediction_knowledge_time) as maximum_cutoff, (select rows_digest from (select {_digest('h')} from (select {_hash(label_id='label_id::varchar', customer_id='customer_id::varchar', label_time='label_time::varchar', prediction_knowledge_time='prediction_knowledge_time::varchar', value='value::varchar')} as h from lab))) as rows_digest from lab",
    "definition_conflicts": f"with{_EVENTS}, cl as (select event_type || ':v1' as identity, sha256(case when event_id % 500 = 1 then event_type || '!' when event_type in ('click', 'view') then 'same' else event_type end) as x from e) select 'IDENTITY_REUSED' as conflict, identity as key, count(distinct x) as variants from cl group by identity having count(distinct x) > 1 union all select 'DIGEST_SHARED', x, count(distinct identity) from cl group by x having count(distinct identity) > 1",
    "revision_rows_digest": f"{_WITH} select {_digest('h')} from (select {_REV_HASH} as h from rev)",
    "canonical_numbers": f"with{_EVENTS} select event_id, {_decimal('(value * k / 7)')} as canonical, {_decimal('(value * k / 7 * 1e12::double)')} as large, {_decimal('(value * k / 7 / -1e35::double)')} as tiny, isfinite(value * k / 7) as finite from e",
    "upsert_classification": f"{_GEN12}, a as ({_KEYED} gen1 where customer_id % 4 <> 0), b as ({_KEYED} gen2) select b.partition_key, b.sort_key, b.digest, case when a.digest is null then 'written' when a.digest = b.digest then 'replayed' else 'conflict' end as outcome from b left join a on a.partition_key = b.partition_key and a.sort_key = b.sort_key",
    "missing_records": f"{_RECS} select customer_id, feature_name, record_digest from rec where customer_id % 10 = 3",
    "latest_per_key": f"with{_EVENTS} select customer_id, feature_name, event_time, knowledge_time, event_id, value from (select user_id as customer_id, event_type as feature_name, t as event_time, t + event_id % 50 as knowledge_time, event_id, value, row_number() over (partition by user_id, event_type order by t desc, t + event_id % 50 desc, event_id desc) as rn from e) where rn = 1",
    "online_records": f"{_REC} select * from rec",
    "online_plan_summary": f"{_REC} select feature_set, generation_id, operation_id, row_count as expected_count, rows_digest as records_digest from (select feature_set, generation_id, operation_id, {_digest('record_digest')} from rec group by 1, 2, 3)",
    "parity_diff": f"{_GEN12} select coalesce(a.customer_id, b.customer_id) as customer_id, coalesce(a.feature_name, b.feature_name) as feature_name, case when b.customer_id is null then 'MISSING' when a.customer_id is null then 'EXTRA' else 'MISMATCH' end as difference from (select * from gen1 where customer_id % 10 <> 4) a full join (select * from gen2 where customer_id % 10 <> 3) b on a.customer_id = b.customer_id and a.feature_name = b.feature_name where a.customer_id is null or b.customer_id is null or a.value_long is distinct from b.value_long or a.value_double is distinct from b.value_double",
    "comparator_report": f"{_RECS}{_COMPARED} select * from cmp where missing or extra or semantic_fields <> '' or envelope_differs or ineligible is not null",
    "parity_summary": f"{_RECS}{_COMPARED}, n as ({_SUMMED} cmp) select n.*, ed.row_count as expected_count, ed.rows_digest as expected_digest, ad.row_count as actual_count, ad.rows_digest as actual_digest, {_CODES} as reasons, false as passed from n, (select {_digest('record_digest')} from rec) ed, (select {_digest('record_digest')} from stored) ad",
    "stratified_sample": f"{_GEN2}{_SAMPLE} select * from sample",
    "sampled_parity": f"{_RECS}{_COMPARED}{_SAMPLE}, n as ({_SUMMED} (select c.* replace (null as ineligible) from cmp c join sample s on c.customer_id = s.customer_id and c.feature_name = s.feature_name)) select compared_count, missing_count, extra_count, semantic_mismatch_count, envelope_mismatch_count, {_CODES} as reasons, false as passed from n",
    "reconcile_report": f"{_RECS} select count(a.partition_key) as planned_count, count(b.partition_key) as stored_count, count_if(b.partition_key is null) as missing, count_if(a.partition_key is null) as extra, count_if(a.record_digest <> b.record_digest) as differing, count_if(b.record_digest <> b.actual) as corrupt, false as passed from rec a full join (select *, {_record_hash()} as actual from stored) b on a.partition_key = b.partition_key and a.sort_key = b.sort_key",
    "serving_outcomes": f"{_RECS}{_REQUESTS}{_SERVED} select request_id, customer_id, feature_name, status, case when status = 'FOUND' then coalesce(value_integer::double, value_decimal::double) end as value from served",
    "serving_from_buckets": f"{_RECS}{_REQUESTS}{_SERVED} select request_id, customer_id, feature_name, status, case when status = 'FOUND' then coalesce(value_integer::double, value_decimal::double) end as value from served",
    "pointer_history_audit": f"with{_EVENTS}{_HISTORY}, j as (select *, row_number() over w as i, lag(pointer_version) over w as pv, lag(to_generation) over w as pt, count(*) over (partition by operation_id) as ops from hist window w as (partition by feature_set order by pointer_version, activated_at, to_generation)), p as (select *, concat_ws(',', case when pointer_version <> coalesce(pv, 0) + 1 then 'VERSION_GAP' end, case when from_generation is distinct from pt then 'BROKEN_CHAIN' end, case when ops > 1 then 'OPERATION_REPEATED' end) as problems from j) select feature_set, pointer_version, to_generation, problems from p where problems <> ''",
    "active_generations": f"with{_EVENTS}{_HISTORY} select feature_set, to_generation as generation_id, pointer_version from hist qualify row_number() over (partition by feature_set order by pointer_version desc, activated_at desc, to_generation desc) = 1",
    "pinned_serving_history": f"with{_EVENTS}{_HISTORY}, spans as (select *, lead(activated_at) over (partition by feature_set order by pointer_version, activated_at, to_generation) as ends from hist) select v.event_id as request_id, 'set-' || v.user_id as feature_set, v.t as request_time, s.to_generation as generation_id from (select * from e where event_type = 'view') v left join spans s on s.feature_set = 'set-' || v.user_id and v.t >= s.activated_at and (s.ends is null or v.t < s.ends)",
    "transition_audit": f"with{_EVENTS}, s as (select user_id as g, t * 1000 + event_id % 1000 as moment, ['BUILDING', 'VALIDATING', 'READY', 'ACTIVE', 'RETIRED'][event_id % 5 + 1] as status from e), p as (select *, coalesce(lag(status) over (partition by g order by moment, status), 'CREATED') as previous from s) select previous, status, previous || '>' || status in ({', '.join(f"'{a}>{b}'" for a, b in OFFLINE_MOVES)}) as legal, count(*) as moves from p group by 1, 2, 3",
    "keyset_page": f"{_GEN2} select customer_id, feature_name, value_long, value_double from gen2 where (customer_id, feature_name) > (40, '{NAMES[2]}') order by 1, 2 limit 51",
    "clustered_page": f"{_GEN2} select customer_id, feature_name, value_long, value_double from gen2 where (customer_id, feature_name) > (40, '{NAMES[2]}') order by 1, 2 limit 51",
    "keyset_traversal": f"{_GEN2} select customer_id, feature_name, (row_number() over (order by customer_id, feature_name) - 1) // 7 as page from gen2",
    "gate_decisions": f"with{_EVENTS}{_GATED} select generation_id, operation_id, case when reasons = '' then 'ELIGIBLE' else 'REJECTED' end as status, reasons from gated",
    "publish_verdicts": f"with{_EVENTS}{_GATED} select generation_id, case when other_reasons = '' then 'ELIGIBLE' else 'QUARANTINED' end as verdict, other_reasons as reasons from gated",
    "diagnosis_rollup": f"{_RECS}{_REQUESTS}{_SERVED}{_GATED}{_DIAG}, sig as (select unnest(string_split(reasons, ',')) as signal from gated where reasons <> '' union all select status from served where status <> 'FOUND') select s.signal, count(*) as occurrences, d.layer, d.impact, d.action from sig s left join diag d using (signal) group by all",
    "lag_snapshot": f"with{_EVENTS}{_LAG} select event_id, violations, " + ", ".join(f"case when violations = '' then {x} end as {n}" for n, x in (("source_arrival_lag", "knowledge_time - event_time"), ("build_duration", "bc - bs"), ("materialization_duration", "mc - ms"), ("build_materialization_lag", "mc - f"), ("activation_lag", "aa - cv"), ("online_freshness_age", "rt - rf"), ("ttl_age", "rt - x"), ("end_to_end_availability_lag", "rt - event_time"))) + " from v",
    "telemetry_validation": f"with{_EVENTS} select case when event_id % 19 = 0 then 'unknown.event' else {_NAMES}[event_id % {len(TELEMETRY_EVENTS)} + 1] end as event, concat_ws(',', case when event_id % 19 = 0 or event_id % 37 = 0 then 'INVALID_IDENTITY' end, case when event_id % 23 = 0 then 'FORBIDDEN_LABEL' end, case when event_id % 31 = 0 then 'INCOMPLETE_TRACE' end, case when event_id % 29 = 0 then 'BAD_TEXT' end, case when event_id % 41 = 0 then 'NOT_FINITE' end) as violations, count(*) as events from e group by 1, 2",
    "trial_summary": f"with{_EVENTS}{_TRIALS} select g.case_id, g.operation, coalesce(warm_count, 0) as warm_count, cold_count, minimum_ns, median_ns, maximum_ns, warm_interquartile_range_ns, coefficient_of_variation, input_digests, output_digests, coalesce(warm_count, 0) >= 5 and cold_count >= 1 and bad = 0 as valid from g left join q on g.case_id = q.case_id and g.operation = q.operation",
    "capacity_report": f"""{_REC}, sized as (select partition_key, strlen('{{"partition_key":"' || partition_key || '","sort_key":"' || sort_key || '","feature_set":"' || feature_set || '","generation_id":"' || generation_id || '","customer_id":' || customer_id || ',"feature_name":"' || feature_name || '","expires_at":' || expires_at || ',"record_digest":"' || record_digest || '"}}') as n from rec), per as (select partition_key, count(*) as c from sized group by 1)
      select count(*) as item_count, max(n) as maximum_item_bytes, sum(n)::bigint as total_item_bytes, (select max(c) from per) as maximum_records_per_partition, (select count(*) from per) as partition_count, 409600 - max(n) as maximum_item_headroom_bytes from sized""",
    "write_unit_projection": f"""{_REC}, sized as (select 200 + 5 * 21 + strlen(feature_set) + strlen(generation_id) + strlen(feature_name) + strlen(definition_digest) + strlen(source_digest) + strlen(offline_rows_digest) + strlen(operation_id) + strlen(partition_key) + strlen(sort_key) + strlen(record_digest) + case value_kind when 'null' then 1 when 'integer' then 21 else strlen(value_decimal) end as n from rec)
      select count(*) as record_count, sum(n)::bigint as item_bytes, max(n) as maximum_item_bytes, sum(2 * ((n + 1023) // 1024))::bigint + count(*) * 2 as write_units, count(*) * 2 as condition_units from sized""",
    "partition_key_skew": f"{_WITH} select 'ENTITY#' || customer_id || '#GEN#g2' as partition_key, 5::bigint as records from spine",
    "hot_customers": f"{_WITH} select customer_id as key, count(*) as rows, count(*) / (select count(*) from rev) as fraction from rev group by 1 order by rows desc, key limit 10",
    "partition_skew": f"{_WITH}, p as (select count(*) as n from rev group by customer_id % 16) select sum(n)::bigint as rows, count(*) as partitions, max(n) as most_rows, max(n) / sum(n) as maximum_fraction from p",
    "strict_label_decode": f"""{_WITH}, every as (select * from lab union all select * from lab where label_id % 103 = 5)
      select case label_id % 101 when 1 then 'MALFORMED' when 2 then 'UNKNOWN_FIELD' when 3 then 'MISSING_FIELD' when 4 then 'WRONG_TYPE' when 5 then 'WRONG_TYPE' when 6 then 'MALFORMED' else case when label_id % 103 = 5 then 'DUPLICATE_LABEL' else '' end end as violations, count(*) as rows from every group by 1""",
    "scope_reasons": f"{_SCOPED} select 'revision-change:' || event_id as reason from chg union all select 'affected-scope-threshold' from ({_MODE} from seen_customers) where mode = 'full'",
    "predecessor_checks": f"{_WITH} select count_if(customer_id % 10 = 3) as missing, 5 * count_if(customer_id % 10 = 6) as extra, count_if(customer_id % 10 = 4) as repeated, 5 * count_if(customer_id % 10 = 5) as wrong_frontier from spine",
    "spine_checks": f"with{_EVENTS}, n as (select case when event_id % 500 = 0 then '' else user_id::varchar end as c, count(*) as n from e group by 1) select sum(n)::bigint as rows, coalesce(sum(case when c = '' then n end), 0)::bigint as empty_ids, count_if(n > 1) as repeated_ids from n",
    "stream_upserts": f"{_GEN12}, a as ({_KEYED} gen1 where customer_id % 4 <> 0), b as ({_KEYED} gen2), j as (select a.digest as old, b.digest as new from b left join a on a.partition_key = b.partition_key and a.sort_key = b.sort_key) select 'stored' as sink, (select count(*) from a) + count_if(old is null) as rows from j union all select 'conflicts', count_if(old <> new) from j",
    "resumed_write": f"{_GEN2} select count(*) as planned_count, count(*) as stored_count, 0::bigint as missing, 0::bigint as extra, 0::bigint as differing, 0::bigint as corrupt, true as passed from gen2",
    "candidate_receipts": f"""{_GEN2}, c as (select 'g' || customer_id % 6 as generation_id, count(*) as n from gen2 group by 1)
      select generation_id, n as actual_count, n as expected_count, generation_id <> 'g3' as artifact_links_valid, generation_id <> 'g2' as candidate_matches_manifest, generation_id not in ('g1', 'g2', 'g3') as matched, case when generation_id in ('g1', 'g2', 'g3') then 'FAILED' else 'READY' end as next_status from c""",
    "injected_corrections": f"{_WITH} select * from rev union all select event_id, revision_id || '-c', customer_id, event_time, knowledge_time + 7200, operation, amount_cents + 100, status, merchant_risk from rev where operation = 'upsert' and ('0x' || substr(md5(event_id::varchar), 1, 7))::bigint % 100 < 25",
    "json_revision_scan": f"{_WITH} select * replace (event_id::varchar as event_id, customer_id::varchar as customer_id) from rev",
    "generation_scan": f"{_WITH}{_state(FIRST, 'st1')}{_gen('st1', FIRST, 'gen1', 'g1')} select customer_id, feature_name, value_long, value_double, generation_id from gen1",
    "generation_round_trip": f"{_GEN2} select {_digest('h')}, 'written' as first, 'replayed' as second from (select {_VALUE_HASH} as h from gen2)",
    "dataset_binding": f"{_WITH} select (select count(*) from lab) as row_count, (select rows_digest from (select {_digest('h')} from (select {_REV_HASH} as h from rev))) as source_digest, (select rows_digest from (select {_digest('h')} from (select {_hash(label_id='label_id::varchar', customer_id='customer_id::varchar', label_time='label_time::varchar', prediction_knowledge_time='prediction_knowledge_time::varchar', value='value::varchar')} as h from lab))) as label_digest, '{definition_set_digest(FEATURES)}' as definition_set_digest",
    "build_job": f"{_GEN2} select customer_id::varchar as customer_id, feature_name, value_long, value_double, generation_id from gen2",
    "definition_usage": f"{_GEN2} select identity, place, '{definition_set_digest(FEATURES)}' as definition_set_digest, count(*) as rows, 0::bigint as of_other_type from gen2 join (values {', '.join(f"('{d.digest}', '{d.identity}', {i})" for i, d in enumerate(sorted(FEATURES, key=lambda d: d.identity)))}) v(definition_digest, identity, place) using (definition_digest) group by identity, place",
    "missing_links": f"{_WITH} select customer_id, sha256(max(revision_id)) as source_digest from rev group by 1 having customer_id % 6 = 0",
    "stream_arrival_lag": f"{_WITH}, sl as (select *, min(knowledge_time) over () as low, (max(knowledge_time) over () - min(knowledge_time) over ()) // 4 + 1 as step from rev), fed as (select knowledge_time, event_time, customer_id from sl union all select knowledge_time, event_time, customer_id from base where event_id % 50 = 0 union all select knowledge_time, event_time, customer_id from base where event_id % 60 = 1) select knowledge_time // 86400 * 86400 as window_start, 'feed-' || (customer_id % 3) as source, quantile_disc(knowledge_time - event_time, 0.5) as p50_lag, quantile_disc(knowledge_time - event_time, 0.95) as p95_lag, quantile_disc(knowledge_time - event_time, 0.99) as p99_lag, count(*) as revisions, min(knowledge_time - event_time) as minimum_lag, max(knowledge_time - event_time) as maximum_lag, sum(knowledge_time - event_time)::bigint as total_lag from fed group by 1, 2",
    "stream_ingest_revisions": f"{_WITH}, dup as (select count(*) as n from base where event_id % 60 = 1) select 'appended' as outcome, count(*) as rows from rev union all select 'conflict', n from dup",
    "stream_incremental_generation": f"{_GEN_LAST} select * exclude (generation_id) from genl",
    "stream_telemetry": f"with{_EVENTS}, x as (select event_id % 19 = 0 or event_id % 37 = 0 or event_id % 23 = 0 or event_id % 31 = 0 or event_id % 29 = 0 or event_id % 41 = 0 as bad from e) select case when bad then 'quarantine' else 'valid' end as sink, count(*) as events from x group by 1",
}
for _name, _d in zip(("feature_txn_count_24h", "feature_success_spend_30d", "feature_failed_ratio_7d", "feature_hours_since_success", "feature_max_risk_7d"), FEATURES, strict=True):
    SQL[_name] = f"{_GEN2} select customer_id, {'value_long' if _d.value_type == 'integer' else 'value_double'} as value from gen2 where feature_name = '{_d.name}'"
