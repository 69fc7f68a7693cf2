"""Table functions for ``spark.sql``: the state at a time, features at a frontier, training sets.

They are SQL functions over views of revisions, labels and customers, so Catalyst inlines them: their arguments reach the
scans, and joins and aggregates around them are planned as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.definitions import COMPUTATIONS, FeatureDefinition, check_definitions, widest_window
from tidemark.schemas import LABEL_FIELDS, REVISION_FIELDS


def _typed(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def _value(d: FeatureDefinition, anchor: str) -> str:
    """A definition's value as an SQL aggregate over events."""
    text = COMPUTATIONS[d.computation].sql
    if text is None:
        raise ValueError(f"{d.computation} was registered without SQL")
    low = "true" if d.window_seconds is None else f"event_time > {anchor} - {d.window_seconds}"
    raw = text.format(inside=f"(event_time <= {anchor} and {low})", anchor=anchor)
    kind = "bigint" if d.value_type == "integer" else "double"
    return f"cast({raw} as {kind})" if d.default is None else f"coalesce(cast({raw} as {kind}), cast({d.default} as {kind}))"


def register_functions(spark: SparkSession, revisions: DataFrame, spine: DataFrame, labels: DataFrame, definitions: Sequence[FeatureDefinition], prefix: str = "") -> None:
    """Temporary table functions ``state_at(frontier)``, ``standing_at(cutoff, frontier)``, ``features_at(cutoff, frontier)``
    and ``training_set(as_of)``, each with ``prefix`` before its name, over views of the tables given.

    Definitions' computations must have been registered with SQL.
    """
    check_definitions(definitions)
    names = {n: f"{prefix}{n}" for n in ("state_at", "standing_at", "features_at", "training_set")}
    views = {n: f"{prefix}tidemark_{n}" for n in ("revisions", "spine", "labels")}
    revisions.select(*REVISION_FIELDS).createOrReplaceTempView(views["revisions"])
    spine.select("customer_id").createOrReplaceTempView(views["spine"])
    labels.select(*LABEL_FIELDS).createOrReplaceTempView(views["labels"])
    fields, row = ", ".join(REVISION_FIELDS), _typed(revisions, REVISION_FIELDS)
    who = f"customer_id {dict(spine.dtypes)['customer_id']}"
    told = ", ".join(f"{d.name} {'bigint' if d.value_type == 'integer' else 'double'}" for d in definitions)
    shown = ", ".join(d.name for d in definitions)
    widest = widest_window(definitions)
    recent = lambda at: "" if widest is None else f" and event_time > {at} - {widest}"
    ended = "lead(knowledge_time) over (partition by event_id order by knowledge_time, revision_id)"
    intervals = f"select {fields}, {ended} as known_to from {views['revisions']}"
    function = lambda name, arguments, result, body: spark.sql(f"create or replace temporary function {names[name]}({arguments}) returns table ({result}) return {body}")
    function("state_at", "frontier bigint", row, f"select {fields} from (select {fields}, {ended} as known_to from {views['revisions']} where knowledge_time <= {names['state_at']}.frontier) where known_to is null")
    function("standing_at", "cutoff bigint, frontier bigint", row, f"select {fields} from {names['state_at']}({names['standing_at']}.frontier) where operation = 'upsert' and event_time <= {names['standing_at']}.cutoff")
    f = names["features_at"]
    found = f"select e.customer_id, {', '.join(_value(d, 'a') + f' as {d.name}' for d in definitions)} from (select *, {f}.cutoff as a from {names['standing_at']}({f}.cutoff, {f}.frontier) where true{recent(f'{f}.cutoff')}) e group by e.customer_id, a"
    filled = lambda d: d.name if d.default is None else f"coalesce(x.{d.name}, {d.default})"
    function("features_at", "cutoff bigint, frontier bigint", f"{who}, {told}", f"select s.customer_id, {', '.join(filled(d) for d in definitions)} from {views['spine']} s left join ({found}) x on s.customer_id = x.customer_id")
    t, own = names["training_set"], ", ".join(LABEL_FIELDS)
    cut = f"select {own}, least(coalesce(prediction_knowledge_time, label_time), {t}.as_of) as effective_cutoff from {views['labels']}"
    joined = f"select l.label_id, l.label_time as a, e.* except (customer_id) from ({cut}) l join ({intervals}) e on l.customer_id = e.customer_id and e.operation = 'upsert' and e.event_time <= l.label_time{recent('l.label_time')} and e.knowledge_time <= l.effective_cutoff and (e.known_to is null or e.known_to > l.effective_cutoff)"
    found = f"select label_id, {', '.join(_value(d, 'a') + f' as {d.name}' for d in definitions)} from ({joined}) group by label_id, a"
    function("training_set", "as_of bigint", f"{_typed(labels, LABEL_FIELDS)}, effective_cutoff bigint, {told}", f"select {', '.join('c.' + x for x in LABEL_FIELDS)}, c.effective_cutoff, {', '.join(filled(d) for d in definitions)} from ({cut}) c left join ({found}) x on c.label_id = x.label_id")
