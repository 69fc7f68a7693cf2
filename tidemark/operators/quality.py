"""Strict decoding, violations, conflicts and rejection: what a batch must meet before it counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.definitions import FeatureDefinition, definitions_frame
from tidemark.functions.values import finite, reasons, row_digest
from tidemark.schemas import LABEL_FIELDS, LABELS, OPERATIONS, REVISION_FIELDS, REVISIONS, STATUSES


def upgraded(legacy: DataFrame) -> DataFrame:
    """Version-1 revisions with ``revision_id`` (event and knowledge time) and ``operation`` filled in."""
    has = set(legacy.columns)
    derived = F.concat_ws("@", F.col("event_id").cast("string"), F.col("knowledge_time").cast("string"))
    revision = F.coalesce(F.col("revision_id"), derived) if "revision_id" in has else derived
    operation = F.coalesce(F.col("operation"), F.lit("upsert")) if "operation" in has else F.lit("upsert")
    return legacy.withColumns({"revision_id": revision, "operation": operation}).select(*REVISION_FIELDS)


#: What a JSON value of a column's type looks like as a variant.
_KINDS = {"string": "STRING|VOID", "bigint": "BIGINT|VOID", "double": r"BIGINT|DOUBLE|DECIMAL\(.*\)|VOID"}


def _strict(raw: DataFrame, column: str, schema: str, fields: Sequence[str]) -> DataFrame:
    """JSON texts as rows of ``schema`` with ``_first``: what keeps a text from being exactly that.

    An object that repeats a field is malformed, as are texts that aren't objects.
    """
    kinds = dict(f.split() for f in schema.split(", "))
    table = raw.select(column, F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("_r"), F.map_keys(F.from_json(column, "map<string,string>")).alias("_keys"), F.try_parse_json(column).alias("_v"))
    known = F.array(*[F.lit(n) for n in fields])
    wrong = F.lit(False)
    for n in fields:
        kind = F.schema_of_variant(F.variant_get("_v", f"$.{n}", "variant"))
        wrong = wrong | F.coalesce(~kind.rlike(f"^({_KINDS[kinds[n]]})$"), F.lit(False))
    first = reasons(
        (F.col("_keys").isNull() | F.col("_v").isNull(), "MALFORMED"),
        (F.size(F.array_except("_keys", known)) > 0, "UNKNOWN_FIELD"),
        (F.size(F.array_except(known, F.col("_keys"))) > 0, "MISSING_FIELD"),
        (wrong, "WRONG_TYPE"),
    )
    return table.select(column, "_r.*", first.alias("_first"))


def decoded_revisions(raw: DataFrame, column: str = "raw") -> DataFrame:
    """JSON texts as revisions with a ``violations`` array; fields beyond the schema, or of other types, are violations."""
    table = _strict(raw, column, REVISIONS, REVISION_FIELDS)
    return table.withColumn("violations", F.when(F.size("_first") > 0, F.col("_first")).otherwise(_revision_rules())).drop("_first")


def _revision_rules():
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    payload = F.col("amount_cents").isNotNull() | F.col("status").isNotNull() | F.col("merchant_risk").isNotNull()
    retract, upsert = F.col("operation") == "retract", F.col("operation") == "upsert"
    return reasons(
        (blank("event_id"), "EMPTY_EVENT_ID"),
        (blank("customer_id"), "EMPTY_CUSTOMER_ID"),
        (blank("revision_id"), "EMPTY_REVISION_ID"),
        (F.coalesce(F.col("event_time") < 0, F.lit(True)), "BAD_EVENT_TIME"),
        (F.coalesce(F.col("knowledge_time") < 0, F.lit(True)), "BAD_KNOWLEDGE_TIME"),
        (F.col("knowledge_time") < F.col("event_time"), "KNOWN_BEFORE_EVENT"),
        (~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), "UNKNOWN_OPERATION"),
        (retract & payload, "RETRACT_WITH_PAYLOAD"),
        (upsert & F.coalesce(F.col("amount_cents") < 0, F.lit(True)), "BAD_AMOUNT"),
        (upsert & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "UNKNOWN_STATUS"),
        (upsert & ~F.coalesce(finite(F.col("merchant_risk")) & F.col("merchant_risk").between(0, 1), F.lit(False)), "BAD_RISK"),
    )


def revision_violations(revisions: DataFrame) -> DataFrame:
    """``revisions`` with a ``violations`` array of codes, empty where a row is sound."""
    return revisions.withColumn("violations", _revision_rules())


def decoded_labels(raw: DataFrame, column: str = "raw") -> DataFrame:
    """JSON texts as labels with ``violations``: fields and types are exact, and no label_id stands twice.

    A prediction cutoff of null defaults to the label's time.
    """
    table = _strict(raw, column, LABELS, LABEL_FIELDS).withColumn("prediction_knowledge_time", F.coalesce("prediction_knowledge_time", "label_time"))
    # ids of sound rows are grouped; rows that aren't sound have none, and meet nowhere
    repeated = table.where("size(_first) = 0 and label_id is not null").groupBy("label_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("label_id").alias("_id"), F.lit(True).alias("_twice"))
    spread = F.coalesce("label_id", F.concat(F.lit("\x00"), F.md5(column)))  # null ids go everywhere, not to one task
    table = table.withColumn("_id", spread).join(repeated, "_id", "left").drop("_id")
    twice = (F.size("_first") == 0) & F.coalesce("_twice", F.lit(False))
    rules = F.concat(_label_rules(), reasons((twice, "DUPLICATE_LABEL")))
    return table.withColumn("violations", F.when(F.size("_first") > 0, F.col("_first")).otherwise(rules)).select(column, *LABEL_FIELDS, "violations")


def _label_rules():
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return reasons(
        (blank("label_id"), "EMPTY_LABEL_ID"),
        (blank("customer_id"), "EMPTY_CUSTOMER_ID"),
        (F.coalesce(F.col("label_time") < 0, F.lit(True)), "BAD_LABEL_TIME"),
        (F.coalesce(F.col("prediction_knowledge_time") < 0, F.lit(False)), "BAD_CUTOFF"),
        (F.col("prediction_knowledge_time") > F.col("label_time"), "CUTOFF_AFTER_LABEL"),
        (F.col("value").isNull(), "NO_VALUE"),
    )


def label_violations(labels: DataFrame) -> DataFrame:
    """``labels`` with a ``violations`` array of codes, empty where a row is sound."""
    return labels.withColumn("violations", _label_rules())


def duplicate_labels(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label_id").agg(F.count("*").alias("rows")).where("rows > 1")


def deduplicated(revisions: DataFrame) -> DataFrame:
    """Exact replays dropped."""
    return revisions.dropDuplicates(list(revisions.columns))


def conflicts(revisions: DataFrame) -> DataFrame:
    """``conflict, key, variants``: reused revision ids, two revisions of an event at one time, changed customers.

    Exact replays are none. All three come from groupings with partial aggregates; no revision is collected.
    """
    clean = deduplicated(revisions)
    hashed = clean.withColumn("_hash", row_digest(clean))
    reused = hashed.groupBy("revision_id").agg(F.count_distinct("_hash").alias("variants")).where("variants > 1").select(F.lit("REVISION_REUSED").alias("conflict"), F.col("revision_id").cast("string").alias("key"), "variants")
    clock = clean.groupBy("event_id", "knowledge_time").agg(F.count_distinct("revision_id").alias("variants")).where("variants > 1").select(F.lit("SAME_CLOCK").alias("conflict"), F.concat_ws("@", F.col("event_id").cast("string"), F.col("knowledge_time").cast("string")).alias("key"), "variants")
    drift = clean.groupBy("event_id").agg(F.count_distinct("customer_id").alias("variants")).where("variants > 1").select(F.lit("CUSTOMER_CHANGED").alias("conflict"), F.col("event_id").cast("string").alias("key"), "variants")
    return reused.unionByName(clock).unionByName(drift)


def definition_conflicts(definitions: DataFrame) -> DataFrame:
    """``conflict, key, variants`` over ``identity, definition_digest`` rows."""
    reused = definitions.groupBy("identity").agg(F.count_distinct("definition_digest").alias("variants")).where("variants > 1").select(F.lit("IDENTITY_REUSED").alias("conflict"), F.col("identity").alias("key"), "variants")
    shared = definitions.groupBy("definition_digest").agg(F.count_distinct("identity").alias("variants")).where("variants > 1").select(F.lit("DIGEST_SHARED").alias("conflict"), F.col("definition_digest").alias("key"), "variants")
    return reused.unionByName(shared)


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a table with ``violations``."""
    return checked.where("size(violations) = 0").drop("violations"), checked.where("size(violations) > 0")


def rejection_report(checked: DataFrame) -> DataFrame:
    """One row: ``total_rows, rejected_rows, verdict, codes``; one bad row rejects the batch."""
    bad = F.size("violations") > 0
    codes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("violations"))))
    return checked.agg(F.count("*").alias("total_rows"), F.count_if(bad).alias("rejected_rows"), F.when(F.count_if(bad) > 0, "REJECTED").otherwise("ACCEPTED").alias("verdict"), codes.alias("codes"))


def assert_clean(revisions: DataFrame) -> None:
    """Raise if a revision breaks a rule or contradicts another: an explicit job before anything is published."""
    bad = revision_violations(revisions).agg(F.count_if(F.size("violations") > 0)).first()[0]
    if bad:
        raise ValueError(f"{bad} revisions break the rules")
    found = conflicts(revisions).groupBy("conflict").count().collect()
    if found:
        raise ValueError("conflicting revisions: " + ", ".join(f"{r['count']} {r['conflict']}" for r in sorted(found)))


def spine_violations(spine: DataFrame) -> DataFrame:
    """One row: ``rows, empty_ids, repeated_ids`` of a build's customers."""
    empty = F.col("customer_id").isNull() | (F.trim(F.col("customer_id").cast("string")) == "")
    return spine.groupBy("customer_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("empty_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"))


def assert_spine(spine: DataFrame) -> None:
    """Raise if a build's customers aren't unique and named."""
    found = spine_violations(spine).first()
    if found.empty_ids or found.repeated_ids:
        raise ValueError(f"a build's customers must be unique and not empty: {found.empty_ids} empty, {found.repeated_ids} repeated")


def check_definition_rows(spark, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    return definition_conflicts(definitions_frame(spark, definitions))
