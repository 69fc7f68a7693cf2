"""Exhaustive comparison of expected and actual rows, samples, and summaries of differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import digest_of, reasons
from tidemark.operators.online import eligibility

#: The fields by which records mean the same; all others are envelope.
SEMANTIC = ("value", "definition_digest", "event_cutoff", "knowledge_cutoff", "generation_id", "source_digest", "expires_at")


def value_parity(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("customer_id", "feature_name")) -> DataFrame:
    """``keys`` and ``difference`` (MISSING, EXTRA, MISMATCH) of rows that aren't the same in both tables."""
    fields = [c for c in expected.columns if c not in keys]
    a = expected.select(*keys, F.struct(*fields).alias("_a"))
    b = actual.select(*keys, F.struct(*fields).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    kind = F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "EXTRA").when(~F.col("_a").eqNullSafe(F.col("_b")), "MISMATCH")
    return both.select(*keys, kind.alias("difference")).where("difference is not null")


def compared_records(expected: DataFrame, actual: DataFrame, sample: DataFrame | None = None, request_time: int | None = None, maximum_age: int | None = None) -> DataFrame:
    """One row per key with ``missing, extra, semantic_fields, envelope_differs, ineligible``."""
    keys = ["customer_id", "feature_name"]
    side = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    both = side(expected, "e").join(side(actual, "a"), keys, "full_outer")
    if sample is not None:
        both = both.join(sample.select(*keys).distinct(), keys, "left_semi")
    present = F.col("e").isNotNull() & F.col("a").isNotNull()
    fields = reasons(*[(present & ~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), c) for c in SEMANTIC])
    out = both.select(*keys, "e", "a", F.col("a").isNull().alias("missing"), F.col("e").isNull().alias("extra"), fields.alias("semantic_fields"), (present & ~F.col("e").eqNullSafe(F.col("a"))).alias("envelope_differs"))
    why = F.lit(None).cast("string")
    if request_time is not None:
        age = None if maximum_age is None else F.lit(maximum_age)
        held = out.withColumns({"expires_at": F.col("a.expires_at"), "knowledge_cutoff": F.col("a.knowledge_cutoff")})
        return held.select(*keys, "missing", "extra", "semantic_fields", "envelope_differs", F.when(~F.col("missing") & ~F.col("extra"), eligibility(F.lit(request_time), age)).alias("ineligible"))
    return out.select(*keys, "missing", "extra", "semantic_fields", "envelope_differs", why.alias("ineligible"))


def parity_summary(expected: DataFrame, actual: DataFrame, **options) -> DataFrame:
    """One row: counts, ordered ``reasons``, both sides' digests, ``passed``. Digests cover all rows, sampled or not."""
    rows = compared_records(expected, actual, **options)
    n = rows.agg(
        F.count("*").alias("compared_count"), F.count_if("missing").alias("missing_count"), F.count_if("extra").alias("extra_count"),
        F.count_if(F.size("semantic_fields") > 0).alias("semantic_mismatch_count"), F.count_if("envelope_differs").alias("envelope_mismatch_count"), F.count_if(F.col("ineligible").isNotNull()).alias("ineligible_count"),
    )

    def whole(df: DataFrame, name: str) -> DataFrame:
        count, digest = digest_of("record_digest")
        return df.agg(count.alias(f"{name}_count"), digest.alias(f"{name}_digest"))

    out = n.join(F.broadcast(whole(expected, "expected"))).join(F.broadcast(whole(actual, "actual")))
    codes = reasons(
        (F.col("missing_count") > 0, "MISSING_RECORD"),
        (F.col("extra_count") > 0, "EXTRA_RECORD"),
        (F.col("semantic_mismatch_count") > 0, "SEMANTIC_MISMATCH"),
        (F.col("envelope_mismatch_count") > 0, "ENVELOPE_MISMATCH"),
        (F.col("ineligible_count") > 0, "INELIGIBLE_RECORD"),
        (F.col("expected_digest") != F.col("actual_digest"), "AGGREGATE_MISMATCH"),
    )
    return out.withColumn("reasons", codes).withColumn("passed", F.size("reasons") == 0)


def stratified_sample(records: DataFrame, strata: DataFrame, seed: int, per_stratum: int) -> DataFrame:
    """``stratum, customer_id, feature_name``: in each stratum the keys with the smallest seeded hashes."""
    if per_stratum < 1:
        raise ValueError("a stratum's sample must have at least one key")
    keys = records.select("customer_id", "feature_name").distinct().join(strata.select("customer_id", "stratum"), "customer_id", "left")
    keys = keys.withColumn("stratum", F.coalesce("stratum", F.lit("ordinary")))
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), "stratum", F.col("customer_id").cast("string"), "feature_name"), 256)
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(order))
    return keys.withColumn("_r", rank).where(F.col("_r") <= per_stratum).select("stratum", "customer_id", "feature_name")


def key_sets(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: sizes of intersection, union and both differences of the key sets, and whether actual is a subset."""
    keys = ["customer_id", "feature_name"]
    both = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).join(actual.select(*keys).distinct().withColumn("_a", F.lit(1)), keys, "full_outer")
    out = both.agg(F.count_if(F.col("_e").isNotNull() & F.col("_a").isNotNull()).alias("common"), F.count("*").alias("either"), F.count_if(F.col("_a").isNull()).alias("only_expected"), F.count_if(F.col("_e").isNull()).alias("only_actual"))
    return out.withColumn("actual_is_subset", F.col("only_actual") == 0)
