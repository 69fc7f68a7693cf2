"""Feature definitions and the registry of computations, which is how users add features."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400


@dataclass(frozen=True)
class Part:
    """A mergeable part of a computation: ``value`` of one event, and whether values are summed or the largest counts."""

    value: Callable[[], Column]
    merge: Callable[[Column], Column]

    def over_rows(self, which: Column) -> Column:
        return self.merge(F.when(which, self.value()))

    def merged(self, name: str, which: Column) -> Column:
        return self.merge(F.when(which, F.col(name)))


@dataclass(frozen=True)
class Computation:
    """``raw``: an aggregate over the events of a window, null where it has none; ``fixed_default`` beats a definition's.

    ``parts`` and ``final`` say the same in parts that can be made for stretches of time and merged: ``final`` gets the
    merged parts by name and the anchor time. Parts of one name are the same in all computations. ``sql``: the raw
    aggregate as SQL text with ``{inside}`` and ``{anchor}``.
    """

    value_type: str
    raw: Callable[[Column, Column], Column]  # (event is in the window, anchor time)
    fixed_default: float | None = None
    parts: Mapping[str, Part] = field(default_factory=dict)
    final: Callable[[Mapping[str, Column], Column], Column] | None = None
    sql: str | None = None


COMPUTATIONS: dict[str, Computation] = {}


def register(name: str, value_type: str, raw: Callable[[Column, Column], Column], fixed_default: float | None = None, parts: Mapping[str, Part] | None = None, final: Callable[[Mapping[str, Column], Column], Column] | None = None, sql: str | None = None) -> None:
    if value_type not in ("integer", "float"):
        raise ValueError(f"{name}: value type {value_type!r} is neither integer nor float")
    if bool(parts) != (final is not None):
        raise ValueError(f"{name}: parts and what is made of them go together")
    COMPUTATIONS[name] = Computation(value_type, raw, fixed_default, parts or {}, final, sql)


def _succeeded(inside: Column) -> Column:
    return inside & (F.col("status") == "succeeded")


def _ratio(inside: Column, anchor: Column) -> Column:
    n = F.count_if(inside)
    return F.when(n > 0, F.count_if(inside & (F.col("status") == "failed")).cast("double") / n)


_COUNT = Part(lambda: F.lit(1).cast("bigint"), F.sum)
_FAILED = Part(lambda: F.when(F.col("status") == "failed", 1).otherwise(0).cast("bigint"), F.sum)
_SPENT = Part(lambda: F.when(F.col("status") == "succeeded", F.col("amount_cents")), F.sum)
_SUCCESS = Part(lambda: F.when(F.col("status") == "succeeded", F.col("event_time")), F.max)
_RISK = Part(lambda: F.col("merchant_risk"), F.max)

register(
    "transaction_count", "integer", lambda inside, anchor: F.count_if(inside), fixed_default=0,
    parts={"count": _COUNT}, final=lambda x, anchor: F.coalesce(x["count"], F.lit(0)), sql="count_if({inside})",
)
register(
    "successful_spend_cents", "integer", lambda inside, anchor: F.sum(F.when(_succeeded(inside), F.col("amount_cents"))),
    parts={"spent": _SPENT}, final=lambda x, anchor: x["spent"], sql="sum(case when {inside} and status = 'succeeded' then amount_cents end)",
)
register(
    "failed_payment_ratio", "float", _ratio, parts={"count": _COUNT, "failed": _FAILED}, final=lambda x, anchor: F.when(x["count"] > 0, x["failed"].cast("double") / x["count"]),
    sql="case when count_if({inside}) > 0 then cast(count_if({inside} and status = 'failed') as double) / count_if({inside}) end",
)
register(
    "hours_since_success", "float", lambda inside, anchor: (anchor - F.max(F.when(_succeeded(inside), F.col("event_time")))).cast("double") / 3600,
    parts={"success": _SUCCESS}, final=lambda x, anchor: (anchor - x["success"]).cast("double") / 3600, sql="cast({anchor} - max(case when {inside} and status = 'succeeded' then event_time end) as double) / 3600",
)
register(
    "max_merchant_risk", "float", lambda inside, anchor: F.max(F.when(inside, F.col("merchant_risk"))),
    parts={"risk": _RISK}, final=lambda x, anchor: x["risk"], sql="max(case when {inside} then merchant_risk end)",
)


@dataclass(frozen=True)
class FeatureDefinition:
    name: str
    version: int
    value_type: str
    ttl_seconds: int
    computation: str
    window_seconds: int | None
    description: str
    empty_default: float | None = None

    @property
    def identity(self) -> str:
        return f"{self.name}:v{self.version}"

    @property
    def digest(self) -> str:
        """SHA-256 over all fields, in order of their names."""
        shown = "\x1f".join(f"{f.name}={getattr(self, f.name)}" for f in sorted(fields(self), key=lambda f: f.name))
        return hashlib.sha256(shown.encode()).hexdigest()

    @property
    def default(self) -> float | None:
        fixed = COMPUTATIONS[self.computation].fixed_default
        return self.empty_default if fixed is None else fixed

    def in_window(self, anchor: Column) -> Column:
        """The trailing window, open left and closed right; no window is unbounded."""
        upper = F.col("event_time") <= anchor
        return upper if self.window_seconds is None else upper & (F.col("event_time") > anchor - self.window_seconds)

    def raw(self, anchor: Column) -> Column:
        return COMPUTATIONS[self.computation].raw(self.in_window(anchor), anchor)


def check_definitions(definitions: Sequence[FeatureDefinition]) -> None:
    """A build's definitions: one at least, unique names and identities, known computations, agreeing types."""
    if not definitions:
        raise ValueError("a build needs at least one feature definition")
    for what in ("name", "identity"):
        values = [getattr(d, what) for d in definitions]
        if len(set(values)) < len(values):
            raise ValueError(f"feature definitions repeat a {what}")
    for d in definitions:
        if not d.name or d.version < 1 or d.ttl_seconds <= 0 or (d.window_seconds is not None and d.window_seconds <= 0):
            raise ValueError(f"{d.identity}: names, versions, windows and times to live must be positive")
        if d.computation not in COMPUTATIONS:
            raise ValueError(f"{d.identity}: unknown computation {d.computation!r}")
        if COMPUTATIONS[d.computation].value_type != d.value_type:
            raise ValueError(f"{d.identity}: {d.computation} gives {COMPUTATIONS[d.computation].value_type}, not {d.value_type}")
        if d.value_type == "integer" and d.empty_default is not None and d.empty_default != int(d.empty_default):
            raise ValueError(f"{d.identity}: the default of an integer feature must be an integer")


def parts_of(definitions: Sequence[FeatureDefinition]) -> dict[str, Part]:
    """The parts of the definitions' computations by name, each once."""
    whole = [d.computation for d in definitions if not COMPUTATIONS[d.computation].parts]
    if whole:
        raise ValueError(f"these computations don't come in parts: {', '.join(sorted(set(whole)))}")
    return {name: part for d in definitions for name, part in COMPUTATIONS[d.computation].parts.items()}


def widest_window(definitions: Sequence[FeatureDefinition]) -> int | None:
    """Seconds of the widest window; None if one is unbounded."""
    windows = [d.window_seconds for d in definitions]
    return None if None in windows else max(windows)


def definitions_frame(spark: SparkSession, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    """One row per definition, a few rows by nature."""
    rows = [(d.name, d.version, d.value_type, d.ttl_seconds, d.computation, d.window_seconds, d.description, None if d.empty_default is None else float(d.empty_default), d.digest, d.identity) for d in definitions]
    return spark.createDataFrame(rows, "feature_name string, version int, value_type string, ttl_seconds bigint, computation string, window_seconds bigint, description string, empty_default double, definition_digest string, identity string")


def definition_set_digest(definitions: Sequence[FeatureDefinition]) -> str:
    """SHA-256 over the digests of a build's definitions, ordered by identity; repeated identities raise."""
    check_definitions(definitions)
    return hashlib.sha256("\n".join(f"{d.identity}={d.digest}" for d in sorted(definitions, key=lambda d: d.identity)).encode()).hexdigest()


def definition_set(spark: SparkSession, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    """The set as a table for ``sources.generations.write_once``: ``definitions_frame`` with its place and the set's digest."""
    whole = definition_set_digest(definitions)
    order = {d.identity: i for i, d in enumerate(sorted(definitions, key=lambda d: d.identity))}
    places = spark.createDataFrame(list(order.items()), "identity string, place int")
    return definitions_frame(spark, definitions).join(F.broadcast(places), "identity").withColumn("definition_set_digest", F.lit(whole))


# Names, windows, lifetimes and defaults of the five features.
def payment_features() -> list[FeatureDefinition]:
    """The five features of the payment-risk example."""
    return [
        FeatureDefinition("transaction_count_24h", 1, "integer", 2 * DAY, "transaction_count", DAY, "Transactions of the last 24 hours.", 0),
        FeatureDefinition("successful_spend_30d_cents", 1, "integer", 31 * DAY, "successful_spend_cents", 30 * DAY, "Successful payments of the last 30 days, in cents.", 0),
        FeatureDefinition("failed_payment_ratio_7d", 1, "float", 8 * DAY, "failed_payment_ratio", 7 * DAY, "Share of failed payments of the last seven days.", 0.0),
        FeatureDefinition("hours_since_successful_payment", 1, "float", 31 * DAY, "hours_since_success", 30 * DAY, "Hours since the latest successful payment.", None),
        FeatureDefinition("max_merchant_risk_7d", 1, "float", 8 * DAY, "max_merchant_risk", 7 * DAY, "Largest merchant risk of the last seven days.", None),
    ]
