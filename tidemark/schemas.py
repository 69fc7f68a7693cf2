"""Fixed schemas of the library's tables. Times are integer epoch seconds; ids may be strings or integers."""

from __future__ import annotations

REVISION_FIELDS = ("event_id", "revision_id", "customer_id", "event_time", "knowledge_time", "operation", "amount_cents", "status", "merchant_risk")
REVISIONS = "event_id string, revision_id string, customer_id string, event_time bigint, knowledge_time bigint, operation string, amount_cents bigint, status string, merchant_risk double"
REVISIONS_V1 = "event_id string, customer_id string, event_time bigint, knowledge_time bigint, amount_cents bigint, status string, merchant_risk double"
LABEL_FIELDS = ("label_id", "customer_id", "label_time", "prediction_knowledge_time", "value")
LABELS = "label_id string, customer_id string, label_time bigint, prediction_knowledge_time bigint, value bigint"
FEATURE_VALUES = "customer_id string, feature_name string, value_long bigint, value_double double, event_time bigint, knowledge_time bigint, definition_digest string, generation_id string"

# Fixed values of the data model.
OPERATIONS = ("upsert", "retract")
STATUSES = ("succeeded", "failed")
