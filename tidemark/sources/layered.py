"""Generations stored as what differs from the one before: a refresh writes the customers it touched and nothing else.

A table's layer holds all rows of the customers that were recomputed; all other customers' rows are those of its base,
which may be a layer itself. What every row of a generation shares (its frontier and its id) is bound in the manifest and
set as rows are read. The manifest binds the base's manifest, so a chain can't change below a layer, and each layer has its own digest tree.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.generations import Damaged, damaged_buckets, manifest_of, stored_rows, write_once
from tidemark.sources.shared import size_of

#: The layers a chain has at most, and the share of the first table that they reach, before all are written as one.
LAYERS, SHARE = 8, 0.5
KEY = "customer_id"


def manifest_digest(manifest: Mapping) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, default=str).encode()).hexdigest()


def chain(spark: SparkSession, root: str, table_id: str) -> list[tuple[str, dict]]:
    """(id, manifest) from the table down to the whole one it rests on; raises where a base isn't the one that was bound."""
    out = [(table_id, manifest_of(spark, root, table_id))]
    while base := out[-1][1].get("base"):
        if base in {name for name, _ in out}:
            raise Damaged(f"{table_id} rests on itself")
        found = manifest_of(spark, root, base)
        if manifest_digest(found) != out[-1][1]["base_manifest"]:
            raise Damaged(f"{base} isn't the table that {out[-1][0]} was made from")
        out.append((base, found))
    return out


def write_layer(recomputed: DataFrame, root: str, table_id: str, base: str, shared: Mapping[str, int | str], touched: DataFrame | None = None, **bound: str) -> str:
    """``written`` or ``replayed``. ``recomputed``: all rows of the touched customers; ``shared``: columns with one value.

    ``touched``: customers whose rows in the base don't count; it must be given if some of them have no rows any more.
    """
    spark = recomputed.sparkSession
    below = manifest_of(spark, root, base)
    if sorted(recomputed.columns) != below["columns"].split(","):
        raise ValueError(f"a layer of {base} must have its columns")
    if missing := [c for c in shared if c not in recomputed.columns]:
        raise ValueError(f"no columns {', '.join(missing)}")
    if touched is not None:
        write_once(touched.select(KEY).distinct(), root, f"{table_id}-touched", kind="touched")
    told = {"base": base, "base_manifest": manifest_digest(below), "shared": json.dumps(dict(shared), sort_keys=True), "touched": f"{table_id}-touched" if touched is not None else ""}
    return write_once(recomputed, root, table_id, **told, **bound)


def _touched(spark: SparkSession, root: str, name: str, manifest: Mapping, buckets: Sequence[int] | None) -> DataFrame:
    held = stored_rows(spark, root, name, buckets).select(KEY)
    return held.unionByName(stored_rows(spark, root, manifest["touched"], buckets).select(KEY)) if manifest["touched"] else held


def layered_rows(spark: SparkSession, root: str, table_id: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of a table, whole or in layers, unchecked: of every customer those of the latest layer that touched it.

    All tables of a chain are dealt to buckets by customer, so of some buckets only those are read in each.
    """
    links = chain(spark, root, table_id)
    out, over = None, None
    for name, manifest in links:
        rows = stored_rows(spark, root, name, buckets)
        if over is not None:
            rows = rows.join(over.distinct(), KEY, "left_anti")
        out = rows if out is None else out.unionByName(rows)
        if manifest.get("base"):
            mine = _touched(spark, root, name, manifest, buckets)
            over = mine if over is None else over.unionByName(mine)
    kinds = {f.name: f.dataType for f in out.schema}
    shared = json.loads(links[0][1].get("shared") or "{}")
    return out.withColumns({c: F.lit(v).cast(kinds[c]) for c, v in shared.items()}) if shared else out


def damaged_layers(spark: SparkSession, root: str, table_id: str, buckets: Sequence[int] | None = None) -> list[tuple[str, int]]:
    """(table, bucket) of all that isn't as it was written, along the chain; of some buckets only those are read."""
    names = [x for name, m in chain(spark, root, table_id) for x in (name, m.get("touched")) if x]
    return [(name, b) for name in names for b in damaged_buckets(spark, root, name, buckets)]


def layered_checked(spark: SparkSession, root: str, table_id: str) -> DataFrame:
    """The rows of a table whose whole chain is as it was written."""
    if wrong := damaged_layers(spark, root, table_id):
        raise Damaged(f"{table_id} doesn't agree with its manifests: {', '.join(f'{name} bucket {b}' for name, b in wrong)}")
    return layered_rows(spark, root, table_id)


def flattened(spark: SparkSession, root: str, table_id: str, whole_id: str, share: float = SHARE, most: int = LAYERS) -> str | None:
    """If a chain is long or its layers have grown beyond a share of the whole table, write it as one, ``whole_id``.

    The old tables stay until the caller removes them: generations that rest on them may be in use.
    """
    links = chain(spark, root, table_id)
    sizes = [size_of(spark, f"{root}/{name}/rows") for name, _ in links]
    if len(links) == 1 or (len(links) <= most and sum(sizes[:-1]) < share * sizes[-1]):
        return None
    bound = {k: v for k, v in links[0][1].items() if k in ("definition_set", "event_cutoff", "knowledge_cutoff")}
    return write_once(layered_checked(spark, root, table_id), root, whole_id, **bound)
