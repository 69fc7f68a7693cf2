"""Time tiles: windows are put together from whole tiles' partial aggregates, and raw rows only where a tile won't do.

A tile is a customer's stretch of event time. Its partials hold for every label that knows all its revisions (the tile
is settled by the label's cutoff) and whose window holds it whole. So a label over a wide window meets one row for each
tile, and raw rows of the tiles at its windows' edges and of tiles that later knowledge still changes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.definitions import COMPUTATIONS, FeatureDefinition, check_definitions, parts_of
from tidemark.operators.features import with_default
from tidemark.operators.temporal import FOREVER, valid_at, validity_intervals
from tidemark.operators.training import label_cutoffs

#: Seconds of a tile.
WIDTH = 86_400


def _tile(c: Column, width: int) -> Column:
    return F.floor(c / width)


def build_tiles(intervals: DataFrame, definitions: Sequence[FeatureDefinition], width: int = WIDTH) -> DataFrame:
    """``customer_id, _tile, settled_at`` and partials of revisions with their validity intervals (which may be stored).

    A tile's partials are those of the revisions that stand in the end; ``settled_at`` is when the last of its revisions
    came or was replaced, so a label with a cutoff from then on sees them.
    """
    parts = parts_of(definitions)
    stands = (F.col("operation") == "upsert") & (F.col("known_to") == FOREVER)
    # an upsert that is replaced changes its tile then; a retraction stands in no tile, but what it ends does
    changed = F.greatest("known_from", F.when(F.col("known_to") == FOREVER, F.col("known_from")).otherwise(F.col("known_to")))
    rows = intervals.where("operation = 'upsert'").withColumn("_tile", _tile(F.col("event_time"), width))
    return rows.groupBy("customer_id", "_tile").agg(F.max(changed).alias("settled_at"), *[p.over_rows(stands).alias(name) for name, p in parts.items()])


def _edges(d: FeatureDefinition, width: int) -> tuple[Column, Column]:
    """First and last tile that lie whole inside a definition's window at ``label_time``, which is open left and closed right."""
    low = F.ceil((F.col("label_time") - d.window_seconds + 1) / width)
    high = F.floor((F.col("label_time") + 1) / width) - 1
    return low, high


def tiled_dataset(labels: DataFrame, revisions: DataFrame, definitions: Sequence[FeatureDefinition], dataset_as_of: int, width: int = WIDTH, tiles: DataFrame | None = None) -> DataFrame:
    """What ``training.point_in_time_dataset`` gives, by way of tiles. ``tiles``: those of the same revisions, if stored.

    Definitions must have windows and computations that come in parts (``definitions.register``).
    """
    check_definitions(definitions)
    if any(d.window_seconds is None for d in definitions):
        raise ValueError("tiles need bounded windows")
    parts = parts_of(definitions)
    cut = label_cutoffs(labels, dataset_as_of)
    intervals = validity_intervals(revisions)
    tiles = build_tiles(intervals, definitions, width) if tiles is None else tiles
    widest = max(d.window_seconds for d in definitions)
    who = cut.select("label_id", "customer_id", "label_time", "effective_cutoff")
    first, last = _tile(F.col("label_time") - widest + 1, width), _tile(F.col("label_time"), width)
    asked = who.withColumn("_tile", F.explode(F.sequence(first, last)))
    met = asked.join(tiles, ["customer_id", "_tile"])  # tiles without rows are in no join
    settled = F.col("settled_at") <= F.col("effective_cutoff")
    whole = {d.name: settled & (F.col("_tile") >= _edges(d, width)[0]) & (F.col("_tile") <= _edges(d, width)[1]) for d in definitions}
    flags = [whole[d.name].alias(f"_whole_{d.name}") for d in definitions]
    # a tile's row needs raw rows too, unless each definition takes it whole or has it outside its window
    touches = {d.name: (F.col("_tile") + 1) * width > F.col("label_time") - d.window_seconds + 1 for d in definitions}
    raw_too = reduce(lambda a, b: a | b, [touches[d.name] & ~whole[d.name] for d in definitions])
    met = met.select("label_id", "customer_id", "label_time", "effective_cutoff", "_tile", *parts, *flags, raw_too.alias("_raw"))
    from_tiles = met.select("label_id", "label_time", F.lit(None).cast("bigint").alias("event_time"), *parts, *[f"_whole_{d.name}" for d in definitions])
    rows = intervals.where("operation = 'upsert'").withColumn("_tile", _tile(F.col("event_time"), width))
    rows = rows.select("customer_id", "_tile", "event_time", "known_from", "known_to", *[p.value().alias(name) for name, p in parts.items()])
    edge = met.where("_raw").select("label_id", "customer_id", "label_time", "effective_cutoff", "_tile", *[f"_whole_{d.name}" for d in definitions])
    seen = edge.join(rows, ["customer_id", "_tile"]).where(valid_at(F.col("effective_cutoff")) & (F.col("event_time") <= F.col("label_time")))
    from_rows = seen.select("label_id", "label_time", "event_time", *parts, *[f"_whole_{d.name}" for d in definitions])

    def counts(d: FeatureDefinition) -> Column:
        """Whether a joined row counts for a definition: a tile that is whole for it, or a raw row that no tile stands for."""
        raw = F.col("event_time").isNotNull()
        return F.when(raw, ~F.col(f"_whole_{d.name}") & (F.col("event_time") > F.col("label_time") - d.window_seconds)).otherwise(F.col(f"_whole_{d.name}"))

    own = {d.name: parts_of([d]) for d in definitions}
    merged = [p.merged(name, counts(d)).alias(f"_{d.name}_{name}") for d in definitions for name, p in own[d.name].items()]
    found = from_tiles.unionByName(from_rows).groupBy("label_id", "label_time").agg(*merged)
    values = [COMPUTATIONS[d.computation].final({name: F.col(f"_{d.name}_{name}") for name in own[d.name]}, F.col("label_time")).alias(d.name) for d in definitions]
    told = found.select("label_id", *values)
    return cut.join(told, "label_id", "left").select(*cut.columns, *[with_default(d).alias(d.name) for d in definitions])
