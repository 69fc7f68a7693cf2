"""A build as a job: ``spark-submit tidemark/plans/job.py --revisions PATH --spine PATH --root PATH ...``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tidemark.definitions import payment_features
from tidemark.plans.pipelines import full_rebuild
from tidemark.sources.tables import FORMATS, read_revisions


def main(arguments: Sequence[str] | None = None) -> str:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--revisions", required=True)
    p.add_argument("--spine", required=True, help="Parquet table with customer_id")
    p.add_argument("--root", required=True, help="where generations are kept")
    p.add_argument("--generation", required=True)
    p.add_argument("--event-cutoff", type=int, required=True)
    p.add_argument("--knowledge-cutoff", type=int, required=True)
    p.add_argument("--format", choices=FORMATS, default="parquet")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    revisions = read_revisions(spark, a.revisions, a.format)
    outcome = full_rebuild(revisions, spark.read.parquet(a.spine).select("customer_id"), payment_features(), a.event_cutoff, a.knowledge_cutoff, a.generation, a.root)
    print(outcome)
    return outcome


if __name__ == "__main__":
    main()
