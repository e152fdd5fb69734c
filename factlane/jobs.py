"""Jobs for spark-submit: ``factlane-ingest`` and ``factlane-train`` (or ``python -m factlane.jobs``)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    from factlane.session import ship

    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    return spark


def ingest_job(arguments: list[str] | None = None) -> None:
    """Reads the city exports of a folder and writes the knowledge base."""
    from factlane.plans.ingest import ingest

    parser = argparse.ArgumentParser(description=ingest_job.__doc__)
    parser.add_argument("folder")
    parser.add_argument("cities", help="JSON object from entry (file or folder below FOLDER) to city")
    parser.add_argument("target")
    parser.add_argument("--csv-target")
    given = parser.parse_args(arguments)
    print(json.dumps(ingest(_session(), given.folder, json.loads(given.cities), given.target, given.csv_target), ensure_ascii=False))


def train_job(arguments: list[str] | None = None) -> None:
    """Trains the intent classifier and stores it; of a table of (key, label, text) or of the built-in examples."""
    from factlane.operators.classifier import label_rows, train

    parser = argparse.ArgumentParser(description=train_job.__doc__)
    parser.add_argument("target")
    parser.add_argument("--rows", help="Parquet of labelled rows")
    parser.add_argument("--key", default="example_id")
    given = parser.parse_args(arguments)
    spark = _session()
    rows = spark.read.parquet(given.rows) if given.rows else label_rows(spark)
    train(rows, given.key).save(given.target)


if __name__ == "__main__":
    {"ingest": ingest_job, "train": train_job}[sys.argv[1]](sys.argv[2:])
