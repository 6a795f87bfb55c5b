"""What the jobs share: configuration, logging and a schema's DDL."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("lamina.jobs")


def config(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """``defaults`` with what a JSON file says; Spark reads the file, so its path may be remote."""
    if path is None:
        return dict(defaults)
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    unknown = set(given) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return defaults | given


def said(event: str, **facts) -> dict:
    """Log an event and its facts as one line of JSON; returns the facts."""
    log.info(json.dumps({"event": event, **facts}, default=str, sort_keys=True))
    return facts


def started(parser: argparse.ArgumentParser, args: list[str] | None, name: str) -> tuple[argparse.Namespace, SparkSession]:
    """Parsed arguments, and a session for the command line alone."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    given = parser.parse_args(args)
    return given, SparkSession.builder.appName(name).getOrCreate()


def prepared(spark: SparkSession, path: str, schema: str, by: list[str]) -> None:
    """An empty table at ``path``, unless there is one, so it can be read before anything is written."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
