"""What the jobs share: their command line and config file. Only the command line creates and stops a session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def configured(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with what a JSON file, read by Spark from any store, has in their place; unknown names are errors."""
    given = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) if path else {}
    if set(given) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(set(given) - set(defaults))}")
    return defaults | given


def present(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of ours under its stated schema, partition columns included; one without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def main(run: Callable[..., dict], about: str, defaults: dict, paths: dict[str, str]) -> None:
    """Parses --<path> for each path and --config, and calls run(spark, <paths>, config=...)."""
    parser = argparse.ArgumentParser(description=about)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help=f"a JSON file of settings; without it {json.dumps(defaults)}")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about.split(":")[0]).getOrCreate()
    try:
        config = configured(spark, args.pop("config"), defaults)
        logging.getLogger("jobs").info("done: %s", json.dumps(run(spark, **args, config=config), sort_keys=True))
    finally:
        spark.stop()
