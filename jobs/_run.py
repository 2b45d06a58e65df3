"""What the jobs share: options from a configuration file and the command line, logging, settings put back."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.session import get_session

log = logging.getLogger("jobs")


def options(spark: SparkSession, path: str | None, defaults: dict[str, object], given: dict[str, str]) -> dict[str, object]:
    """Defaults, over them a JSON file read by Spark, over it what the command line gives; an unknown or missing name is an error."""
    found = dict(defaults)
    if path:
        found |= json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    found |= {k: type(defaults[k])(v) for k, v in given.items() if v is not None}
    if unknown := set(found) - set(defaults):
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    if missing := [k for k, v in found.items() if v == ""]:
        raise ValueError(f"options without a value: {', '.join(sorted(missing))}")
    return found


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as ``__``) for a while; what was there before comes back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """A frame that counts its rows while something else is done with it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def command(description: str, defaults: dict[str, object], job: Callable[..., object]) -> None:
    """The command line of a job: only here a session is made and stopped."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", help="a JSON file of the options below")
    parser.add_argument("--master")
    for name, value in defaults.items():
        parser.add_argument(f"--{name.replace('_', '-')}", help=f"default: {value}" if value != "" else None)
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = get_session(given.pop("master"), description)
    try:
        job(spark, **options(spark, given.pop("config"), defaults, given))
    finally:
        spark.stop()
