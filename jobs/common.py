"""What both jobs share: configuration, paths, log lines, settings that are put back."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def read_config(path: str | None, default: str) -> dict:
    """The JSON configuration at ``path``, or the one that lies beside the jobs."""
    return json.loads(Path(path or Path(__file__).parent / default).read_text())


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as two underscores) for a while."""
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def show_log() -> None:
    """For the command line: the jobs' own lines on standard error."""
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    log.setLevel(logging.INFO)
