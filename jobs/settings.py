"""What the jobs share: their config files, the steps of a source table, and the log."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def config(path: str | None, default: str) -> dict:
    """The config file at path, or the one of this folder; it is small and lies beside the job."""
    return json.loads(Path(path or Path(__file__).with_name(default)).read_text())


def start_log() -> None:
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    log.setLevel(logging.INFO)


def steps_of(source: DataFrame, columns: dict[str, str], where: str | None = None) -> DataFrame:
    """source as steps: columns maps each name to an expression, which may use source columns and names before it.

    Names that begin with an underscore are only for later expressions.  Without any columns the source
    has steps already.
    """
    rows = source.select(*(F.expr(e).alias(name) for name, e in columns.items())) if columns else source
    rows = rows.drop(*(c for c in columns if c.startswith("_")))
    return rows.where(where) if where else rows
