"""Convergent loads: what a table must lose, keep and gain to equal an export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialize


def stale(table: DataFrame, export: DataFrame, key: str = "id") -> DataFrame:
    """Ids of ``table`` that the export no longer has."""
    return table.select(key).distinct().join(export.select(key), key, "left_anti")


def missing(table: DataFrame, export: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the export whose id the table lacks."""
    return export.join(table.select(key), key, "left_anti")


def converge(table: DataFrame, export: DataFrame, key: str = "id") -> DataFrame:
    """The table after the load: rows of the export that it lacked, and its own rows that the export still has.

    Present rows are kept as they are, so that nothing that was computed for them (an embedding) is computed again.
    """
    kept = table.join(export.select(key), key, "left_semi")
    return kept.unionByName(missing(table, export, key), allowMissingColumns=True)


def load_counts(table: DataFrame, export: DataFrame, key: str = "id") -> DataFrame:
    """One row ``rows, inserted, deleted``."""
    rows, new, old = (x.select(key).distinct().agg(F.count("*").alias(n)) for x, n in ((export, "rows"), (missing(table, export, key), "inserted"), (stale(table, export, key), "deleted")))
    return rows.crossJoin(new).crossJoin(old)


def resume(job: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of a job whose ``key`` has no result yet; results are the checkpoint."""
    return job.join(materialize(done.select(key).distinct()), key, "left_anti")
