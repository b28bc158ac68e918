"""Running counts as files arrive: a streaming aggregation whose state goes on from run to run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import advance, latest


def incremental_counts(rows: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Counts by ``keys`` of all that ``rows``, a streaming DataFrame, has brought so far, over every run with this ``folder``.

    A run takes what is there and unseen, then stops. The counts are the query's state, one row a key, and each batch tells those it
    changed, so a file that comes late or a batch repeated after a crash is counted once. A watermark set on ``rows`` before, with its
    window among the keys, lets counts of past windows leave the state. ``folder`` must be shared by the cluster. Nothing brought yet: no rows.
    """
    told = advance(rows.groupBy(*keys).agg(F.count("*").alias("n")), folder)
    return latest(told, keys)
