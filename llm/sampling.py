"""Bounded, deterministic samples of labelled rows for fitting a classifier."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut

#: Rows of all classes together, about; and rows of a class at least, however many classes there are.
MOST = 24_000
LEAST = 16


def share_of(quota: int, classes: int, most: int = MOST) -> int:
    """Rows of each class: ``quota``, or fewer where the classes are so many that ``most`` would be passed."""
    return max(min(quota, LEAST), min(quota, most // max(1, classes)))


def labelled(rows: DataFrame, label: str, by: tuple[str, ...], quota: int) -> tuple[DataFrame, dict, int]:
    """Distinct rows of every class, about 1.3 times its quota (all, if it has fewer), the classes' counts, and the quota.

    A row is taken by a hash of its columns ``by``, so that no class is collected or sorted, and a hot class
    costs no more than another; what is taken is made distinct, so neither do rows that repeat.
    The counts, one small row a class, are a table that is joined.
    """
    counts = cut(rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_sampled")).agg(F.count("*").alias("_rows")), "sample-classes")
    counted = {r["_sampled"]: r["_rows"] for r in counts.collect()}
    quota = share_of(quota, len(counted))
    uniform = F.pmod(F.xxhash64(*by, F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    taken = rows.withColumn("_u", uniform).join(counts, F.col(label) == F.col("_sampled")).where(F.col("_u") < 1.3 * quota / F.col("_rows"))
    return taken.drop("_u", "_sampled", "_rows").distinct(), counted, quota


def trimmed(frame: pd.DataFrame, label: str, quota: int) -> pd.DataFrame:
    """At most ``quota`` rows of each class, in an order that only the rows decide; equal rows are alike."""
    order = pd.util.hash_pandas_object(frame["text"], index=False)
    return frame.assign(_o=order).sort_values("_o").groupby(label, sort=True).head(quota).drop(columns="_o")
