"""Running aggregates over ordered rows of a key, none of whose groups must fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How two parts of an aggregate join, and how rows and parts are aggregated.  All of them pass over nulls.
_AGGREGATE = {"min": F.min, "max": F.max, "sum": F.sum}


def _joined(kind: str, a: Column, b: Column) -> Column:
    return F.least(a, b) if kind == "min" else F.greatest(a, b) if kind == "max" else F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def running(df: DataFrame, by: list[str], bucket: str, order: list[str], aggs: dict[str, tuple[str, str]], *, inclusive: bool = True) -> DataFrame:
    """Adds ``aggs`` (name: (min, max or sum; column)) over all rows of the same ``by`` that come before a row, and over the row
    itself if ``inclusive``.

    ``bucket`` is a column that never falls along ``order``.  Rows are dealt by key and bucket, so a task runs through one
    bucket of a key; what a bucket starts from is carried over from the sums of the buckets before, one row each.  Rows with a
    null in ``by`` get nulls; the result has no row more or less.
    """
    within = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, bucket).agg(*(_AGGREGATE[kind](c).alias(f"_s_{name}") for name, (kind, c) in aggs.items()))
    carried = sums.select(*by, bucket, *(_AGGREGATE[kind](f"_s_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in aggs.items()))
    here = df.select("*", *(_AGGREGATE[kind](c).over(within).alias(f"_w_{name}") for name, (kind, c) in aggs.items()))
    met = here.join(carried, [*by, bucket], "left")
    return met.select(*df.columns, *(_joined(kind, F.col(f"_c_{name}"), F.col(f"_w_{name}")).alias(name) for name, (kind, _) in aggs.items()))
