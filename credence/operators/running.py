"""Running sums and carried values over long series, in spans, so that no series meets in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_sums(df: DataFrame, group: Sequence[str], order: str, values: Sequence[str], span: int) -> DataFrame:
    """Adds <value>_sum: the sum up to and with a row, by ``order`` (a whole number, one row for each in a group).

    Rows are summed within spans of the order, and spans through one row each.
    """
    spanned = df.withColumn("_span", F.floor(F.col(order) / F.lit(span)))
    totals = spanned.groupBy(*group, "_span").agg(*(F.sum(v).alias(f"_all_{v}") for v in values))
    before = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_span", *(F.coalesce(F.sum(f"_all_{v}").over(before), F.lit(0)).alias(f"_base_{v}") for v in values))
    inside = Window.partitionBy(*group, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = spanned.withColumns({f"_in_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    out = local.join(totals, [*group, "_span"])
    return out.select(*df.columns, *((F.col(f"_base_{v}") + F.col(f"_in_{v}")).alias(f"{v}_sum") for v in values))


def neighbours(df: DataFrame, group: Sequence[str], order: str, columns: Sequence[str], span: int) -> DataFrame:
    """Adds <column>_before and <column>_after: the nearest known value at or before, and at or after, each row."""
    spanned = df.withColumn("_span", F.floor(F.col(order) / F.lit(span)))
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    ends = spanned.groupBy(*group, "_span").agg(*(F.max_by(c, at(c)).alias(f"_last_{c}") for c in columns), *(F.min_by(c, at(c)).alias(f"_first_{c}") for c in columns))
    spans = Window.partitionBy(*group).orderBy("_span")
    back, ahead = spans.rowsBetween(Window.unboundedPreceding, -1), spans.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(*group, "_span", *(F.last(f"_last_{c}", ignorenulls=True).over(back).alias(f"_back_{c}") for c in columns), *(F.first(f"_first_{c}", ignorenulls=True).over(ahead).alias(f"_ahead_{c}") for c in columns))
    inside = Window.partitionBy(*group, "_span").orderBy(order)
    up, down = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    local = spanned.withColumns({f"_up_{c}": F.last(c, ignorenulls=True).over(up) for c in columns} | {f"_down_{c}": F.first(c, ignorenulls=True).over(down) for c in columns})
    out = local.join(ends, [*group, "_span"])
    before = [F.coalesce(f"_up_{c}", f"_back_{c}").alias(f"{c}_before") for c in columns]
    return out.select(*df.columns, *before, *(F.coalesce(f"_down_{c}", f"_ahead_{c}").alias(f"{c}_after") for c in columns))
