"""As-of joins as one union and one ordered window per key.

No side is exploded and no inequality join is planned: each key's rows are sorted
once and the latest (or next) right-hand value is carried across the left rows.
Hot keys: pass a right side that is already one row per (key, order) and a left
side reduced to the distinct (key, order) pairs it asks for.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(
    left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str], strict: bool = False
) -> DataFrame:
    """Attach the latest right row at or before (``strict``: before) each left row."""
    return _carry(left, right, keys, order, values, backward=True, inclusive=not strict)


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Attach the first right row at or after each left row."""
    return _carry(left, right, keys, order, values, backward=False, inclusive=True)


def _carry(left, right, keys, order, values, backward, inclusive) -> DataFrame:
    asked = left.select(*keys, order).distinct()
    r = right.select(*keys, order, F.struct(*[F.col(v) for v in values]).alias("_hit"), F.lit(0).alias("_side"))
    a = asked.select(*keys, order, F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"), F.lit(1).alias("_side"))
    side = F.col("_side")
    if backward:
        w = Window.partitionBy(*keys).orderBy(order, side if inclusive else -side)
        found = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        w = Window.partitionBy(*keys).orderBy(order, -side)
        found = F.first("_hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    carried = (
        r.unionByName(a)
        .withColumn("_found", found)
        .where("_side = 1")
        .select(*keys, order, *[F.col(f"_found.{v}").alias(v) for v in values])
    )
    return left.join(carried, [*keys, order], "left")
