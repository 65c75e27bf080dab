"""As-of joins: the last mark at or before each row, in one ordered pass over each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_before(rows: DataFrame, marks: DataFrame, by: str, at: str, order: str, values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of the last mark of the same key at or before ``at``; null if there is none.

    Of marks at one time that with the greatest ``order`` counts. Rows and marks are sorted together
    once; nothing is compared pair by pair.
    """
    value = F.struct(*values)
    a = rows.select(by, at, F.lit(1).alias("__side"), F.lit(None).cast(marks.schema[order].dataType).alias("__order"), F.struct(*rows.columns).alias("__row"))
    b = marks.select(by, at, F.lit(0).alias("__side"), F.col(order).alias("__order"), value.alias("__mark"))
    frame = W.partitionBy(by).orderBy(at, "__side", "__order").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__mark", ignorenulls=True).over(frame))
    return both.where("__side = 1").select("__row.*", *[F.col(f"__last.{v}").alias(f"last_{v}") for v in values])
