"""Running values over a global or per-group order without one task holding a whole group.

Rows are cut into blocks of the order column; windows run inside a block, and a
second window over one summary row a block carries the state in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def running(df: DataFrame, order: str, part: str | None = None, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """df with, for each name in sums, the running sum, and for each in lasts, the last value that isn't null, up to and
    including the row in order of the unique long column `order`, within each value of `part` (null being one)."""
    sums, lasts = sums or {}, lasts or {}
    own = df.withColumns({"__p": F.coalesce(F.col(part).cast("string"), F.lit("\0")) if part else F.lit(""), "__b": F.floor(F.col(order) / block)})
    own = own.withColumns({f"__{k}": v for k, v in (sums | lasts).items()})
    w = Window.partitionBy("__p", "__b").orderBy(order)
    before = Window.partitionBy("__p").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("__p", "__b").agg(
        *[F.sum(f"__{k}").alias(k) for k in sums],
        *[F.max(F.when(F.col(f"__{k}").isNotNull(), F.struct(F.col(order).alias("o"), F.col(f"__{k}").alias("v")))).alias(k) for k in lasts],
        F.count("*").alias("__n"),
    )
    carried = totals.select(
        "__p", "__b",
        *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__c_{k}") for k in sums],
        *[F.last(k, ignorenulls=True).over(before)["v"].alias(f"__c_{k}") for k in lasts],
    )
    out = own.withColumns({f"__l_{k}": F.sum(f"__{k}").over(w) for k in sums} | {f"__l_{k}": F.last(f"__{k}", ignorenulls=True).over(w) for k in lasts}).join(carried, ["__p", "__b"])
    out = out.withColumns({k: F.coalesce(f"__l_{k}", F.lit(0)) + F.col(f"__c_{k}") for k in sums} | {k: F.coalesce(f"__l_{k}", f"__c_{k}") for k in lasts})
    return out.drop("__p", "__b", *[f"__{k}" for k in sums | lasts], *[f"__l_{k}" for k in sums | lasts], *[f"__c_{k}" for k in sums | lasts])
