"""Running sums and row numbers over a whole order without a window that holds all rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its column over the rows of the same ``by`` group up to and including the row.

    ``order`` must tell all rows of a group apart, or rows that tie share out their
    sums in any order.  Rows are dealt to range partitions of (by, order); each
    partition adds up its own rows, and what the partitions before hold of the same
    group is joined back from one row per partition and group met in it.  No window
    holds more than one range partition, or more totals than there are partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut_lineage(df.withColumns({f"__{k}": c for k, c in sums.items()})
                         .repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    totals = ranges.groupBy("__part", *by).agg(*(F.sum(f"__{k}").alias(f"__{k}") for k in sums))
    if by:
        before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("__part", *by, *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums))
    else:
        rows, held = [], {k: 0 for k in sums}
        for r in sorted(totals.collect(), key=lambda r: r["__part"]):  # one row for each partition
            rows.append((r["__part"], *held.values()))
            held = {k: v + (r[f"__{k}"] or 0) for k, v in held.items()}
        kinds = ", ".join(f"`__before_{k}` {totals.schema[f'__{k}'].dataType.simpleString()}" for k in sums)
        offsets = spark.createDataFrame(rows, f"__part int, {kinds}")
    here = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranges.select("*", *(F.sum(f"__{k}").over(here).alias(f"__own_{k}") for k in sums))
    on = own["__part"] == offsets["__part"]
    for c in by:
        on = on & own[c].eqNullSafe(offsets[c])
    return own.join(offsets, on).select(
        *(own[c] for c in df.columns), *((F.col(f"__own_{k}") + F.col(f"__before_{k}")).alias(k) for k in sums))


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """``df`` with the number of each row in ``order``, from ``first``."""
    return running_sums(df, order, {name: F.lit(1)}).withColumn(name, F.col(name) + F.lit(first - 1))
