"""Places in one order of a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pelagos.sources.scratch import written


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``, their place from 1 on by ``order``, which has no ties.

    Rows are dealt out by ranges, numbered within their range, and moved on by the rows of the ranges before: one
    row a range is all that meets in one place.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_nth", within).join(before, "_range").withColumn(name, F.col("_nth") + F.col("_before")).drop("_range", "_nth", "_before")
