"""Running sums over all rows in an order, without one task for them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlume.plans.shared import cut


def running_sum(rows: DataFrame, value: Column, out: str, *order: Column | str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row. The order must be total.

    Ranges of the order are parted, each summed by itself; the one window without a key sees a row for each part.
    """
    parted = cut(rows.withColumn("running_value", value).repartitionByRange(*order).withColumn("running_part", F.spark_partition_id()))
    sums = parted.groupBy("running_part").agg(F.sum("running_value").alias("n"))
    before = sums.select("running_part", (F.sum("n").over(Window.orderBy("running_part")) - F.col("n")).alias("running_before"))
    own = F.sum("running_value").over(Window.partitionBy("running_part").orderBy(*order))
    return parted.withColumn("running_own", own).join(F.broadcast(before), "running_part").withColumn(out, F.col("running_own") + F.col("running_before")).select(*rows.columns, out)
