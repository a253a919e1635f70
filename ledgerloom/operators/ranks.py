"""Numbers over a whole table, without one task for all rows, and the shared folder that this needs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> None:
    """Sets the checkpoint folder: what spark.checkpoint.dir names; one of our own only within one machine, as in tests."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-ledgerloom-")
    spark.sparkContext.setCheckpointDir(base)


def table_of(rows: DataFrame) -> DataFrame:
    """rows, written as a table in the shared folder: readers take the columns that they need, where a checkpoint's read all."""
    spark = rows.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """Adds the place of each row (from 1) in the order of the whole table: rows are put in ranges, ranked within each, and the ranges' counts (one row each) are summed."""
    shared_folder(rows.sparkSession)
    parted = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    counts = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parted.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__own")).cast("int")).drop("__part", "__own", "__before")
