"""Driver-side loops of DataFrame supersteps: each state is written to the shared folder, which cuts its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where that is unset, a local one in local mode, as in tests, else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="sparkweave-graph-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


class Loop:
    """States of an iteration. Two are kept: a state may be computed from the one before, which is deleted after that."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.kept = spark, f"{shared_dir(spark)}/loop-{uuid.uuid4().hex}", []
        self.steps = 0

    def fixed(self, df: DataFrame, name: str) -> DataFrame:
        """A table that all steps read."""
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def step(self, df: DataFrame) -> DataFrame:
        """The next state."""
        path = f"{self.base}/step-{self.steps}"
        self.steps += 1
        df.write.parquet(path)
        self.kept.append(path)
        if len(self.kept) > 2:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.kept.pop(0))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return self.spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order_by: list, name: str) -> DataFrame:
    """df with a column of numbers from 0 on without gaps, in an order.

    Rows are dealt to ranges of the order and written, so that they stay where they are; each range counts its own, and
    starts where those before it end. No task sees more than a range, and the driver gets a count for each.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("__place")
    dealt = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    held = Loop(spark).fixed(dealt.select("*", F.spark_partition_id().alias("__range"), place), "numbered")
    counts = {r[0]: r[1] for r in held.groupBy("__range").count().collect()}
    starts, total = [], 0
    for k in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(k, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("__range"))
    return held.select(*[F.col(f"`{c}`") for c in df.columns], (start + F.col("__place")).alias(name))
