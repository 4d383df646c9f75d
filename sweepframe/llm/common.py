"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    A cluster must name one. Only on a local master (tests, a laptop), where driver and executors are
    one process, a temporary folder is made and set instead."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sweepframe-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table that reads it back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Send whole texts to Python workers 1,000 rows at a time, where the session has Spark's default of 10,000.

    A batch stands several times in an executor's memory, on both sides of the pipe."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, "1000")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as decimal text, modulo something: how labelled rows are split."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def id_shards(rows: DataFrame, key: str, n: int):
    """Cut the ascending ids into n ranges of about equal row counts.

    Returns a Column with the range number (0 for null ids). Only the id column is read, and the
    driver gets n - 1 split points, whatever the number of rows. A row is compared with every
    hundredth point and then with a hundred of them."""
    if n <= 1:
        return F.lit(0)
    at = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx(key, F.array(*map(F.lit, at)), F.lit(max(10_000, 20 * n))).alias("q")).first()["q"]
    cuts = sorted(set(found or []))
    if not cuts:
        return F.lit(0)
    step = 100

    def below(points):
        return F.size(F.filter(points, lambda c: c < F.col(key)))

    splits = F.array(*[F.lit(c).cast("long") for c in cuts])
    if len(cuts) <= step:
        return F.coalesce(below(splits), F.lit(0))
    coarse = below(F.array(*[F.lit(c).cast("long") for c in cuts[step - 1 :: step]])) * step
    return F.coalesce(coarse + below(F.slice(splits, coarse + 1, step)), F.lit(0))
