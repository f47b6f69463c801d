"""Session, table and key helpers that every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a single-process session without that setting gets a folder of its own; on a cluster a
    missing setting is an error, since a machine-local folder would lose data with its executor.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    place = "file://" + tempfile.mkdtemp(prefix="tidebook-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidebook/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table written to the shared folder; survives the loss of executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hex_text(column: str | Column) -> Column:
    """Hex text compared without regard to case or outer blanks."""
    return F.lower(F.trim(F.col(column) if isinstance(column, str) else column))


def entity_key(columns: list[str]) -> Column:
    """One non-null string that stands for a tuple of key columns, nulls included (injective)."""
    return F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]))


def entity_columns(column: str, columns: list[str], schema: T.StructType) -> list[Column]:
    """The key columns back from ``entity_key``."""
    kinds = T.StructType([T.StructField(f"k{i}", schema[c].dataType) for i, c in enumerate(columns)])
    return [F.from_json(F.col(column), kinds)[f"k{i}"].alias(c) for i, c in enumerate(columns)]


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, as the optimizer knows them; no job is run.

    Leaves are added up, since estimates above joins are products. A leaf of unknown size (an RDD
    made by hand) counts as 0.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 2**60)


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, -(-estimated_bytes(df) // bytes_each)))


def latest(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row a key: the one with the latest ``order`` (null is the earliest).

    Ties take the greatest values, so the result does not depend on row order. The aggregate
    combines before the shuffle, so that a key with very many versions costs one row a partition.
    """
    best = F.max(F.struct(F.col(order).alias("o"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])).alias("best")
    kept = df.groupBy(*keys).agg(best)
    return kept.select(*keys, F.col("best.o").alias(order), *[F.col(f"best.v{i}").alias(v) for i, v in enumerate(values)])
