"""Text tables in, immutable tables out, and what is needed to know that a table is what it was."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV table, compressed or not, with a header and every column as text."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def write_text_table(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)


def content_hash(df: DataFrame) -> DataFrame:
    """rows and an order-free hash of all cells, in one pass with partial sums."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)]).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("content_hash"))


def write_once(df: DataFrame, path: str) -> bool:
    """Write a table that must never change. True if written, False if the same table is there; other content is an error.

    Spark's committer makes the write atomic: readers see no part of it before ``_SUCCESS``.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        old, new = content_hash(spark.read.parquet(path)).first(), content_hash(df).first()
        if old != new:
            raise FileExistsError(f"{path} holds another table")
        return False
    df.write.option("compression", "zstd").mode("errorifexists").parquet(path)
    return True


def column_extent(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: rows, nulls, least and greatest value as text; for Parquet answered from few bytes a row group."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")) for c in columns]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def write_json(value: object, path: str | Path) -> None:
    """A small document, written beside and moved into place."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(path.name + ".partial")
    draft.write_text(json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")
    draft.replace(path)


def read_months(spark: SparkSession, root: str, first: str, last: str, month: Column | None = None) -> DataFrame:
    """A table partitioned by ``month`` (YYYY-MM), only the partitions of a closed range."""
    c = month if month is not None else F.col("month")
    return spark.read.option("recursiveFileLookup", False).parquet(root).filter((c >= first) & (c <= last))


def stream_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A stream of a table's Parquet files, whether it is a folder or a single file of ``directory``."""
    path = f"{directory}/{name}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
