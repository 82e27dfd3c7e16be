"""Readers and writers: text tables, image folders, logs, models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import put_file


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, header: bool = True) -> DataFrame:
    """A text table with a stated schema; stray index columns are dropped by not naming them."""
    return spark.read.schema(schema).csv(path, header=header)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def stem(path: Column) -> Column:
    """A file's name without folders and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def images(spark: SparkSession, folders: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """(image_id, path, content) of all files in the folders; bytes stay on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load([folders] if isinstance(folders, str) else list(folders))
    return files.select(stem(F.col("path")).alias("image_id"), "path", "content")


def write_files(df: DataFrame, folder: str, suffix: str) -> None:
    """A file of its own for every row (image_id, content), written where the row is."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("image_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                put_file(folder, f"{name}{suffix}", [content])
        yield from ()

    df.select(F.col("image_id").cast("string").alias("image_id"), "content").mapInArrow(run, "image_id string").count()


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_model(tables: Mapping[str, DataFrame], path: str) -> None:
    """A model as a folder of Parquet tables (rules, centres, scores, ranges)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_model(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}
