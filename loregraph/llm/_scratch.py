"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loregraph.operators.store import shared_root


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that do not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"__{name}"
        while candidate.lower() in taken:
            candidate += "_"
        taken.add(candidate.lower())
        out.append(candidate)
    return out
