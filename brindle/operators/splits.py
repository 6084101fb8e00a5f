"""Deterministic splits into training and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import hash_bucket
from brindle.operators.numbering import number_rows


def split_instances(cases: DataFrame, seed: int = 13, fraction: float = 0.3, key: str = "case_id", order: str = "smell_id") -> DataFrame:
    """`cases` with bucket and split by the hash of the key.

    If no case falls into validation and there is more than one, the first by
    `order` goes there.
    """
    hashed = cases.withColumn("bucket", hash_bucket(seed, F.col(key).cast("string")))
    lone = hashed.agg(F.count_if(F.col("bucket") < fraction).alias("n"), F.count("*").alias("all"), F.min(F.struct(F.col(order).alias("by"), F.col(key).alias("first"))).alias("least"))
    moved = hashed.crossJoin(F.broadcast(lone.select((F.col("n") == 0).alias("none"), "all", F.col("least.first").alias("first_key"))))  # one row
    validation = (F.col("bucket") < fraction) | (F.col("none") & (F.col("all") > 1) & (F.col(key) == F.col("first_key")))
    return moved.withColumn("split", F.when(validation, "validation").otherwise("train")).drop("none", "all", "first_key")


def split_projects(projects: DataFrame, seed: int = 13, fraction: float = 0.3) -> DataFrame:
    """project, bucket, split: the first share of the projects by hash, one at least, is for validation."""
    names = projects.select("project").distinct().withColumn("bucket", hash_bucket(seed, F.col("project")))
    ranked = number_rows(names, [F.col("bucket"), F.col("project")], "rank")
    n = names.agg(F.greatest(F.lit(1), F.bround(F.count("*") * fraction).cast("int")).alias("n_validation"))
    return ranked.crossJoin(F.broadcast(n)).select("project", "bucket", F.when(F.col("rank") <= F.col("n_validation"), "validation").otherwise("train").alias("split"))
