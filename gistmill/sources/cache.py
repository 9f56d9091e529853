"""Result caches as tables, run folders, merged runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_key(signature: str, ratio: Column, *parts: Column) -> Column:
    """A digest of the resolved settings, the ratio to six places and the sample's content."""
    return F.sha2(F.concat_ws("|", F.lit(signature), F.round(ratio, 6).cast("string"), *[p.cast("string") for p in parts]), 256)


def split(samples: DataFrame, cached: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The samples that a cache holds and those it lacks."""
    return samples.join(cached, key, "left_semi"), samples.join(cached, key, "left_anti")


def through(samples: DataFrame, path: str, compute, key: str = "key") -> DataFrame:
    """Results of all samples: cached ones are read, missing ones computed and appended to the cache table."""
    spark = samples.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        _, missing = split(samples, spark.read.parquet(path).select(key), key)
        compute(missing).write.mode("append").parquet(path)
    else:
        compute(samples).write.parquet(path)
    return spark.read.parquet(path).join(samples.select(key).distinct(), key, "left_semi")


def write_run(aggregates: DataFrame, per_sample: DataFrame, folder: str, run: str) -> str:
    """A run's aggregates as CSV and JSON and its samples as JSON, in a folder of its own."""
    base = f"{folder}/run={run}"
    aggregates.coalesce(1).write.mode("overwrite").csv(f"{base}/aggregate_csv", header=True)
    aggregates.coalesce(1).write.mode("overwrite").json(f"{base}/aggregate")
    per_sample.write.mode("overwrite").json(f"{base}/per_sample")
    return base


def merge_runs(runs: list[DataFrame], methods: list[str]) -> DataFrame:
    """All rows of several runs with their place by ratio and the order of methods."""
    from pyspark.sql import Window as W

    union = runs[0]
    for r in runs[1:]:
        union = union.unionByName(r)
    order = F.coalesce(F.array_position(F.array(*map(F.lit, methods)), F.col("method")), F.lit(1 << 20))
    return union.withColumn("place", F.row_number().over(W.orderBy("keep_ratio", order)) - 1)  # aggregates, a handful of rows


def detect_kind(columns: list[str]) -> str:
    """Which kind of result table has these columns."""
    if {"method", "keep_ratio"} <= set(columns):
        return "comparison"
    if "reduce_ratio" in columns:
        return "single"
    raise ValueError("not a result table")


def winner(a: Column, b: Column, higher: bool = True) -> Column:
    better, worse = (a > b, a < b) if higher else (a < b, a > b)
    return F.when(better, "A").when(worse, "B").otherwise("Tie")
