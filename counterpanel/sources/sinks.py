"""Writers for series, inference and weights tables.

Results of all studies go to one table per kind, partitioned by placebo tag (and
method), instead of one file per run: a new run overwrites only its own
partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _save(df: DataFrame, path: str, partitions: list[str], fmt: str) -> str:
    writer = (
        df.write.partitionBy(*partitions)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
    )
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    writer.format(fmt).save(path)
    return path


def save_series(series: DataFrame, base: str, step: float | None, fmt: str = "parquet") -> str:
    """Series by placebo tag; the grid step is a column (NULL without bounds)."""
    tagged = series.withColumn("ci_step", F.lit(step).cast("double"))
    return _save(tagged, f"{base}/series", ["placebo"], fmt)


def save_inference(results: DataFrame, base: str, method: str, fmt: str = "parquet") -> str:
    """Inference by method and placebo tag."""
    tagged = results.withColumn("method", F.lit(method))
    return _save(tagged, f"{base}/inference", ["method", "placebo"], fmt)


def save_weights(weights: DataFrame, base: str, fmt: str = "parquet") -> str:
    """Weights by placebo tag."""
    return _save(weights, f"{base}/weights", ["placebo"], fmt)
