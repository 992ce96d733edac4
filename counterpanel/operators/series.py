"""Synthetic and gap series from any weights table, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counterfactual(packed: DataFrame, weights: DataFrame) -> DataFrame:
    """Observed, synthetic and gap value per study, fit and period (centred).

    The treated unit enters with coefficient one beside the weighted donors, so
    a single join and a single reduction give both series.
    """
    donors = weights.filter(F.col("w") != 0).select(
        "study_id", "fit_id", "batch_id", "unit", F.lit(0.0).alias("own"), "w"
    )
    treated = (
        weights.select("study_id", "fit_id", "batch_id", F.col("treated").alias("unit"))
        .distinct()
        .select("study_id", "fit_id", "batch_id", "unit", F.lit(1.0).alias("own"), F.lit(0.0).alias("w"))
    )
    return (
        donors.unionByName(treated)
        .join(packed.select("batch_id", "unit", "T0", "T1", "xs"), ["batch_id", "unit"])
        .select("study_id", "fit_id", "T0", "T1", "own", "w", F.posexplode("xs").alias("pos", "x"))
        .groupBy("study_id", "fit_id", "pos")
        .agg(
            F.sum(F.col("own") * F.col("x")).alias("obs_c"),
            F.sum(F.col("w") * F.col("x")).alias("synth_c"),
            F.first("T0").alias("T0"),
            F.first("T1").alias("T1"),
        )
        .select(
            "study_id",
            "fit_id",
            (F.col("pos") + 1).alias("period_idx"),
            "T0",
            "T1",
            "obs_c",
            "synth_c",
            (F.col("obs_c") - F.col("synth_c")).alias("diff"),
        )
    )


def dated_series(
    study: DataFrame, periods: DataFrame, paths: DataFrame, ci: DataFrame | None = None
) -> DataFrame:
    """Series table of the main fit, on its dates and in the original level.

    ``ci`` (study_id, period_idx, lower_ci, upper_ci, ci_status) is NULL-extended
    to the pre periods; without it the bounds and their status are NULL.
    """
    levels = periods.select("batch_id", "period_idx", "t", "level")
    tags = study.select("study_id", "batch_id", "outcome", "treated", "placebo", "treatment_date")
    rows = (
        paths.filter(F.col("fit_id") == "main")
        .join(tags, "study_id")
        .join(levels, ["batch_id", "period_idx"])
    )
    if ci is None:
        none = F.lit(None)
        rows = rows.withColumns(
            {"upper_ci": none.cast("double"), "lower_ci": none.cast("double"), "ci_status": none.cast("string")}
        )
    else:
        rows = rows.join(
            ci.select("study_id", "period_idx", "lower_ci", "upper_ci", "ci_status"),
            ["study_id", "period_idx"],
            "left",
        )
    return rows.select(
        F.col("t").alias("date"),
        (F.col("obs_c") + F.col("level")).alias("obs"),
        (F.col("synth_c") + F.col("level")).alias("synth"),
        "diff",
        "upper_ci",
        "lower_ci",
        "ci_status",
        "T0",
        "outcome",
        "treated",
        "placebo",
        "treatment_date",
    )


def gap_summary(paths: DataFrame) -> DataFrame:
    """Mean gap before, mean / min / max gap after treatment, and the pre-period
    root mean squared error of the main fit."""
    post = F.col("period_idx") > F.col("T0")
    gap = F.col("diff")
    return (
        paths.filter(F.col("fit_id") == "main")
        .groupBy("study_id")
        .agg(
            F.first("T0").alias("T0"),
            F.first("T1").alias("T1"),
            F.avg(F.when(~post, gap)).alias("mean_pre"),
            F.avg(F.when(post, gap)).alias("mean_post"),
            F.min(F.when(post, gap)).alias("min_post"),
            F.max(F.when(post, gap)).alias("max_post"),
            F.sqrt(F.avg(F.when(~post, gap * gap))).alias("pre_rmspe"),
        )
    )
