"""Report tables: the long frame behind the figures, markers and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpanel.operators.checks import CI_COLUMNS, SERIES_COLUMNS, all_null_columns, has_value, require_columns

# fixed values: the three line kinds in drawing order
LINES = ("Observed", "Synthetic", "Difference")


def check_report_input(series: DataFrame, outcome: str, with_ci: bool) -> None:
    """Raise for missing columns, an unknown outcome or empty CI columns."""
    require_columns(series, SERIES_COLUMNS)
    if with_ci:
        require_columns(series, CI_COLUMNS, " for bounds")
        if not all_null_columns(series, list(CI_COLUMNS)).filter("all_null").isEmpty():
            raise ValueError("a bound column holds no value; use with_ci=False")
    if not has_value(series, "outcome", outcome):
        raise ValueError(f"outcome {outcome!r} does not occur in the series")


def report_frame(series: DataFrame, labels: DataFrame, with_ci: bool = True) -> DataFrame:
    """Observed, synthetic and gap values as one long table.

    ``labels`` is ``unit, label, obs_key, synth_key``. The gap has its own
    subplot and is the only line with bounds. ``color_ord`` and ``subplot_ord``
    give the display order.
    """
    no_ci = F.lit(None).cast("double")

    def line(name: str, value: str, subplot, color, upper, lower, order) -> Column:
        return F.struct(
            F.col(value).alias("value"),
            upper.alias("upper_ci"),
            lower.alias("lower_ci"),
            F.lit(name).alias("series"),
            subplot.alias("subplot"),
            color.alias("color"),
            F.lit(order).alias("color_ord"),
        )

    upper, lower = (F.col("upper_ci"), F.col("lower_ci")) if with_ci else (no_ci, no_ci)
    lines = F.array(
        line("Observed", "obs", F.col("outcome"), F.col("obs_key"), no_ci, no_ci, 1),
        line("Synthetic", "synth", F.col("outcome"), F.col("synth_key"), no_ci, no_ci, 2),
        line("Difference", "diff", F.lit("Difference"), F.lit("Gap"), upper, lower, 3),
    )
    return (
        series.join(labels, series["treated"] == labels["unit"], "left")
        .select("date", "outcome", "treated", "placebo", F.coalesce("label", "treated").alias("country"), F.explode(lines).alias("line"))
        .select(
            "date",
            "line.value",
            "line.upper_ci",
            "line.lower_ci",
            "line.series",
            "line.subplot",
            "country",
            "line.color",
            "line.color_ord",
            F.when(F.col("line.subplot") == "Difference", 2).otherwise(1).alias("subplot_ord"),
            "outcome",
            "treated",
            "placebo",
        )
    )


def treatment_marker(series: DataFrame, study: DataFrame, grain_months: int = 1) -> DataFrame:
    """Treatment date as first date plus T0 periods, beside the study's own."""
    first = series.groupBy("outcome", "treated", "placebo").agg(
        F.add_months(F.min("date"), F.first("T0") * F.lit(grain_months)).alias("marker")
    )
    own = study.select("outcome", "treated", "placebo", "treatment_date")
    return first.join(own, ["outcome", "treated", "placebo"])


def ci_band(frame: DataFrame, markers: DataFrame) -> DataFrame:
    """Gap rows from the treatment date on, with their bounds."""
    keys = ["outcome", "treated", "placebo"]
    return (
        frame.filter(F.col("series") == "Difference")
        .join(markers.select(*keys, "treatment_date"), keys)
        .filter(F.col("date") >= F.col("treatment_date"))
        .select("date", "lower_ci", "upper_ci", "country", *keys)
    )


def zero_lines(frame: DataFrame) -> DataFrame:
    """Two constant reference rows at zero for the gap subplot of each outcome."""
    gaps = frame.filter(F.col("subplot") == "Difference").select("outcome", "subplot", "subplot_ord")
    return gaps.distinct().select(
        "outcome", F.explode(F.array(F.lit(0.0), F.lit(0.0))).alias("value"), "subplot", "subplot_ord"
    )
