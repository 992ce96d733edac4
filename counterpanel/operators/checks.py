"""Data checks: each returns the offending rows, never a truncated sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpanel.functions.scalars import present

SERIES_COLUMNS = ("date", "outcome", "obs", "synth", "diff", "treated")
CI_COLUMNS = ("upper_ci", "lower_ci")


def check_studies(requested: DataFrame, max_shift: int = 70) -> DataFrame:
    """Add ``reason``: NULL for a usable placebo shift, else why it is not.

    A shift is a whole number of periods in ``0..max_shift``.
    """
    shift = F.col("placebo_shift").cast("double")
    bad = shift.isNull() | F.isnan(shift) | (shift != F.floor(shift))
    outside = (shift < 0) | (shift > max_shift)
    return requested.withColumn(
        "reason",
        F.when(bad, F.lit("shift_not_integer")).when(outside, F.lit("shift_out_of_range")),
    )


def unsupported_outcomes(requested: DataFrame, panel: DataFrame) -> DataFrame:
    """Requested outcomes absent from the panel, with the list of those present."""
    known = panel.select("outcome").distinct()
    missing = requested.select("outcome").distinct().join(known, "outcome", "left_anti")
    supported = known.groupBy(F.lit(1).alias("one")).agg(
        F.concat_ws(", ", F.sort_array(F.collect_set("outcome"))).alias("supported")
    )
    return (
        missing.withColumn("one", F.lit(1))
        .join(supported, "one", "left")
        .select("outcome", F.coalesce("supported", F.lit("")).alias("supported"))
    )


def unsupported_message(outcomes: list[str], supported: str) -> str:
    """Error text for outcomes that the panel does not hold."""
    kind = "Outcome" if len(outcomes) == 1 else "Outcomes"
    return f"{kind} not in the panel: {', '.join(outcomes)}. It holds: {supported}"


def require_columns(df: DataFrame, required: tuple[str, ...], note: str = "") -> None:
    """Raise if a required column is missing (schema only, no job)."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns{note}: {', '.join(missing)}")


def all_null_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: how many usable values, and whether there are none."""
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    usable = [F.nanvl(F.col(c), F.lit(None).cast("double")) if c in floating else F.col(c) for c in columns]
    counts = df.agg(*[F.count(value).alias(c) for c, value in zip(columns, usable)])
    return counts.unpivot([], columns, "column_name", "n_values").select(
        "column_name", "n_values", (F.col("n_values") == 0).alias("all_null")
    )


def has_value(df: DataFrame, column: str, value: str) -> bool:
    """Whether a value occurs in a column; stops at the first hit."""
    return not df.filter(F.col(column) == value).limit(1).isEmpty()


def duplicate_panel_keys(panel: DataFrame) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return (
        panel.groupBy("outcome", "unit", "t")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter("n_rows > 1")
    )


def incomplete_units(panel: DataFrame) -> DataFrame:
    """(outcome, unit) pairs with at least one missing value anywhere."""
    return panel.filter(~present(F.col("y"))).select("outcome", "unit").distinct()
