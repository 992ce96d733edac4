"""Shaping of long panels (outcome, unit, t, y)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpanel.functions.scalars import in_window, member
from counterpanel.operators.checks import incomplete_units

PANEL_COLUMNS = ("outcome", "unit", "t", "y")


def project_panel(
    df: DataFrame, unit: str, t: str, y: str, outcome: str | Column
) -> DataFrame:
    """Rename source columns to the panel layout; NaN becomes NULL.

    ``outcome`` is a column name, or a literal column for one-outcome sources.
    """
    value = F.col(y).cast("double")
    return df.select(
        (F.col(outcome) if isinstance(outcome, str) else outcome).alias("outcome"),
        F.col(unit).cast("string").alias("unit"),
        F.to_date(F.col(t)).alias("t"),
        F.when(~F.isnan(value), value).alias("y"),
    )


def union_panels(*panels: DataFrame) -> DataFrame:
    """One long panel from several sources; ``outcome`` routes each study."""
    return union_results(*[p.select(*PANEL_COLUMNS) for p in panels])


def union_results(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def recode(value: Column, codes: dict[str, str]) -> Column:
    """Rename the listed codes, keep every other value."""
    renamed = reduce(
        lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), codes.items(), F
    )
    return renamed.otherwise(value) if codes else value


def keep_pool(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows of units with a role."""
    return panel.join(roles.select("unit"), "unit", "left_semi").select(*panel.columns)


def keep_outcomes(panel: DataFrame, outcomes: list[str]) -> DataFrame:
    """Rows of the listed outcomes."""
    return panel.filter(member(F.col("outcome"), outcomes))


def keep_dates(panel: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows in a closed date range; a NULL bound is open."""
    return panel.filter(in_window(F.col("t"), start, end))


def drop_units_with_nulls(panel: DataFrame) -> DataFrame:
    """Drop whole (outcome, unit) groups that hold any missing value.

    The offending keys are few, so this is a reduction plus an anti join rather
    than a window that would put all rows of a hot unit into one task.
    """
    return panel.join(incomplete_units(panel), ["outcome", "unit"], "left_anti").select(
        *panel.columns
    )


def densify(panel: DataFrame) -> DataFrame:
    """Every (unit, date) cell of each outcome; absent cells get a NULL value.

    The dates of an outcome are a calendar, hence a short array that is carried
    by each unit and exploded.
    """
    dates = panel.groupBy("outcome").agg(F.collect_set("t").alias("dates"))
    units = panel.select("outcome", "unit").distinct()
    grid = units.join(dates, "outcome").select("outcome", "unit", F.explode("dates").alias("t"))
    return grid.join(panel, ["outcome", "unit", "t"], "left").select(*PANEL_COLUMNS)


def pivot_outcomes(panel: DataFrame, outcomes: list[str]) -> DataFrame:
    """One column per listed outcome, one row per (date, unit)."""
    return panel.groupBy("t", "unit").pivot("outcome", outcomes).agg(F.first("y"))


def pivot_units(panel: DataFrame, units: list[str], max_units: int = 1000) -> DataFrame:
    """The period x unit matrix as a table, for the listed units."""
    if len(units) > max_units:
        raise ValueError(f"{len(units)} columns asked for, at most {max_units} allowed")
    return panel.groupBy("outcome", "t").pivot("unit", units).agg(F.first("y"))
