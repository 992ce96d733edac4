"""Year-on-year rates of a stored or computed series table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpanel.functions.scalars import pct_change


def year_on_year(
    series: DataFrame,
    outcomes: list[str],
    treatment_date: str | None = None,
    horizon_months: int = 12,
) -> DataFrame:
    """Observed and synthetic rates, and their difference.

    Every study has its own treatment date, in the column ``treatment_date`` of the
    series; a date given here holds for all of them instead.

    Up to and at the treatment date the synthetic rate is the observed one;
    after it the synthetic level is compared with the *observed* level a year
    before. Rows end ``horizon_months`` after treatment, so that base is never
    later than the treatment date. The base is found by date, not by counting
    rows, so a gap in a series gives NULL instead of a wrong base.
    """
    if treatment_date is not None:
        series = series.withColumn("treatment_date", F.lit(treatment_date).cast("date"))
    start = F.col("treatment_date")
    kept = series.filter(
        F.col("outcome").isin(outcomes) & (F.col("date") <= F.add_months(start, horizon_months))
    )
    keys = ["outcome", "treated", "placebo", "treatment_date"]
    base = kept.select(*keys, F.add_months("date", 12).alias("date"), F.col("obs").alias("base"))
    joined = kept.join(base, [*keys, "date"], "left")
    observed = pct_change(F.col("obs"), F.col("base"))
    synthetic = F.when(F.col("date") > start, pct_change(F.col("synth"), F.col("base"))).otherwise(observed)
    return joined.select(
        "date",
        observed.alias("obs_rate"),
        synthetic.alias("synth_rate"),
        (observed - synthetic).alias("gaps_rate"),
        "outcome",
        "treated",
        "placebo",
        "treatment_date",
    )
