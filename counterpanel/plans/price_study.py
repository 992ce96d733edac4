"""The two-country price study: CSV panels in, all result tables out.

Reads a monthly day-ahead price panel and a monthly price-index panel, estimates
the real run and the in-time placebos for two treated countries and four
outcomes, and derives the year-on-year rates and the report frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpanel.operators import panel as shaping, rates, report
from counterpanel.plans.estimate import StudyResult, estimate
from counterpanel.sources import tables as src

# Fixed values of the study.
TREATED = ("ES", "PT")
CONTROLS = (
    "AT", "BE", "BG", "CZ", "DE", "DK", "EE", "EL", "FI", "HR", "HU", "IE",
    "IT", "LT", "LU", "LV", "NL", "NO", "PL", "RO", "SE", "SI", "SK",
)
PRICE = "DAP"
INDEX_OUTCOMES = ("NRG", "xNRG", "CP00")
CODES = {"TOT_X_NRG": "xNRG", "NNRG_IGD": "IGDxNRG"}
INDEX_START, TREATMENT, INDEX_END = "2013-06-01", "2022-06-01", "2023-12-01"
PLACEBO_SHIFT, PLACEBO_POST = 48, 19
LABELS = (("ES", "Spain", "ES", "SC_es"), ("PT", "Portugal", "PT", "SC_pt"))


@dataclass(frozen=True)
class PriceStudy:
    result: StudyResult
    rates: DataFrame
    frame: DataFrame


def price_panel(
    spark: SparkSession,
    price_path: str,
    index_path: str,
    index_builder: Callable[[SparkSession], DataFrame] | None = None,
) -> DataFrame:
    """Both sources as one long panel. With ``index_builder`` the index table is
    built at ``index_path`` if it is not there yet."""
    prices = src.read_table(spark, price_path, src.PRICE_SCHEMA)
    if index_builder is None:
        index = src.read_table(spark, index_path, src.INDEX_SCHEMA)
    else:
        index = src.load_or_build(spark, index_path, index_builder)
    index = index.withColumn("coicop", shaping.recode(F.col("coicop"), CODES))
    return shaping.union_panels(
        shaping.project_panel(prices, "country", "date", "DAP", F.lit(PRICE)),
        shaping.project_panel(index, "geo", "TIME_PERIOD", "values", "coicop"),
    )


def study_outcomes(spark: SparkSession, outcomes: tuple[str, ...]) -> DataFrame:
    """Requested outcomes with their dates; only index outcomes are ranged."""
    rows = [
        (o, TREATMENT, None, None) if o == PRICE else (o, TREATMENT, INDEX_START, INDEX_END)
        for o in outcomes
    ]
    text = spark.createDataFrame(
        rows, "outcome string, treatment_date string, start_date string, end_date string"
    )
    return text.select("outcome", *[F.col(c).cast("date").alias(c) for c in text.columns[1:]])


def run_price_study(
    panel: DataFrame,
    outcomes: tuple[str, ...] = (PRICE, *INDEX_OUTCOMES),
    infer_method: str = "ttest",
    compute_ci: bool = True,
    step: float = 0.1,
    shifts: tuple[int, ...] = (0, PLACEBO_SHIFT),
) -> PriceStudy:
    """Real run and placebos in one pass, with rates and report frames."""
    spark = panel.sparkSession
    result = estimate(
        panel,
        TREATED,
        CONTROLS,
        study_outcomes(spark, outcomes),
        shifts=shifts,
        t1_cap=PLACEBO_POST,
        infer_method=infer_method,
        compute_ci=compute_ci,
        step=step,
        whole_series_outcomes=(PRICE,),
    )
    real = result.series.filter(F.col("placebo") == "FALSE")
    indexed = [o for o in outcomes if o != PRICE]
    labels = spark.createDataFrame(LABELS, "unit string, label string, obs_key string, synth_key string")
    return PriceStudy(
        result=result,
        rates=rates.year_on_year(real, indexed, TREATMENT),
        frame=report.report_frame(real, labels, with_ci=compute_ci),
    )
