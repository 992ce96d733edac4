"""Panels, roles and study requests built from the star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpanel.functions.session import written_table
from counterpanel.operators import fit, series, study as st, wide
from counterpanel.operators.panel import union_panels

TREATED = ("NATION_10", "NATION_19")
PAIR = ("NATION_2", "NATION_4")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value: str) -> Column:
    """Two-decimal amount as an exact integer, so sums do not depend on order."""
    return F.round(F.col(value) * 100).cast("long")


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return orders.join(
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")),
        F.col("o_custkey") == F.col("c_custkey"),
    )


def _revenue(rows: DataFrame, outcome: Column, grain: str) -> DataFrame:
    """Revenue in millions by outcome, nation and period."""
    return (
        rows.groupBy(
            outcome.alias("outcome"),
            F.col("n_name").alias("unit"),
            F.trunc("o_orderdate", grain).alias("t"),
        )
        .agg(F.sum(cents("o_totalprice")).alias("cents"))
        .select("outcome", "unit", "t", (F.col("cents") / F.lit(1e8)).alias("y"))
    )


def quarterly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and quarter: one outcome per order priority, and 'all'."""
    by_priority = _revenue(orders_by_nation(spark, sf_dir), F.col("o_orderpriority"), "quarter")
    total = (
        by_priority.groupBy("unit", "t")
        .agg((F.sum(F.round(F.col("y") * F.lit(1e8)).cast("long")) / F.lit(1e8)).alias("y"))
        .select(F.lit("all").alias("outcome"), "unit", "t", "y")
    )
    return union_panels(by_priority, total)


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and month of all orders."""
    return _revenue(orders_by_nation(spark, sf_dir), F.lit("all"), "month")


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value by type, user group and day; the unit is user_id modulo 20."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("outcome"),
            F.concat(F.lit("G"), (F.col("user_id") % 20).cast("string")).alias("unit"),
            F.to_date("ts").alias("t"),
        )
        .agg(F.sum(cents("value")).alias("cents"))
        .select("outcome", "unit", "t", (F.col("cents") / F.lit(1e4)).alias("y"))
    )


def nation_roles(spark: SparkSession, sf_dir: str, donors: tuple[str, ...] | None = None) -> DataFrame:
    """Role of every nation; ``donors`` narrows the controls."""
    roles = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("unit"),
        F.when(F.col("n_name").isin(*TREATED), F.lit("treated")).otherwise(F.lit("control")).alias("role"),
    )
    if donors:
        roles = roles.filter(F.col("unit").isin(*TREATED, *donors))
    return roles


LAST_DAY = {"month": "2001-07-31"}  # the month after it has a single day


@dataclass
class Setup:
    """One panel with its studies; each step is built when first asked for."""

    spark: SparkSession
    sf_dir: str
    kind: str = "quarter"
    donors: tuple[str, ...] | None = None
    shifts: tuple[int, ...] = (0,)
    treatment: str = field(init=False)

    def __post_init__(self) -> None:
        self.treatment = {"quarter": "2000-01-01", "month": "1999-01-01", "day": "2024-01-21"}[self.kind]

    @cached_property
    def panel(self) -> DataFrame:
        build = {"quarter": quarterly_panel, "month": monthly_panel, "day": daily_panel}[self.kind]
        return written_table(build(self.spark, self.sf_dir), "panel")

    @cached_property
    def roles(self) -> DataFrame:
        if self.kind != "day":
            return nation_roles(self.spark, self.sf_dir, self.donors)
        role = F.when(F.col("unit").isin("G2", "G6"), "treated").otherwise("control")
        return self.panel.select("unit").distinct().select("unit", role.alias("role"))

    @cached_property
    def treated(self) -> tuple[str, ...]:
        return TREATED if self.kind != "day" else ("G2", "G6")

    @cached_property
    def outcomes(self) -> DataFrame:
        return self.panel.select("outcome").distinct().select(
            "outcome",
            F.lit(self.treatment).cast("date").alias("treatment_date"),
            F.lit(None).cast("date").alias("start_date"),
            F.lit(LAST_DAY.get(self.kind)).cast("date").alias("end_date"),
        )

    @cached_property
    def pool(self) -> DataFrame:
        return st.with_roles(self.panel, self.roles)

    @cached_property
    def calendar(self) -> DataFrame:
        return written_table(st.control_calendar(self.pool), "calendar")

    @cached_property
    def requested(self) -> DataFrame:
        return written_table(
            st.expand_studies(self.outcomes, self.treated, self.shifts, self.kind), "requested"
        )

    @cached_property
    def periods(self) -> DataFrame:
        return written_table(st.study_periods(self.calendar, self.requested), "periods")

    @cached_property
    def units(self) -> DataFrame:
        return written_table(st.unit_series(self.pool, self.calendar), "units")

    @cached_property
    def packed(self) -> DataFrame:
        return st.pack_series(self.units, self.periods)

    @cached_property
    def status(self) -> DataFrame:
        return written_table(
            st.study_status(self.pool, self.requested, self.calendar, self.periods, self.packed), "status"
        )

    @cached_property
    def study(self) -> DataFrame:
        return self.status.filter("reason IS NULL")

    def weights(self, *fits: str, theta0: float = 0.0) -> DataFrame:
        return wide.fit_weights(self.study, self.packed, fits, theta0=theta0)

    def uniform(self, *fits: str) -> DataFrame:
        return fit.uniform_weights(self.study, self.packed, fits)

    def paths(self, weights: DataFrame) -> DataFrame:
        return series.counterfactual(self.packed, weights)

    def tagged(self, df: DataFrame) -> DataFrame:
        """Replace the study key by its readable tags."""
        tags = self.study.select("study_id", "outcome", "treated", "placebo")
        return df.drop("outcome", "treated", "placebo").join(tags, "study_id").drop("study_id", "batch_id")
