"""Studies, their windows, and the complete series they may use.

A *study* is one (outcome, treated unit, placebo shift). Studies with the same
outcome, dates and shift see the same periods and the same donors, so those are
worked out once per *batch* of such studies. ``t`` is a DATE: the periods of a
batch are bounded by the calendar, whatever the size of the panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpanel.functions.scalars import (
    in_window,
    is_post,
    joined_key,
    placebo_tag,
    present,
    shift_back,
)

BATCH_COLUMNS = (
    "batch_id",
    "outcome",
    "start_date",
    "end_date",
    "base_treatment_date",
    "treatment_date",
    "placebo_shift",
    "t1_cap",
)


def expand_studies(
    outcomes: DataFrame,
    treated: Sequence[str] | DataFrame,
    shifts: Sequence[int] = (0,),
    grain: str = "month",
    t1_cap: int | None = None,
    treated_per_batch: int = 64,
) -> DataFrame:
    """One row per outcome x treated unit x placebo shift.

    ``outcomes`` has ``outcome, treatment_date, start_date, end_date`` (bounds
    nullable). ``t1_cap`` limits the post window of placebo studies; NULL means
    the length of the real post window. ``treated`` is a list, or a DataFrame with a
    ``unit`` column: the units are then rows, counted for the batches, and the plan
    does not grow with them (the request's outcomes do stand in it).
    """
    dated = outcomes.select("outcome", *[F.col(c).cast("date").alias(c) for c in ("start_date", "end_date", "treatment_date")])
    if isinstance(treated, DataFrame):
        units = treated.select(F.col("unit").alias("treated")).distinct()
        buckets = max(1, -(-units.count() // treated_per_batch))
        asked = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for (c, t), v in zip(dated.dtypes, row)]) for row in dated.collect()])
        requested = units.withColumn("o", F.explode(asked)).select("o.*", "treated")
    else:
        buckets = -(-len(treated) // treated_per_batch)
        requested = dated.withColumn("treated", F.explode(F.array(*[F.lit(u) for u in treated])))
    study = (
        requested.select(
            "outcome", "start_date", "end_date", F.col("treatment_date").alias("base_treatment_date"), "treated"
        )
        .select("*", F.explode(F.array(*[F.lit(int(s)) for s in shifts])).alias("placebo_shift"))
        .withColumn(
            "treatment_date", shift_back(F.col("base_treatment_date"), F.col("placebo_shift"), grain)
        )
        .withColumn("t1_cap", F.lit(t1_cap).cast("int"))
        .withColumn("placebo", placebo_tag(F.col("placebo_shift")))
    )
    window = [F.col(c) for c in ("outcome", "base_treatment_date", "placebo_shift", "start_date", "end_date")]
    bucket = F.pmod(F.xxhash64("treated"), F.lit(buckets))
    return study.withColumn("batch_id", joined_key(*window, bucket)).withColumn(
        "study_id", joined_key(*window, F.col("treated"))
    )


def with_roles(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """Panel rows of units in the pool, with their role."""
    return panel.join(roles.select("unit", "role"), "unit").select("outcome", "unit", "role", "t", "y")


def exclude_other_treated(pool: DataFrame, study: DataFrame) -> DataFrame:
    """Pool rows each study may use: its own unit and every control.

    Any other treated unit is dropped, for any number of treated units.
    """
    return (
        study.select("study_id", "outcome", "treated")
        .join(pool, "outcome")
        .filter((F.col("role") == "control") | (F.col("unit") == F.col("treated")))
        .select("study_id", "outcome", "treated", "unit", "role", "t", "y")
    )


def control_calendar(pool: DataFrame) -> DataFrame:
    """Dates of each outcome at which a control was seen, numbered in order.

    ``level`` is the mean over controls at a date. Weights sum to one, so taking
    it off every series leaves all gaps unchanged and conditions the fit.
    """
    order = Window.partitionBy("outcome").orderBy("t")
    return (
        pool.filter(F.col("role") == "control")
        .groupBy("outcome", "t")
        .agg(F.coalesce(F.avg(F.when(present(F.col("y")), F.col("y"))), F.lit(0.0)).alias("level"))
        .withColumn("date_no", F.row_number().over(order))
    )


def study_periods(calendar: DataFrame, study: DataFrame) -> DataFrame:
    """Ordered study window of each batch, cut to its first T0 + T1 periods."""
    batch = study.select(*BATCH_COLUMNS).distinct()
    every = Window.partitionBy("batch_id")
    real = F.col("t") >= F.col("base_treatment_date")
    cap = F.coalesce("t1_cap", "real_post")
    return (
        batch.join(calendar, "outcome")
        .filter(in_window(F.col("t"), F.col("start_date"), F.col("end_date")))
        .withColumn("is_post", is_post(F.col("t"), F.col("treatment_date")))
        .withColumn("period_idx", F.row_number().over(every.orderBy("t")))
        .withColumn("n_post", F.count_if("is_post").over(every).cast("int"))
        .withColumn("T0", F.count_if(~F.col("is_post")).over(every).cast("int"))
        .withColumn("real_post", F.count_if(real).over(every).cast("int"))
        .withColumn(
            "T1",
            F.when(F.col("placebo_shift") == 0, F.col("n_post")).otherwise(F.least("n_post", cap)),
        )
        .filter(F.col("period_idx") <= F.col("T0") + F.col("T1"))
        .select(
            "batch_id", "outcome", "t", "date_no", "period_idx", "is_post", "T0", "T1", "n_post", "level"
        )
    )


def unit_series(pool: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per (outcome, unit): its centred values on the calendar.

    The only place where the panel itself is shuffled, however many studies,
    windows and placebo shifts read it. An array is bounded by the calendar.
    ``repeated`` marks a unit with two rows for one date.
    """
    cell = F.struct("date_no", (F.col("y") - F.col("level")).alias("x"))
    return (
        pool.join(calendar, ["outcome", "t"])
        .groupBy("outcome", "unit", "role")
        .agg(F.sort_array(F.collect_list(cell)).alias("cells"))
        .withColumn("repeated", F.size("cells") > F.size(F.array_distinct("cells.date_no")))
    )


def pack_series(units: DataFrame, periods: DataFrame) -> DataFrame:
    """Series of each batch's window, one row per unit, as centred arrays.

    A window is a run of calendar dates. A unit with a NULL or absent cell in
    it has fewer than T0 + T1 values there and is left out.
    """
    windows = periods.groupBy("batch_id", "outcome").agg(
        F.min("date_no").alias("first_no"),
        F.max("date_no").alias("last_no"),
        F.first("T0").alias("T0"),
        F.first("T1").alias("T1"),
    )
    inside = F.filter(
        "cells",
        lambda c: (c["date_no"] >= F.col("first_no"))
        & (c["date_no"] <= F.col("last_no"))
        & present(c["x"]),
    )
    return (
        units.join(windows, "outcome")
        .withColumn("inside", inside)
        .filter(F.size("inside") == F.col("T0") + F.col("T1"))
        .select("batch_id", "unit", "role", "T0", "T1", F.col("inside.x").alias("xs"))
    )


def donor_pool_size(packed: DataFrame) -> DataFrame:
    """Complete donors per batch, and which treated units are complete."""
    own = F.when(F.col("role") == "treated", F.col("unit"))
    return packed.groupBy("batch_id").agg(
        F.count_if(F.col("role") == "control").alias("n_donors"),
        F.collect_set(own).alias("complete_treated"),
    )


def study_status(
    pool: DataFrame,
    study: DataFrame,
    calendar: DataFrame,
    periods: DataFrame,
    packed: DataFrame,
    min_pre: int = 2,
) -> DataFrame:
    """Studies with window lengths, pool size and, if unusable, the reason.

    Dates at which only the treated unit was seen lengthen its window and leave
    no donor complete.
    """
    lengths = periods.groupBy("batch_id").agg(
        F.first("T0").alias("T0c"),
        F.first("T1").alias("T1c"),
        F.first("n_post").alias("n_post"),
        F.max("t").alias("last_t"),
    )
    alone = (
        pool.filter(F.col("role") == "treated")
        .select("outcome", F.col("unit").alias("treated"), "t")
        .join(calendar.select("outcome", "t"), ["outcome", "t"], "left_anti")
    )
    after = is_post(F.col("t"), F.col("treatment_date"))
    in_cap = F.col("last_t").isNull() | (F.col("t") <= F.col("last_t")) | (F.col("n_post") <= F.col("T1c"))
    lonely = (
        alone.join(study, ["outcome", "treated"])
        .filter(in_window(F.col("t"), F.col("start_date"), F.col("end_date")))
        .join(lengths, "batch_id", "left")
        .filter(in_cap)
        .groupBy("study_id")
        .agg(
            F.count_if(~after).cast("int").alias("extra_pre"),
            F.count_if(after).cast("int").alias("extra_post"),
        )
    )
    zero = F.lit(0)
    extra_pre, extra_post = F.coalesce("extra_pre", zero), F.coalesce("extra_post", zero)
    joined = (
        study.join(lengths, "batch_id", "left")
        .join(lonely, "study_id", "left")
        .join(donor_pool_size(packed), "batch_id", "left")
        .withColumn("T0", F.coalesce("T0c", zero) + extra_pre)
        .withColumn("T1", F.coalesce("T1c", zero) + extra_post)
        .withColumn("n_donors", F.when(extra_pre + extra_post > 0, 0).otherwise(F.coalesce("n_donors", F.lit(0))).cast("int"))
    )
    return joined.withColumn(
        "reason",
        F.when(F.col("T0") < min_pre, F.lit("too_few_pre_periods"))
        .when(F.col("T1") < 1, F.lit("no_post_period"))
        .when(
            ~F.coalesce(F.array_contains("complete_treated", F.col("treated")), F.lit(False)),
            F.lit("treated_incomplete"),
        )
        .when(F.col("n_donors") == 0, F.lit("no_complete_donor")),
    ).select(
        *study.columns,
        "T0",
        "T1",
        "n_donors",
        ((F.col("placebo_shift") > 0) & (F.col("placebo_shift") < F.col("T1"))).alias("overlaps_treatment"),
        "reason",
    )


def study_panel(study: DataFrame, periods: DataFrame, packed: DataFrame) -> DataFrame:
    """Assembled long panel of each study: its own series and all donors."""
    levels = periods.select("batch_id", "period_idx", "t", "is_post", "level")
    members = study.select("study_id", "batch_id", "treated", "outcome").join(packed, "batch_id")
    return (
        members.filter((F.col("role") == "control") | (F.col("unit") == F.col("treated")))
        .select("study_id", "batch_id", "outcome", "treated", "unit", "role", F.posexplode("xs").alias("pos", "x"))
        .withColumn("period_idx", F.col("pos") + 1)
        .join(levels, ["batch_id", "period_idx"])
        .select("study_id", "outcome", "treated", "unit", "role", "t", "period_idx", "is_post", (F.col("x") + F.col("level")).alias("y"))
    )
