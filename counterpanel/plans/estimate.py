"""The whole analysis as one call: every study of a request, in one set of jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpanel.functions.scalars import step_decimals
from counterpanel.functions.session import written_table
from counterpanel.operators import bands, checks, fit, inference, panel as shaping, series, study as st, wide
from counterpanel.sources import sinks, versions


@dataclass(frozen=True)
class StudyResult:
    """Result tables of all studies; saving them is a separate step."""

    series: DataFrame
    inference: DataFrame
    weights: DataFrame
    bands: DataFrame | None
    rejected: DataFrame
    method: str
    step: float | None

    def save(self, base: str, fmt: str = "parquet") -> dict[str, str]:
        return {
            "series": sinks.save_series(self.series, base, self.step, fmt),
            "inference": sinks.save_inference(self.inference, base, self.method, fmt),
            "weights": sinks.save_weights(self.weights, base, fmt),
        }

    def save_version(self, base: str, fmt: str = "parquet") -> str:
        """All tables, bands and rejected studies too, as one version: readers see
        every table of it or none (``versions.read_version``). Returns its name."""
        tables = {
            "series": (versions.tagged(self.series, ci_step=self.step), ["placebo"]),
            "inference": (versions.tagged(self.inference, method=self.method), ["placebo"]),
            "weights": (self.weights, ["placebo"]),
            "rejected": (self.rejected, []),
        }
        if self.bands is not None:
            tables["bands"] = (self.bands, [])
        return versions.commit_version(self.series.sparkSession, base, tables, fmt)


def unit_roles(
    panel: DataFrame, treated: Sequence[str] | DataFrame, controls: Sequence[str] | DataFrame
) -> DataFrame:
    """(unit, role) rows; either side is a list, or a DataFrame for many units."""
    spark = panel.sparkSession
    if not isinstance(controls, DataFrame):
        controls = spark.createDataFrame([(u,) for u in controls], "unit string")
    if not isinstance(treated, DataFrame):
        treated = spark.createDataFrame([(u,) for u in treated], "unit string")
    own = treated.select("unit").distinct()
    pool = controls.select("unit").distinct().join(own, "unit", "left_anti")
    return pool.select("unit", F.lit("control").alias("role")).unionByName(
        own.select("unit", F.lit("treated").alias("role"))
    )


def requested_rows(panel: DataFrame, outcomes: DataFrame, whole_series: Sequence[str] = ()) -> DataFrame:
    """Panel rows that some study of the request can use.

    The request is the small side of a join on the outcome, with the earliest start
    and the latest end of the outcome's studies; a panel stored by outcome is read
    for these outcomes only. Outcomes in ``whole_series`` keep all their dates.
    """
    start, end = F.min(F.coalesce("start_date", F.lit("0001-01-01").cast("date"))), F.max(F.coalesce("end_date", F.lit("9999-12-31").cast("date")))
    whole = F.col("wanted").isin(list(whole_series))
    spans = outcomes.groupBy(F.col("outcome").alias("wanted")).agg(start.alias("first_t"), end.alias("last_t"))
    spans = written_table(spans, "requested")
    # a row without a date is in no window, and is kept where whole series are judged
    inside = whole | F.col("t").between(F.col("first_t"), F.col("last_t"))
    # true of every name; pruning at run time is planned for a filtered side only
    wanted = spans.filter("wanted >= ''")
    return panel.join(wanted, (F.col("outcome") == F.col("wanted")) & inside).select(*panel.columns)


def _require_supported(outcomes: DataFrame, calendar: DataFrame, panel: DataFrame) -> None:
    """Raise for outcomes the panel does not hold. The panel is read again only
    if an outcome is missing from the calendar of the controls."""
    absent = outcomes.select("outcome").join(calendar, "outcome", "left_anti")
    if absent.isEmpty():
        return
    # requested outcomes only, so no more rows than the request has
    unknown = checks.unsupported_outcomes(absent, panel).collect()
    if unknown:
        names = [r["outcome"] for r in unknown]
        raise ValueError(checks.unsupported_message(names, unknown[0]["supported"]))


def estimate(
    panel: DataFrame,
    treated: Sequence[str] | DataFrame,
    controls: Sequence[str] | DataFrame,
    outcomes: DataFrame,
    *,
    shifts: Sequence[int] = (0,),
    grain: str = "month",
    t1_cap: int | None = None,
    max_shift: int = 70,
    infer_method: str = "ttest",
    compute_ci: bool = False,
    step: float = 0.1,
    alpha: float = 0.1,
    folds: int = 2,
    fold_anchor: str = "end",
    theta0: float = 0.0,
    permutation: str = "block",
    n_perm: int = 5000,
    seed: int = 61876,
    whole_series_outcomes: Sequence[str] = (),
    check_keys: bool = True,
    max_pool: int = wide.MAX_POOL,
) -> StudyResult:
    """Estimate every (outcome, treated unit, treatment date, placebo shift).

    ``treated`` and ``controls`` are lists of units, or DataFrames with a ``unit``
    column. Only rows of requested outcomes and dates are read on. ``outcomes`` has ``outcome, treatment_date, start_date, end_date``. For an
    outcome in ``whole_series_outcomes`` a unit with a missing value anywhere is
    dropped; otherwise only gaps inside the study window count. ``check_keys``
    counts rows per key before any series is gathered; a panel that comes out of
    a grouping can skip that shuffle.
    """
    if infer_method not in ("ttest", "conformal"):
        raise ValueError("infer_method must be 'ttest' or 'conformal'")
    if compute_ci:
        step_decimals(step)
    bad = [s for s in shifts if s != int(s) or not 0 <= s <= max_shift]
    if bad:
        raise ValueError(f"placebo shifts must be integers between 0 and {max_shift}: {bad}")

    if isinstance(treated, DataFrame):
        treated = written_table(treated.select("unit").distinct(), "treated")
    given = requested_rows(panel.select(*shaping.PANEL_COLUMNS), outcomes, whole_series_outcomes)
    pool = st.with_roles(given, unit_roles(panel, treated, controls))
    if whole_series_outcomes:
        whole = F.col("outcome").isin(list(whole_series_outcomes))
        pool = shaping.drop_units_with_nulls(pool.filter(whole)).unionByName(pool.filter(~whole))
    pool = written_table(pool, "pool")
    repeated = "panel keys (outcome, unit, t) are not unique"
    if check_keys and not checks.duplicate_panel_keys(pool).isEmpty():
        raise ValueError(repeated)
    requested = st.expand_studies(outcomes, treated, shifts, grain, t1_cap)
    calendar = written_table(st.control_calendar(pool), "calendar")
    _require_supported(outcomes, calendar, panel)
    periods = written_table(st.study_periods(calendar, requested), "periods")
    units = written_table(st.unit_series(pool, calendar), "units")
    if not units.filter("repeated").isEmpty():
        raise ValueError(repeated)
    # a view of the stored series: windows are cut out where they are read
    packed = st.pack_series(units, periods)
    status = written_table(
        st.study_status(pool, requested, calendar, periods, packed, max(2, folds)), "status"
    )
    study = status.filter("reason IS NULL")
    fits = ("main", "folds") if infer_method == "ttest" else ("main", "full")
    weights = written_table(
        wide.fit_weights(study, packed, fits, folds, fold_anchor, theta0, max_pool), "weights"
    )
    paths = written_table(series.counterfactual(packed, weights), "paths")

    if infer_method == "ttest":
        tested = inference.cross_fit_ttest(paths, folds, fold_anchor, alpha)
    elif permutation == "block":
        tested = inference.conformal_block(paths, theta0, alpha)
    else:
        tested = inference.conformal_iid(paths, n_perm, seed, theta0, alpha)
    intervals = None
    if compute_ci:
        grid = bands.grid_seed(series.gap_summary(paths), step)
        intervals = written_table(
            bands.confidence_bands(study, packed, grid, step, alpha, max_pool=max_pool),
            "bands",
        )
    return StudyResult(
        series=series.dated_series(study, periods, paths, intervals),
        inference=inference.inference_table(study, tested),
        weights=fit.weights_table(study, packed, weights),
        bands=intervals,
        rejected=status.filter("reason IS NOT NULL"),
        method=infer_method,
        step=step if compute_ci else None,
    )
