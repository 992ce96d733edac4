"""Registered queries: each runs an operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpanel.functions import scalars as sc
from counterpanel.functions.session import shared_dir, written_table
from counterpanel.operators import (
    bands,
    checks,
    fit,
    inference,
    panel as shaping,
    rates,
    report,
    series,
    study as st,
)
from counterpanel.plans.estimate import estimate
from counterpanel.sources import sinks, tables as src, versions
from workload.panels import (
    PAIR,
    PRIORITIES,
    TREATED,
    Setup,
    nation_roles,
    orders_by_nation,
    quarterly_panel,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STEP = 0.1
N_PERM = 300
SEED = 61876
TAGS = ("outcome", "treated", "placebo")
OUTCOMES = (*PRIORITIES, "all")
NATIONS = tuple(f"NATION_{i}" for i in range(25))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def day(text: str) -> Column:
    return F.lit(text).cast("date")


# --- sources and checks ------------------------------------------------------


@query
def scan_panel(spark, sf_dir):
    """CSV scan with NA for missing cells, of a densified panel stored as CSV."""
    path = _fresh_folder(spark, "scan")
    cells = shaping.densify(quarterly_panel(spark, sf_dir))
    stored = cells.select(F.col("t").alias("date"), F.concat_ws("/", "outcome", "unit").alias("country"), F.col("y").alias("DAP"))
    stored.write.csv(path, header=True, nullValue="NA")
    return src.read_csv(spark, path, src.PRICE_SCHEMA)


@query
def check_studies(spark, sf_dir):
    requested = (
        table(spark, sf_dir, "orders")
        .select("o_orderpriority", F.trunc("o_orderdate", "month").alias("m"))
        .distinct()
        .select(
            F.col("o_orderpriority").alias("outcome"),
            (F.months_between(day("2000-01-01"), "m") * 1.5).alias("placebo_shift"),
        )
    )
    return checks.check_studies(requested, 70)


@query
def unsupported_outcomes(spark, sf_dir):
    requested = table(spark, sf_dir, "events").select(F.col("event_type").alias("outcome")).union(
        table(spark, sf_dir, "orders").select("o_orderpriority")
    )
    return checks.unsupported_outcomes(requested, quarterly_panel(spark, sf_dir))


@query
def all_null_columns(spark, sf_dir):
    df = shaping.densify(quarterly_panel(spark, sf_dir)).withColumn("none", F.when(F.col("y") < 0, F.col("y")))
    return checks.all_null_columns(df, ["y", "none", "unit"])


@query
def duplicate_panel_keys(spark, sf_dir):
    rows = orders_by_nation(spark, sf_dir).select(
        F.col("o_orderpriority").alias("outcome"), F.col("n_name").alias("unit"), F.to_date("o_orderdate").alias("t")
    )
    return checks.duplicate_panel_keys(rows)


# --- projections, predicates, scalars ---------------------------------------


@query
def recode_category(spark, sf_dir):
    codes = {"4-NOT SPECIFIED": "NOTSPEC", "1-URGENT": "URGENT"}
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", shaping.recode(F.col("o_orderpriority"), codes).alias("category")
    )


@query
def pool_membership(spark, sf_dir):
    unit = F.nullif("unit", F.lit("NATION_0"))
    return quarterly_panel(spark, sf_dir).select(
        "outcome",
        "t",
        "unit",
        sc.member(unit, [*TREATED, *PAIR, "NATION_0"]).alias("in_pool"),
        sc.member(F.col("outcome"), ["all", "5-LOW"]).alias("is_outcome"),
    )


@query
def post_flag(spark, sf_dir):
    seen = F.nullif("t", day("1995-01-01"))
    return quarterly_panel(spark, sf_dir).select(
        "outcome", "unit", "t", sc.is_post(seen, day("2000-01-01")).alias("post_treatment")
    )


@query
def date_window(spark, sf_dir):
    panel = shaping.keep_outcomes(quarterly_panel(spark, sf_dir), ["all", "5-LOW"])
    return shaping.keep_dates(panel, day("1996-04-01"), day("1998-10-01"))


@query
def exclude_other_treated(spark, sf_dir):
    s = Setup(spark, sf_dir)
    rows = st.exclude_other_treated(s.pool, s.requested)
    return rows.select("outcome", "treated", "unit", "role", "t", "y")


@query
def project_panel(spark, sf_dir):
    return shaping.project_panel(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_type")


@query
def shift_months(spark, sf_dir):
    back = (F.col("o_orderkey") % 25).cast("int")
    month_end = F.last_day("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        sc.shift_back(month_end, back).alias("months_back"),
        sc.shift_back(month_end, back, "quarter").alias("quarters_back"),
        sc.shift_back(month_end, back, "day").alias("days_back"),
    )


@query
def round_to_step(spark, sf_dir):
    return quarterly_panel(spark, sf_dir).select(
        "outcome",
        "unit",
        "t",
        sc.round_to_step(F.col("y"), sc.step_decimals(0.1)).alias("y_1"),
        sc.round_to_step(F.col("y"), sc.step_decimals(0.001)).alias("y_3"),
    )


# --- group filters, reshape, windows -----------------------------------------


@query
def drop_units_with_nulls(spark, sf_dir):
    return shaping.drop_units_with_nulls(shaping.densify(quarterly_panel(spark, sf_dir)))


@query
def densify_panel(spark, sf_dir):
    return shaping.densify(quarterly_panel(spark, sf_dir))


@query
def pivot_outcomes(spark, sf_dir):
    return shaping.pivot_outcomes(quarterly_panel(spark, sf_dir), list(OUTCOMES))


@query
def pivot_units(spark, sf_dir):
    return shaping.pivot_units(quarterly_panel(spark, sf_dir), list(NATIONS))


@query
def expand_studies(spark, sf_dir):
    s = Setup(spark, sf_dir, shifts=(0, 4, 8))
    return s.requested.select(*TAGS, "placebo_shift", "base_treatment_date", "treatment_date")


def _batch_tagged(s: Setup, df: DataFrame) -> DataFrame:
    tags = s.requested.select("batch_id", "outcome", "placebo").distinct()
    return df.drop("outcome").join(tags, "batch_id").drop("batch_id")


@query
def period_index(spark, sf_dir):
    s = Setup(spark, sf_dir, "day")
    return _batch_tagged(s, s.periods).select("outcome", "placebo", "t", "period_idx", "is_post")


@query
def study_window(spark, sf_dir):
    s = Setup(spark, sf_dir, shifts=(0, 4, 12))
    return _batch_tagged(s, s.periods).select("outcome", "placebo", "t", "period_idx", "T0", "T1")


@query
def window_lengths(spark, sf_dir):
    s = Setup(spark, sf_dir, "day", shifts=(0, 5, 12))
    return s.status.select(*TAGS, "T0", "T1", "overlaps_treatment", "reason")


@query
def placebo_windows(spark, sf_dir):
    s = Setup(spark, sf_dir, "month", shifts=(0, 12, 24))
    return s.status.select(*TAGS, "treatment_date", "T0", "T1", "n_donors", "overlaps_treatment")


@query
def complete_donors(spark, sf_dir):
    s = Setup(spark, sf_dir, shifts=(0, 4))
    return _batch_tagged(s, s.packed.filter("role = 'control'")).select("outcome", "placebo", "unit")


@query
def donor_pool_size(spark, sf_dir):
    s = Setup(spark, sf_dir, "day")
    return _batch_tagged(s, st.donor_pool_size(s.packed)).select("outcome", "placebo", "n_donors")


@query
def study_panel(spark, sf_dir):
    s = Setup(spark, sf_dir)
    rows = st.study_panel(s.study, s.periods, s.packed)
    return rounded(rows.select("outcome", "treated", "unit", "role", "t", "period_idx", "is_post", "y"), "y")


# --- counterfactuals ----------------------------------------------------------


@query
def gram_matrix(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return rounded(_batch_tagged(s, fit.gram_matrix(s.packed)), "g").select("outcome", "block", "i", "j", "g")


def pair_setup(spark, sf_dir, **kw) -> Setup:
    return Setup(spark, sf_dir, donors=PAIR, **kw)


@query
def sc_weights_two_donor(spark, sf_dir):
    s = pair_setup(spark, sf_dir)
    return rounded(fit.weights_table(s.study, s.packed, s.weights("main")), "weight")


@query
def sc_weights_certificate(spark, sf_dir):
    s = Setup(spark, sf_dir, shifts=(0, 4))
    weights = s.weights("main")
    checked = fit.optimality(s.study, s.packed, weights, s.paths(weights))
    return s.tagged(checked).select(
        *TAGS,
        (F.abs(F.col("sum_w") - 1) < 1e-9).alias("sums_to_one"),
        (F.col("min_w") >= 0).alias("non_negative"),
        (F.col("slack") > -1e-9).alias("optimal"),
    )


@query
def synthetic_series(spark, sf_dir):
    s = pair_setup(spark, sf_dir)
    table_ = series.dated_series(s.study, s.periods, s.paths(s.weights("main")))
    return rounded(table_.select("date", "synth", *TAGS), "synth")


@query
def gap_series(spark, sf_dir):
    s = pair_setup(spark, sf_dir, shifts=(0, 4))
    table_ = series.dated_series(s.study, s.periods, s.paths(s.weights("main")))
    return rounded(table_.select("date", "diff", *TAGS), "diff")


def _uniform_series(s: Setup) -> DataFrame:
    return series.dated_series(s.study, s.periods, s.paths(s.uniform("main")))


@query
def uniform_counterfactual(spark, sf_dir):
    table_ = _uniform_series(Setup(spark, sf_dir))
    return rounded(table_.select("date", "obs", "synth", "diff", "T0", *TAGS), "synth", "diff", digits=6).withColumn(
        "obs", F.round("obs", 8)
    )


@query
def gap_summary(spark, sf_dir):
    s = Setup(spark, sf_dir)
    table_ = s.tagged(series.gap_summary(s.paths(s.uniform("main"))))
    values = ("mean_pre", "mean_post", "min_post", "max_post")
    return rounded(table_.select(*TAGS, *values), *values)


@query
def pre_rmspe(spark, sf_dir):
    s = pair_setup(spark, sf_dir)
    table_ = s.tagged(series.gap_summary(s.paths(s.weights("main"))))
    return rounded(table_.select(*TAGS, "pre_rmspe"), "pre_rmspe")


# --- inference ----------------------------------------------------------------


def _ttest(s: Setup, weights: DataFrame) -> DataFrame:
    table_ = s.tagged(inference.cross_fit_ttest(s.paths(weights)))
    values = ("att", "se", "lb", "ub")
    return rounded(table_.select(*values, "T0", "significant", *TAGS), *values)


@query
def ttest_uniform(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return _ttest(s, s.uniform("fold_1", "fold_2"))


@query
def ttest_two_donor(spark, sf_dir):
    s = pair_setup(spark, sf_dir)
    return _ttest(s, s.weights("folds"))


@query
def placebo_att_uniform(spark, sf_dir):
    s = Setup(spark, sf_dir, "month", shifts=(12, 18))
    return _ttest(s, s.uniform("fold_1", "fold_2"))


@query
def placebo_att_two_donor(spark, sf_dir):
    s = pair_setup(spark, sf_dir, kind="month", shifts=(0, 12))
    return _ttest(s, s.weights("folds"))


def _pvalues(s: Setup, table_: DataFrame) -> DataFrame:
    return rounded(s.tagged(table_).select("pval", "T0", "significant", *TAGS), "pval")


@query
def conformal_block_uniform(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return _pvalues(s, inference.conformal_block(s.paths(s.uniform("full"))))


@query
def conformal_block_two_donor(spark, sf_dir):
    s = pair_setup(spark, sf_dir)
    return _pvalues(s, inference.conformal_block(s.paths(s.weights("full", theta0=0.5)), theta0=0.5))


@query
def conformal_iid_uniform(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return _pvalues(s, inference.conformal_iid(s.paths(s.uniform("full")), N_PERM, SEED))


@query
def conformal_iid_two_donor(spark, sf_dir):
    s = pair_setup(spark, sf_dir)
    return _pvalues(s, inference.conformal_iid(s.paths(s.weights("full")), N_PERM, SEED))


def _bands(s: Setup, weights: DataFrame, uniform: bool) -> DataFrame:
    """Bands by refitting, or with the equal weights held fixed."""
    seed = bands.grid_seed(series.gap_summary(s.paths(weights)), STEP)
    packed = bands.mean_donor(s.packed) if uniform else s.packed
    return bands.confidence_bands(s.study, packed, seed, STEP)


def _band_rows(s: Setup, table_: DataFrame) -> DataFrame:
    return s.tagged(table_).select(
        "period_idx", "lower_ci", "upper_ci", "lower_rounds", "upper_rounds", "ci_status", *TAGS
    )


@query
def conformal_ci_uniform(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return _band_rows(s, _bands(s, s.uniform("main"), True))


@query
def conformal_ci_two_donor(spark, sf_dir):
    s = pair_setup(spark, sf_dir)
    return _band_rows(s, _bands(s, s.weights("main"), False))


@query
def ci_grid(spark, sf_dir):
    s = Setup(spark, sf_dir)
    seed = bands.grid_seed(series.gap_summary(s.paths(s.uniform("main"))), STEP)
    return s.tagged(seed).select(*TAGS, "min_gap", "max_gap", "lo", "hi", "pad")


@query
def ci_grid_edge_flags(spark, sf_dir):
    s = Setup(spark, sf_dir)
    seed = written_table(bands.grid_seed(series.gap_summary(s.paths(s.uniform("main"))), STEP), "seed")
    flags = bands.first_grid_flags(s.study, bands.mean_donor(s.packed), seed, STEP)
    return s.tagged(flags).select(*TAGS, "lo", "hi", "pad", "grow_lower", "grow_upper")


# --- result tables, rates, reports ---------------------------------------------


@query
def series_table(spark, sf_dir):
    s = pair_setup(spark, sf_dir)
    weights = written_table(s.weights("main"), "weights")
    table_ = series.dated_series(s.study, s.periods, s.paths(weights), _bands(s, weights, False))
    return rounded(table_, "obs", "synth", "diff")


@query
def union_results(spark, sf_dir):
    s = Setup(spark, sf_dir)
    paths = written_table(s.paths(s.uniform("fold_1", "fold_2", "full")), "paths")
    both = shaping.union_results(
        inference.inference_table(s.study, inference.cross_fit_ttest(paths)),
        inference.inference_table(s.study, inference.conformal_block(paths)),
    )
    return rounded(both, "att", "se", "lb", "ub", "pval")


def _fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/counterpanel/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query
def built_once_panel(spark, sf_dir):
    """The second read finds the stored table and does not build again."""
    path = _fresh_folder(spark, "panel")
    src.load_or_build(spark, path, lambda s: quarterly_panel(s, sf_dir))
    return src.load_or_build(spark, path, lambda s: quarterly_panel(s, sf_dir).limit(0))


@query
def stored_series(spark, sf_dir):
    """Series saved as CSV by placebo tag and read back with their schema."""
    s = Setup(spark, sf_dir, shifts=(0, 4))
    path = sinks.save_series(_uniform_series(s), _fresh_folder(spark, "out"), None, "csv")
    back = src.read_results(spark, path, src.STORED_SERIES, "csv").drop("ci_step")
    return rounded(back, "synth", "diff", digits=6).withColumn("obs", F.round("obs", 8))


@query
def stored_inference(spark, sf_dir):
    s = pair_setup(spark, sf_dir)
    tests = inference.inference_table(s.study, inference.cross_fit_ttest(s.paths(s.weights("folds"))))
    path = sinks.save_inference(tests, _fresh_folder(spark, "out"), "ttest")
    back = src.read_results(spark, path, src.STORED_TTEST)
    return rounded(back, "att", "se", "lb", "ub")


@query
def stored_weights(spark, sf_dir):
    s = pair_setup(spark, sf_dir)
    table_ = fit.weights_table(s.study, s.packed, s.weights("main"))
    path = sinks.save_weights(table_, _fresh_folder(spark, "out"), "csv")
    return rounded(src.read_results(spark, path, src.WEIGHTS_SCHEMA, "csv"), "weight")


def _rates(s: Setup) -> DataFrame:
    return rates.year_on_year(_uniform_series(s), ["all"], horizon_months=6)


@query
def yoy_rate(spark, sf_dir):
    s = Setup(spark, sf_dir, "month")
    return rounded(_rates(s).select("date", "obs_rate", *TAGS), "obs_rate", digits=6)


@query
def yoy_rate_synth(spark, sf_dir):
    s = Setup(spark, sf_dir, "month")
    values = ("obs_rate", "synth_rate", "gaps_rate")
    return rounded(_rates(s).select("date", *values, *TAGS), *values, digits=6)


@query
def yoy_rate_own_dates(spark, sf_dir):
    """Two treatment dates of one outcome in one table, each rated by its own."""
    s = Setup(spark, sf_dir, "month", shifts=(0, 12))
    values = ("obs_rate", "synth_rate", "gaps_rate")
    return rounded(_rates(s).select("date", *values, "treatment_date", *TAGS), *values, digits=6)


def _two_dates(spark, sf_dir):
    """The whole analysis at two dates of every outcome, in pools of two donors. The
    panel also holds an outcome that is not asked for, with every key twice."""
    panel = quarterly_panel(spark, sf_dir)
    twice = panel.filter("outcome = 'all'").withColumn("outcome", F.lit("unasked"))
    asked = panel.select("outcome").distinct().select(
        "outcome",
        F.explode(F.array(*[day(d) for d in ("2000-01-01", "1999-04-01")])).alias("treatment_date"),
        F.lit(None).cast("date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"),
    )
    roles = nation_roles(spark, sf_dir, PAIR)
    return estimate(
        panel.unionByName(twice).unionByName(twice),
        roles.filter("role = 'treated'"),
        roles.filter("role = 'control'"),
        asked,
        grain="quarter",
    )


@query
def estimate_two_dates(spark, sf_dir):
    return rounded(_two_dates(spark, sf_dir).inference, "att", "se", "lb", "ub")


@query
def versioned_series(spark, sf_dir):
    """Series of a whole analysis, committed as a version and read back from it."""
    base = _fresh_folder(spark, "versions")
    result = _two_dates(spark, sf_dir)
    result.save_version(base, "csv")
    return rounded(versions.read_version(spark, base)["series"].drop("ci_step", "upper_ci", "lower_ci", "ci_status"), "obs", "synth", "diff", digits=6)


def _labels(spark, sf_dir) -> DataFrame:
    """Display label and line keys of every unit."""
    number = F.substring_index("unit", "_", -1)
    return nation_roles(spark, sf_dir).select(
        "unit",
        F.concat(F.lit("Nation "), number).alias("label"),
        F.concat(F.lit("N"), number).alias("obs_key"),
        F.concat(F.lit("SC_n"), number).alias("synth_key"),
    )


def _uniform_with_bands(s: Setup) -> DataFrame:
    weights = s.uniform("main")
    return series.dated_series(s.study, s.periods, s.paths(weights), _bands(s, weights, True))


@query
def report_frame(spark, sf_dir):
    s = Setup(spark, sf_dir)
    frame = report.report_frame(_uniform_with_bands(s), _labels(spark, sf_dir))
    zeros = report.zero_lines(frame).withColumns({"series": F.lit("Zero"), "color_ord": F.lit(0)})
    both = shaping.union_results(frame.drop("placebo"), zeros)
    return rounded(both, "value", digits=6)


@query
def treatment_marker(spark, sf_dir):
    s = Setup(spark, sf_dir, "month", shifts=(0, 12))
    return report.treatment_marker(_uniform_series(s), s.study)


@query
def ci_band(spark, sf_dir):
    s = Setup(spark, sf_dir)
    rows = written_table(_uniform_with_bands(s), "series")
    frame = report.report_frame(rows, _labels(spark, sf_dir))
    return report.ci_band(frame, report.treatment_marker(rows, s.study, 3))


@query
def counterfactual_series(spark, sf_dir):
    """Flagship: fitted synthetic controls of all nations' quarterly revenue."""
    s = Setup(spark, sf_dir)
    return series.dated_series(s.study, s.periods, s.paths(s.weights("main")))
