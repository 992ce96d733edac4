"""Study-level inference: cross-fit t-test and conformal p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpanel.functions.scalars import t_quantile
from counterpanel.functions.session import spread
from counterpanel.operators.fit import POST_BLOCK, fold_of

# Statistics are compared up to this relative slack, so that the order in which
# equal terms were added cannot decide a rank.
REL_SLACK = 1e-9


def cross_fit_ttest(
    paths: DataFrame, folds: int = 2, anchor: str = "end", alpha: float = 0.1
) -> DataFrame:
    """ATT with a t interval from K fits that each hold one pre block out.

    tau_k is the mean post gap minus the mean held-out gap of fold k.
    """
    if folds < 2:
        raise ValueError("the t-test needs at least two folds")
    idx, t0, t1 = F.col("period_idx"), F.col("T0"), F.col("T1")
    fold = F.substring_index("fit_id", "_", -1).try_cast("int")
    taus = (
        paths.filter(F.col("fit_id").startswith("fold_"))
        .withColumn("block", fold_of(idx, t0, t1, folds, anchor))
        .groupBy("study_id", "fit_id")
        .agg(
            F.first("T0").alias("T0"),
            F.first("T1").alias("T1"),
            (
                F.avg(F.when(F.col("block") == POST_BLOCK, F.col("diff")))
                - F.avg(F.when(F.col("block") == fold, F.col("diff")))
            ).alias("tau"),
        )
    )
    r = F.least(F.floor(t0 / F.lit(folds)), t1.cast("long"))
    half = F.lit(t_quantile(1 - alpha / 2, folds - 1)) * F.col("se")
    return (
        taus.groupBy("study_id")
        .agg(
            F.first("T0").alias("T0"),
            F.first("T1").alias("T1"),
            F.avg("tau").alias("att"),
            F.stddev_samp("tau").alias("sd"),
        )
        .withColumn("se", F.sqrt(1 + F.lit(folds) * r / t1) * F.col("sd") / F.sqrt(F.lit(folds)))
        .select("study_id", "att", "se", (F.col("att") - half).alias("lb"), (F.col("att") + half).alias("ub"), "T0")
        .withColumn("significant", (F.col("lb") > 0) | (F.col("ub") < 0))
    )


def _window_gaps(paths: DataFrame, theta0: float) -> DataFrame:
    """|gap| of the full-window fit as one array per study, under the null."""
    effect = F.when(F.col("period_idx") > F.col("T0"), F.lit(float(theta0))).otherwise(F.lit(0.0))
    cell = F.struct("period_idx", F.abs(F.col("diff") - effect).alias("a"))
    return (
        paths.filter(F.col("fit_id") == "full")
        .groupBy("study_id")
        .agg(
            F.first("T0").alias("T0"),
            F.first("T1").alias("T1"),
            F.sort_array(F.collect_list(cell)).alias("cells"),
        )
        .select("study_id", "T0", "T1", F.col("cells.a").alias("gaps"))
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _reaches(statistic: Column, identity: Column) -> Column:
    return statistic >= identity * F.lit(1 - REL_SLACK)


def _conformal_row(table: DataFrame, alpha: float) -> DataFrame:
    return table.select("study_id", "pval", "T0", (F.col("pval") <= alpha).alias("significant"))


def conformal_block(paths: DataFrame, theta0: float = 0.0, alpha: float = 0.1) -> DataFrame:
    """p-value over all cyclic shifts of the window.

    A study is one row with an array bounded by its calendar, so every shift is
    evaluated in place: no join and no further shuffle.
    """
    rows = _window_gaps(paths, theta0)
    n, t0, t1 = F.size("gaps"), F.col("T0"), F.col("T1")
    # the window doubled, so that a shifted post block is a plain slice
    doubled = F.concat("gaps", "gaps")
    statistics = F.transform(
        F.sequence(F.lit(1), n), lambda start: _total(F.slice(F.col("doubled"), start, t1))
    )
    identity = F.element_at("statistics", t0 + 1)
    share = F.size(F.filter("statistics", lambda s: _reaches(s, F.col("identity")))) / n
    return _conformal_row(
        rows.withColumn("doubled", doubled)
        .withColumn("statistics", statistics)
        .withColumn("identity", identity)
        .withColumn("pval", share),
        alpha,
    )


def conformal_iid(
    paths: DataFrame,
    n_perm: int = 5000,
    seed: int = 61876,
    theta0: float = 0.0,
    alpha: float = 0.1,
    perms_per_task: int = 100,
) -> DataFrame:
    """p-value over random permutations of the window.

    Permutation ``b`` orders the periods by md5('seed:b:period'), which does not
    depend on partitioning. Studies fan out over blocks of permutations; each
    permutation is a sort of one row's array, and only counts are shuffled.
    """
    rows = _window_gaps(paths, theta0)
    identity = _total(F.slice("gaps", F.col("T0") + 1, F.col("T1")))
    blocks = F.sequence(F.lit(1), F.lit(n_perm), F.lit(perms_per_task))

    def draw(b: Column) -> Column:
        keyed = F.transform(
            "gaps",
            lambda a, i: F.struct(
                F.md5(F.concat_ws(":", F.lit(str(seed)), b, i + 1)).alias("k"), a.alias("a")
            ),
        )
        chosen = F.slice(F.array_sort(keyed), 1, F.col("T1"))
        return F.aggregate(chosen, F.lit(0.0), lambda acc, v: acc + v["a"])

    fanned = spread(
        rows.withColumn("identity", identity).withColumn("first_perm", F.explode(blocks)),
        "study_id",
        "first_perm",
    )
    perms = F.sequence(
        F.col("first_perm"), F.least(F.col("first_perm") + perms_per_task - 1, F.lit(n_perm))
    )
    hits = F.size(F.filter(perms, lambda b: _reaches(draw(b), F.col("identity"))))
    return _conformal_row(
        fanned.withColumn("hits", hits)
        .groupBy("study_id")
        .agg(F.first("T0").alias("T0"), F.sum("hits").alias("hits"))
        .withColumn("pval", (F.col("hits") + 1) / F.lit(n_perm + 1)),
        alpha,
    )


def inference_table(study: DataFrame, results: DataFrame) -> DataFrame:
    """Study-level results with their tags, in the stored column order."""
    values = [c for c in results.columns if c not in ("study_id", "significant")]
    tags = ("outcome", "treated", "placebo", "treatment_date")
    return results.join(study.select("study_id", *tags), "study_id").select(*values, *tags)
