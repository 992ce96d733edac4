"""Exact fits for donor pools too wide for one task.

The simplex solution uses few donors. A study starts from a small working set,
is solved on it by the ordinary operators, and then *all* its donors are priced
against the resulting gaps in one distributed join: a donor enters if adding it
would lower the squared error, or leave it as it is with nearer donors. When no
donor does, the optimality conditions hold over the whole pool, and the weights are
those that one task would find with all of it. Every round adds at least one donor to every
unfinished study, so the loop ends, with nothing left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpanel.functions.packing import matrix
from counterpanel.functions.session import spread, written_table
from counterpanel.functions.simplex import REL_TOL, tie_costs
from counterpanel.operators.fit import fitted_paths, solve_weights

MAX_POOL = 512
MAX_CELLS = 4_000_000
PRICE_TOL = 4 * REL_TOL  # so that what a fit on the working set leaves out is not priced in again
ADDED_PER_ROUND = 32  # per fit
TASK_CELLS = 1_000_000


def is_wide(max_pool: int = MAX_POOL, max_cells: int = MAX_CELLS) -> Column:
    """Whether a study's donor matrix should not be gathered in one task."""
    cells = F.col("n_donors").cast("long") * (F.col("T0") + F.col("T1"))
    return (F.col("n_donors") > max_pool) | (cells > max_cells)


def _top_per_study(candidates: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each (study, fit); limited before the shuffle."""
    order = Window.partitionBy("study_id", "fit_id").orderBy(F.desc("gain"), "unit")
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("study_id", "unit")
        .distinct()
    )


def closest_donors(study: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """First working set: the donors nearest to the treated unit before treatment."""
    own = packed.filter(F.col("role") == "treated").select(
        "batch_id", F.col("unit").alias("treated"), F.col("xs").alias("ys")
    )
    target = study.select("study_id", "batch_id", "treated").join(own, ["batch_id", "treated"])
    pre = F.slice(F.zip_with("ys", "xs", lambda y, x: (y - x) * (y - x)), 1, F.col("T0"))
    loss = F.aggregate(pre, F.lit(0.0), lambda acc, v: acc + v)
    rows = packed.filter(F.col("role") == "control").join(target, "batch_id")
    return _top_per_study(
        rows.select("study_id", "unit", F.lit("main").alias("fit_id"), (-loss).alias("gain")), k
    )


def entering_donors(study: DataFrame, packed: DataFrame, residuals: DataFrame, working: DataFrame, k: int) -> DataFrame:
    """Donors of the whole pool that would lower some fit's squared error.

    ``residuals`` is a stored table ``study_id, fit_id, us, synths``: gaps and
    synthetic values of a fit, zero outside its periods; with ``used, prices,
    sum_price`` also what a donor must cost less than to take part in a tie. Donors
    in ``working`` are passed over before the k best are taken. Donors are hashed
    into buckets and fits into chunks; a task multiplies one bucket with one chunk.
    """
    ties = [c for c in ("used", "prices", "sum_price") if c in residuals.columns]
    fits = residuals.join(study.select("study_id", "batch_id", "n_donors"), "study_id")
    sizes = fits.groupBy("batch_id").agg(
        F.ceil(F.sum(F.size("us")) / F.lit(TASK_CELLS)).cast("int").alias("chunks"),
        F.ceil(F.max(F.size("us").cast("long") * F.col("n_donors")) / F.lit(TASK_CELLS))
        .cast("int")
        .alias("buckets"),
    )
    keys = ["batch_id", "bucket", "chunk"]
    known = working.groupBy("study_id").agg(F.collect_list("unit").alias("known"))
    donors = (
        packed.filter(F.col("role") == "control")
        .join(sizes, "batch_id")
        .withColumn("bucket", F.pmod(F.xxhash64("unit"), F.col("buckets")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*keys, "unit", "xs")
    )
    targets = (
        fits.join(sizes, "batch_id")
        .join(known, "study_id")
        .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
        .withColumn("chunk", F.pmod(F.xxhash64("study_id", "fit_id"), F.col("chunks")).cast("int"))
        .select(*keys, "study_id", "fit_id", "us", "synths", "known", *ties)
    )

    def price(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"study_id": [], "fit_id": [], "unit": [], "gain": []}
        if len(left) and len(right):
            X, U, S = matrix(left["xs"]), matrix(right["us"]), matrix(right["synths"])
            gains = U @ X.T - (S * U).sum(axis=1)[:, None]
            own, fitted, gap = (np.sqrt((M**2).sum(axis=1)) for M in (X, S, U))
            reach = own + fitted[:, None]
            least = PRICE_TOL * reach * (fitted + gap)[:, None]
            units = left["unit"].to_pylist()
            place = {unit: at for at, unit in enumerate(units)}
            names = zip(right["study_id"].to_pylist(), right["fit_id"].to_pylist(), right["known"].to_pylist())
            for r, ((sid, fid, known_units), gain, far, noise) in enumerate(zip(names, gains, reach, least)):
                mine = [place[u] for u in known_units if u in place]
                gain[mine] = 0.0
                level = np.abs(gain) <= 10 * noise if ties else None
                better = np.flatnonzero(gain > noise)
                gain[better] /= far[better]
                if ties:  # donors on the same face that cost less than their price
                    used, prices = (np.array(right[c][r].as_py()) for c in ("used", "prices"))
                    cost = tie_costs(X * used, (U[r] + S[r]) * used, units)
                    priced = X @ prices + right["sum_price"][r].as_py()
                    margin = 1e-9 * (cost + np.abs(X) @ np.abs(prices) + abs(right["sum_price"][r].as_py()))
                    saves = level & (cost < priced - margin)
                    saves[mine] = False
                    better = np.union1d(better, np.flatnonzero(saves))
                    scale = max(float(cost.max()), 1e-300)
                    gain[saves] = np.maximum(gain[saves], (priced - cost)[saves] / scale * 1e-9)
                # a bucket's k best hold its share of the pool's k best
                best = better[np.argsort(-gain[better], kind="stable")[:k]]
                out["study_id"] += [sid] * len(best)
                out["fit_id"] += [fid] * len(best)
                out["unit"] += [units[b] for b in best]
                out["gain"] += gain[best].tolist()
        kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds)})

    priced = (
        spread(donors, *keys)
        .groupBy(*keys)
        .cogroup(spread(targets, *keys).groupBy(*keys))
        .applyInArrow(price, "study_id string, fit_id string, unit string, gain double")
    )
    return _top_per_study(priced, k)


def working_rows(study: DataFrame, packed: DataFrame, working: DataFrame) -> DataFrame:
    """Packed rows of each study's working set and its own series, one batch per study."""
    keys = study.select("study_id", "batch_id", "treated")
    donors = working.join(keys, "study_id").select("study_id", "batch_id", "unit")
    own = keys.select("study_id", "batch_id", F.col("treated").alias("unit"))
    return (
        donors.unionByName(own)
        .join(packed, ["batch_id", "unit"])
        .select(F.col("study_id").alias("batch_id"), "unit", "role", "T0", "T1", "xs")
    )


def wide_rows(study: DataFrame, packed: DataFrame) -> DataFrame:
    """Series of the studies' batches, stored: every pricing round reads them."""
    batches = study.select("batch_id").distinct()
    return written_table(packed.join(batches, "batch_id", "left_semi"), "wide")


def as_own_batch(study: DataFrame) -> DataFrame:
    return study.withColumn("batch_id", F.col("study_id"))


def price_out(
    study: DataFrame,
    packed: DataFrame,
    working: DataFrame,
    residuals_of: Callable[[DataFrame, DataFrame], DataFrame],
    per_round: int = ADDED_PER_ROUND,
) -> DataFrame:
    """Grow working sets until no donor of the pool enters; returns all of them."""
    working = written_table(working, "working")
    open_study, settled = study, None
    while True:
        rows = working_rows(open_study, packed, working)
        residuals = written_table(residuals_of(open_study, rows), "residuals")
        entering = written_table(
            entering_donors(open_study, packed, residuals, working, per_round), "entering"
        )
        touched = entering.select("study_id").distinct()
        done = working.join(touched, "study_id", "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        if entering.isEmpty():
            return settled
        open_study = open_study.join(touched, "study_id", "left_semi")
        working = written_table(
            working.join(touched, "study_id", "left_semi").unionByName(entering), "working"
        )


def fit_residuals(
    fits: Sequence[str], folds: int, anchor: str, theta0: float
) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Residual arrays of the requested fits on the current working sets."""
    return lambda study, rows: fitted_paths(as_own_batch(study), rows, fits, folds, anchor, theta0)


def fit_weights(
    study: DataFrame,
    packed: DataFrame,
    fits: Sequence[str] = ("main",),
    folds: int = 2,
    anchor: str = "end",
    theta0: float = 0.0,
    max_pool: int = MAX_POOL,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Weights of all studies: narrow pools in one pass, wide ones by pricing.

    ``study`` carries ``n_donors, T0, T1`` and should be a stored table.
    """
    wide = study.filter(is_wide(max_pool, max_cells))
    narrow = study.filter(~is_wide(max_pool, max_cells))
    direct = solve_weights(narrow, packed, fits, folds, anchor, theta0)
    if wide.isEmpty():
        return direct
    pool = wide_rows(wide, packed)
    working = price_out(
        wide,
        pool,
        closest_donors(wide, pool, ADDED_PER_ROUND),
        fit_residuals(fits, folds, anchor, theta0),
    )
    rows = working_rows(wide, pool, working)
    priced = solve_weights(as_own_batch(wide), rows, fits, folds, anchor, theta0)
    keys = wide.select("study_id", "batch_id")
    return direct.unionByName(priced.drop("batch_id").join(keys, "study_id").select(*direct.columns))
