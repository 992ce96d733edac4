"""Per-period confidence bands by inverting the conformal test.

Grid points are integers ``k`` with ``theta = k * step``: bounds are compared
as integers and the lattice never moves. The grid of a study grows downwards
while its lowest point is accepted for any post period, and upwards while its
highest point is; a band is the hull of the accepted points of the final grid.

No grid is evaluated for that. All gaps of a period are linear in the hypothesised
effect along each run of the weights, so the p-value changes only where the period's
gap is as large as another one. One sweep over the runs gives the accepted ranges
exactly, over every effect that can be accepted at all, and the grid's growth and
its hull follow from the ranges by arithmetic: their cost does not depend on the
step, and there is no last round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpanel.functions.packing import matrix, recentred, split_roles
from counterpanel.functions.scalars import round_to_step, step_decimals
from counterpanel.functions.session import spread, written_table
from counterpanel.functions.simplex import simplex_ls, simplex_path, simplex_segments
from counterpanel.operators.inference import REL_SLACK
from counterpanel.operators.wide import (
    ADDED_PER_ROUND,
    MAX_CELLS,
    MAX_POOL,
    as_own_batch,
    closest_donors,
    is_wide,
    price_out,
    wide_rows,
    working_rows,
)

PAD_SHARE = 0.33  # fixed value: share of the gap range added per growth round
ADDED_PER_RUN_END = 4
TASK_KEYS = ("study_id", "chunk")
ACCEPT_SCHEMA = "study_id string, period_idx int, accepted array<bigint>"
RANGE_SCHEMA = "study_id string, period_idx int, ranges array<struct<first: bigint, last: bigint>>"
RESIDUAL_SCHEMA = "study_id string, fit_id string, us array<double>, synths array<double>"


def grid_seed(summary: DataFrame, step: float) -> DataFrame:
    """First grid of every study: lattice bounds and growth pad.

    The range of post gaps is widened by the share |mean pre gap / mean post
    gap| of its ends; the ends are snapped outwards to the lattice.
    """
    d = step_decimals(step)
    low, high = round_to_step(F.col("min_post"), d), round_to_step(F.col("max_post"), d)
    factor = F.coalesce(F.try_divide(F.col("mean_pre"), F.col("mean_post")), F.lit(0.0))

    def lattice(value: Column) -> Column:
        # clears the noise of the division before snapping
        return F.round(value / F.lit(step), 6)

    return (
        summary.withColumn("min_gap", low)
        .withColumn("max_gap", high)
        .withColumn("factor", factor)
        .select(
            "study_id",
            "T0",
            "T1",
            "min_gap",
            "max_gap",
            "factor",
            F.floor(lattice(F.col("min_gap") - F.abs(F.col("min_gap") * F.col("factor")))).cast("bigint").alias("lo"),
            F.ceil(lattice(F.col("max_gap") + F.abs(F.col("max_gap") * F.col("factor")))).cast("bigint").alias("hi"),
            F.greatest(
                F.lit(1),
                F.bround(lattice((F.col("max_gap") - F.col("min_gap")) * F.lit(PAD_SHARE)), 0).cast("bigint"),
            ).alias("pad"),
        )
    )


def _task_arrays(table: pa.Table):
    """(donors, own series, centred donors, centred own, T0, post periods) of a task."""
    donors, treated = split_roles(table)
    if not (len(donors) and len(treated)):
        return None
    X, y = matrix(donors["xs"]), matrix(treated["xs"])[0]
    Z, v = recentred(X, y)
    posts = range(table["first_post"][0].as_py(), table["last_post"][0].as_py() + 1)
    return X, y, Z, v, table["T0"][0].as_py(), posts, treated


def _task_rows(tasks: DataFrame, packed: DataFrame) -> DataFrame:
    """Donor and own series of every task; what a task carries is on its own series."""
    carried = [c for c in ("ks", "lows", "highs") if c in tasks.columns]
    rows = (
        tasks.drop("T0", "T1")
        .join(packed, "batch_id")
        .filter((F.col("role") == "control") | (F.col("unit") == F.col("treated")))
        .select(
            *TASK_KEYS,
            "first_post",
            "last_post",
            "unit",
            "role",
            "T0",
            "xs",
            *[F.when(F.col("role") == "treated", F.col(c)).alias(c) for c in carried],
        )
    )
    return spread(rows, *TASK_KEYS)


def accepted_points(tasks: DataFrame, packed: DataFrame, step: float, alpha: float = 0.1) -> DataFrame:
    """Which of the given grid points are not rejected at level alpha, per post period.

    A task is ``study_id, batch_id, treated, chunk, first_post, last_post, ks``:
    some post periods of a study and some grid points. The p-value of a point is
    the rank of the period's gap among the pre gaps, after a fit to the pre periods
    and that period with the hypothesised effect taken off the treated value.
    """

    def evaluate(table: pa.Table) -> pa.Table:
        idxs, accepted = [], []
        arrays = _task_arrays(table)
        if arrays:
            X, y, Z, v, t0, posts, treated = arrays
            ks = np.asarray(treated["ks"][0].as_py(), dtype=np.int64)
            thetas = np.round(ks * step, step_decimals(step))
            G, c = Z[:, :t0] @ Z[:, :t0].T, Z[:, :t0] @ v[:t0]
            for idx in posts:
                x = Z[:, idx - 1]
                W, _ = simplex_path(G + np.outer(x, x), c + x * v[idx - 1], x, thetas)
                rank = _ranks(W, X, y, t0, idx, thetas)
                idxs.append(idx)
                accepted.append(ks[rank / (t0 + 1) > alpha].tolist())
        return pa.table(
            {
                "study_id": pa.array([table["study_id"][0].as_py()] * len(idxs), pa.string()),
                "period_idx": pa.array(idxs, pa.int32()),
                "accepted": pa.array(accepted, pa.list_(pa.int64())),
            }
        )

    return _task_rows(tasks, packed).groupBy(*TASK_KEYS).applyInArrow(evaluate, ACCEPT_SCHEMA)


def _ranks(W: np.ndarray, X: np.ndarray, y: np.ndarray, t0: int, idx: int, thetas: np.ndarray) -> np.ndarray:
    """Pre gaps at least as large as the period's own, it included, per row of weights."""
    slack = REL_SLACK * max(float(np.abs(y[:t0]).max()), 1e-300)
    gap = np.abs(y[idx - 1] - thetas - W @ X[:, idx - 1])
    return 1 + (np.abs(y[:t0, None] - X[:, :t0].T @ W.T) >= gap - slack).sum(axis=0)


def effect_range(X: np.ndarray, y: np.ndarray, t0: int, idx: int, lows: np.ndarray, highs: np.ndarray) -> tuple[float, float]:
    """Effects outside these bounds leave the period's gap larger than any pre gap,
    whatever the weights: no donor is below ``lows`` or above ``highs``."""
    most = float(np.maximum(np.abs(y[:t0] - lows[:t0]), np.abs(y[:t0] - highs[:t0])).max())
    reach = 1.001 * most + 1e-6 * (1.0 + abs(float(y[idx - 1])))
    return float(y[idx - 1] - highs[idx - 1]) - reach, float(y[idx - 1] - lows[idx - 1]) + reach


def accepted_spans(segments: list, X: np.ndarray, y: np.ndarray, t0: int, idx: int, alpha: float) -> list[list[float]]:
    """Ranges of effects that are not rejected, in ascending order.

    Along a segment a pre gap u and the period's gap v change linearly, and their
    order only where v = 0, u = 0 or |u| + slack = |v|. Every stretch between such
    points is tested at its middle, all pre periods at once; the changes of all pre
    periods are then counted along the segment.
    """
    slack = REL_SLACK * max(float(np.abs(y[:t0]).max()), 1e-300)
    spans: list[list[float]] = []
    for start, end, support, p, q in segments:
        own, pre = X[support, idx - 1], X[support][:, :t0]
        a, b = y[:t0] - p @ pre, -(q @ pre)
        d, e = y[idx - 1] - float(p @ own), -1.0 - float(q @ own)
        tops = [-a, np.full(t0, -d), d - a + slack, d - a - slack, -d - a + slack, -d - a - slack]
        slopes = [b, np.full(t0, e), b - e, b - e, b + e, b + e]
        top, slope = np.stack(tops, axis=1), np.stack(slopes, axis=1)
        points = np.divide(top, slope, out=np.full_like(top, start), where=slope != 0)
        points = np.sort(np.clip(points, start, end), axis=1)
        points = np.concatenate((np.full((t0, 1), start), points, np.full((t0, 1), end)), axis=1)
        middle = (points[:, 1:] + points[:, :-1]) / 2
        above = np.abs(a[:, None] + b[:, None] * middle) >= np.abs(d + e * middle) - slack
        # a stretch of no length says what the one before it does, or else the one after
        long = points[:, 1:] > points[:, :-1]
        known = np.maximum.accumulate(np.where(long, np.arange(above.shape[1]), -1), axis=1)
        known = np.where(known < 0, np.argmax(long, axis=1)[:, None], known)
        above = np.take_along_axis(above, known, axis=1)
        change = np.diff(above.astype(np.int64), axis=1)
        row, col = np.nonzero(change)
        where = points[row, col + 1]
        order = np.argsort(where, kind="stable")
        cuts = np.concatenate(([start], where[order], [end]))
        count = int(above[:, 0].sum()) + np.concatenate(([0], np.cumsum(change[row, col][order])))
        for lo, hi, n in zip(cuts[:-1], cuts[1:], count, strict=True):
            if (1 + n) / (t0 + 1) > alpha and hi >= lo:
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], float(hi))
                else:
                    spans.append([float(lo), float(hi)])
    return spans


def accepted_ranges(tasks: DataFrame, packed: DataFrame, step: float, alpha: float = 0.1) -> DataFrame:
    """All grid points that are not rejected, as ranges (first, last), per post period.

    A task is ``study_id, batch_id, treated, chunk, first_post, last_post`` (with
    ``lows`` and ``highs``, the pool's extremes by period, if the rows are a part of
    the pool). The ends of every range are tested as grid points, like
    ``accepted_points`` does, and moved until they agree.
    """

    def evaluate(table: pa.Table) -> pa.Table:
        idxs, found = [], []
        arrays = _task_arrays(table)
        if arrays:
            X, y, Z, v, t0, posts, treated = arrays
            wide = "lows" in table.column_names
            lows, highs = (np.array(treated[c][0].as_py()) if wide else f(X, axis=0) for c, f in (("lows", np.min), ("highs", np.max)))
            G, c = Z[:, :t0] @ Z[:, :t0].T, Z[:, :t0] @ v[:t0]
            for idx in posts:
                x = Z[:, idx - 1]
                H, h = G + np.outer(x, x), c + x * v[idx - 1]
                low, high = effect_range(X, y, t0, idx, lows, highs)
                segments = simplex_segments(H, h, x, low, high)

                def passes(k: int, idx=idx, x=x, H=H, h=h) -> bool:
                    theta = np.round(np.array([k * step]), step_decimals(step))
                    w, _ = simplex_ls(H, h - theta[0] * x)
                    return bool(_ranks(w[None, :], X, y, t0, idx, theta)[0] / (t0 + 1) > alpha)

                ranges: list[tuple[int, int]] = []
                for lo, hi in accepted_spans(segments, X, y, t0, idx, alpha):
                    first, last = ceil(lo / step - 1e-6), floor(hi / step + 1e-6)
                    while first <= last and not passes(first):
                        first += 1
                    while first <= last and not passes(last):
                        last -= 1
                    if first > last:
                        continue
                    while passes(first - 1):
                        first -= 1
                    while passes(last + 1):
                        last += 1
                    if ranges and first <= ranges[-1][1] + 1:
                        ranges[-1] = (ranges[-1][0], max(ranges[-1][1], last))
                    else:
                        ranges.append((first, last))
                idxs.append(idx)
                found.append([{"first": a, "last": b} for a, b in ranges])
        return pa.table(
            {
                "study_id": pa.array([table["study_id"][0].as_py()] * len(idxs), pa.string()),
                "period_idx": pa.array(idxs, pa.int32()),
                "ranges": pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
            }
        )

    return _task_rows(tasks, packed).groupBy(*TASK_KEYS).applyInArrow(evaluate, RANGE_SCHEMA)


def run_end_residuals(tasks: DataFrame, packed: DataFrame) -> DataFrame:
    """Gaps and synthetic values where a linear run of the weights starts or ends.

    Along a run every optimality condition is linear in the hypothesised
    effect, so a donor that is priced out at both ends is priced out between.
    """

    def evaluate(table: pa.Table) -> pa.Table:
        names, us, synths = [], [], []
        arrays = _task_arrays(table)
        if arrays:
            X, y, Z, v, t0, posts, treated = arrays
            lows, highs = (np.array(treated[c][0].as_py()) for c in ("lows", "highs"))
            G, c = Z[:, :t0] @ Z[:, :t0].T, Z[:, :t0] @ v[:t0]
            for idx in posts:
                x = Z[:, idx - 1]
                low, high = effect_range(X, y, t0, idx, lows, highs)
                runs = simplex_segments(G + np.outer(x, x), c + x * v[idx - 1], x, low, high)
                for n, (start, end, support, p, q) in enumerate(runs):
                    for side, theta in enumerate((start, end)):
                        w = p + theta * q
                        fitted, gap = np.zeros(X.shape[1]), np.zeros(X.shape[1])
                        fitted[:t0], fitted[idx - 1] = w @ X[support][:, :t0], w @ X[support, idx - 1]
                        gap[:t0], gap[idx - 1] = y[:t0] - fitted[:t0], y[idx - 1] - theta - fitted[idx - 1]
                        names.append(f"{idx}:{n}:{side}")
                        us.append(gap.tolist())
                        synths.append(fitted.tolist())
        return pa.table(
            {
                "study_id": pa.array([table["study_id"][0].as_py()] * len(names), pa.string()),
                "fit_id": pa.array(names, pa.string()),
                "us": pa.array(us, pa.list_(pa.float64())),
                "synths": pa.array(synths, pa.list_(pa.float64())),
            }
        )

    return _task_rows(tasks, packed).groupBy(*TASK_KEYS).applyInArrow(evaluate, RESIDUAL_SCHEMA)


def pool_extremes(packed: DataFrame) -> DataFrame:
    """Least and largest donor value of every period, as arrays, per batch."""
    return (
        packed.filter(F.col("role") == "control")
        .select("batch_id", F.posexplode("xs").alias("pos", "x"))
        .groupBy("batch_id", "pos")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"))
        .groupBy("batch_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high"))).alias("cells"))
        .select("batch_id", F.col("cells.low").alias("lows"), F.col("cells.high").alias("highs"))
    )


def mean_donor(packed: DataFrame) -> DataFrame:
    """Replace each donor pool by its average, as a pool of one donor."""
    means = (
        packed.filter(F.col("role") == "control")
        .select("batch_id", "T0", "T1", F.posexplode("xs").alias("pos", "x"))
        .groupBy("batch_id", "pos")
        .agg(F.first("T0").alias("T0"), F.first("T1").alias("T1"), F.avg("x").alias("x"))
        .groupBy("batch_id")
        .agg(
            F.first("T0").alias("T0"),
            F.first("T1").alias("T1"),
            F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("cells"),
        )
        .select("batch_id", F.lit("mean").alias("unit"), F.lit("control").alias("role"), "T0", "T1", F.col("cells.x").alias("xs"))
    )
    return packed.filter(F.col("role") == "treated").unionByName(means)


def _post_chunks(grids: DataFrame, study: DataFrame, periods_per_task: int) -> DataFrame:
    """Fan out each study over chunks of its post periods."""
    chunks = F.sequence(F.lit(0), F.floor((F.col("T1") - 1) / F.lit(periods_per_task)).cast("int"))
    first = F.col("T0") + F.col("chunk") * periods_per_task + 1
    return (
        grids.join(study.select("study_id", "batch_id", "treated"), "study_id")
        .withColumn("chunk", F.explode(chunks))
        .withColumn("first_post", first)
        .withColumn("last_post", F.least(first + periods_per_task - 1, F.col("T0") + F.col("T1")))
    )


def grown_grids(grids: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rounds each side of a grid grows: to its first edge that no post period accepts.

    Ranges are passed outwards. An edge inside a range moves to the first edge beyond
    it, and no range passed before can hold that one, so a single pass settles a side
    however far the accepted effects reach.
    """
    met = (
        ranges.select("study_id", F.explode("ranges").alias("r"))
        .groupBy("study_id")
        .agg(F.collect_set("r").alias("hit"))
    )
    hit = F.coalesce("hit", F.array().cast("array<struct<first: bigint, last: bigint>>"))
    down = F.reverse(F.array_sort(F.transform("hit", lambda r: F.struct(r["last"].alias("last"), r["first"].alias("first")))))
    up = F.array_sort(F.transform("hit", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"))))

    def settled(order: Column, edge: Callable[[Column], Column], beyond: Callable[[Column], Column]) -> Column:
        def step(n: Column, r: Column) -> Column:
            inside = (edge(n) >= r["first"]) & (edge(n) <= r["last"])
            return F.when(inside, F.floor(beyond(r) / F.col("pad")).cast("bigint") + 1).otherwise(n)

        return F.aggregate(order, F.lit(0).cast("bigint"), step).cast("int")

    return (
        grids.join(met, "study_id", "left")
        .withColumn("hit", hit)
        .withColumn("lower_rounds", settled(down, lambda n: F.col("lo") - n * F.col("pad"), lambda r: F.col("lo") - r["first"]))
        .withColumn("upper_rounds", settled(up, lambda n: F.col("hi") + n * F.col("pad"), lambda r: r["last"] - F.col("hi")))
        .drop("hit")
    )


def _search(
    study: DataFrame,
    rows_for: Callable[[DataFrame], DataFrame],
    seed: DataFrame,
    step: float,
    alpha: float,
    periods_per_task: int,
    extremes: DataFrame | None = None,
) -> DataFrame:
    """Accepted ranges of all periods, the grids that they imply, and the hulls."""
    grids = seed.join(study.select("study_id"), "study_id", "left_semi").select(
        "study_id", "T0", "T1", "lo", "hi", "pad"
    )
    usable = grids.filter(F.lit(1.0) / (F.col("T0") + 1) <= F.lit(alpha))
    tasks = _post_chunks(usable, study, periods_per_task)
    if extremes is not None:
        tasks = tasks.join(extremes, "study_id")
    ranges = written_table(accepted_ranges(tasks, rows_for(tasks), step, alpha), "ranges")
    grown = grown_grids(usable, ranges)
    edges = grown.select(
        "study_id",
        (F.col("lo") - F.col("lower_rounds") * F.col("pad")).alias("first_k"),
        (F.col("hi") + F.col("upper_rounds") * F.col("pad")).alias("last_k"),
    )
    lower, upper = F.greatest("r.first", "first_k"), F.least("r.last", "last_k")
    hull = (
        ranges.select("study_id", "period_idx", F.explode("ranges").alias("r"))
        .join(edges, "study_id")
        .filter(lower <= upper)
        .groupBy("study_id", "period_idx")
        .agg(F.min(lower).alias("lower_k"), F.max(upper).alias("upper_k"))
    )
    return band_table(grids, grown, hull, step, alpha)


def confidence_bands(
    study: DataFrame,
    packed: DataFrame,
    seed: DataFrame,
    step: float,
    alpha: float = 0.1,
    periods_per_task: int = 8,
    max_pool: int = MAX_POOL,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Bounds per study and post period: the hull of the accepted grid points.

    ``ci_status``: ``found``; ``unbounded`` if T0 + 1 < 1 / alpha, where no
    effect can be rejected; ``empty`` if no point of the final grid was accepted.
    ``study`` carries ``n_donors, T0, T1`` and should be a stored table.
    """
    limits = (step, alpha, periods_per_task)
    wide = as_own_batch(study.filter(is_wide(max_pool, max_cells)))
    narrow = study.filter(~is_wide(max_pool, max_cells))
    direct = _search(narrow, lambda tasks: packed, seed, *limits)
    if wide.isEmpty():
        return direct
    pools = study.filter(is_wide(max_pool, max_cells))
    pool = wide_rows(pools, packed)
    extremes = written_table(pools.select("study_id", "batch_id").join(pool_extremes(pool), "batch_id").drop("batch_id"), "extremes")

    def priced_rows(tasks: DataFrame) -> DataFrame:
        def residuals(still_open: DataFrame, rows: DataFrame) -> DataFrame:
            mine = tasks.join(still_open.select("study_id"), "study_id", "left_semi")
            return run_end_residuals(mine, rows)

        first = closest_donors(pools, pool, ADDED_PER_ROUND)
        working = price_out(pools, pool, first, residuals, ADDED_PER_RUN_END)
        return working_rows(pools, pool, working)

    return direct.unionByName(_search(wide, priced_rows, seed, *limits, extremes))


def band_table(
    grids: DataFrame, grown: DataFrame, hull: DataFrame, step: float, alpha: float
) -> DataFrame:
    """One row per study and post period, with status."""
    d = step_decimals(step)
    periods = grids.select(
        "study_id",
        "T0",
        F.explode(F.sequence(F.col("T0") + 1, F.col("T0") + F.col("T1"))).alias("period_idx"),
    )
    status = (
        F.when(F.lit(1.0) / (F.col("T0") + 1) > F.lit(alpha), F.lit("unbounded"))
        .when(F.col("lower_k").isNull(), F.lit("empty"))
        .otherwise(F.lit("found"))
    )
    return (
        periods.join(grown.select("study_id", "lower_rounds", "upper_rounds"), "study_id", "left")
        .join(hull, ["study_id", "period_idx"], "left")
        .select(
            "study_id",
            "period_idx",
            F.round(F.col("lower_k") * F.lit(step), d).alias("lower_ci"),
            F.round(F.col("upper_k") * F.lit(step), d).alias("upper_ci"),
            "lower_rounds",
            "upper_rounds",
            status.alias("ci_status"),
        )
    )


def edge_flags(seed: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether the first grid's lowest / highest point is accepted anywhere."""
    hits = edges.select("study_id", F.explode("accepted").alias("k")).groupBy("study_id").agg(
        F.collect_set("k").alias("hit")
    )
    return (
        seed.join(hits, "study_id", "left")
        .withColumn("hit", F.coalesce("hit", F.array().cast("array<bigint>")))
        .select(
            "study_id",
            "lo",
            "hi",
            "pad",
            F.array_contains("hit", F.col("lo")).alias("grow_lower"),
            F.array_contains("hit", F.col("hi")).alias("grow_upper"),
        )
    )


def first_grid_flags(
    study: DataFrame,
    packed: DataFrame,
    seed: DataFrame,
    step: float,
    alpha: float = 0.1,
    periods_per_task: int = 8,
) -> DataFrame:
    """Which sides of the first grid have to grow."""
    grids = seed.select("study_id", "T0", "T1", "lo", "hi", "pad")
    edges = grids.withColumn("ks", F.array_sort(F.array_distinct(F.array("lo", "hi"))))
    tasks = _post_chunks(edges, study, periods_per_task)
    return edge_flags(grids, accepted_points(tasks, packed, step, alpha))
