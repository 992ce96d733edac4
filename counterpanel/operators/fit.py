"""Donor weights: cross-products per batch, then one small solve per fit.

A *fit* is a choice of periods: ``main`` (all pre periods), ``fold_k`` (pre
periods but the k-th held-out block) and ``full`` (pre and post periods, under
a hypothesised effect). Cross-products are taken once per block of periods;
every fit is a sum of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpanel.functions.packing import matrix, recentred, split_roles
from counterpanel.functions.session import spread
from counterpanel.functions.simplex import closest_weights, simplex_ls, tie_costs

POST_BLOCK = -1
WEIGHT_SCHEMA = (
    "study_id string, batch_id string, treated string, fit_id string, unit string, w double"
)
PATH_SCHEMA = (
    "study_id string, fit_id string, us array<double>, synths array<double>, "
    "used array<double>, prices array<double>, sum_price double"
)
GRAM_SCHEMA = "batch_id string, block int, i string, j string, g double"


def fold_of(idx: Column, t0: Column, t1: Column, folds: int, anchor: str = "end") -> Column:
    """Held-out block of a period: 1..K in the pre window, 0 for other pre
    periods, -1 after treatment. Blocks have r = min(floor(T0 / K), T1) periods."""
    r = F.least(F.floor(t0 / F.lit(folds)), t1.cast("long"))
    first = t0 - r * folds if anchor == "end" else F.lit(0)
    offset = idx - 1 - first
    inside = (offset >= 0) & (offset < r * folds)
    # r is 0 when T0 < K; try_divide keeps that case out of the division
    block = F.floor(F.try_divide(offset.cast("double"), r.cast("double"))) + 1
    return (
        F.when(idx > t0, F.lit(POST_BLOCK)).when(inside, block).otherwise(F.lit(0)).cast("int")
    )


def block_labels(t0: int, t1: int, folds: int, anchor: str) -> np.ndarray:
    """The same labels for a whole window, as an array."""
    labels = np.full(t0 + t1, POST_BLOCK)
    labels[:t0] = 0
    r = min(t0 // folds, t1)
    first = t0 - r * folds if anchor == "end" else 0
    labels[first : first + r * folds] = np.repeat(np.arange(1, folds + 1), r)
    return labels


def block_products(
    left: np.ndarray, right: np.ndarray, labels: np.ndarray
) -> dict[int, np.ndarray]:
    """``left @ right'`` restricted to the periods of each block."""
    return {
        int(b): left[:, labels == b] @ right[:, labels == b].T for b in np.unique(labels)
    }


def gram_matrix(
    packed: DataFrame, folds: int = 2, anchor: str = "end", bucket_size: int = 256
) -> DataFrame:
    """Cross-products of each batch as long rows: donor pairs (i <= j) and
    treated x donor, per block of periods.

    Donors are hashed into buckets and a task multiplies two buckets, so no task
    holds a whole wide pool.
    """
    counts = (
        packed.filter(F.col("role") == "control")
        .groupBy("batch_id")
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket_size)).cast("int").alias("buckets"))
    )
    bucket = F.pmod(F.xxhash64("unit"), F.col("buckets")).cast("int")
    other = F.sequence(F.lit(0), F.col("buckets") - 1)
    placed = (
        packed.join(counts, "batch_id")
        .withColumn("bucket", F.when(F.col("role") == "control", bucket))
        .withColumn("other", F.explode(other))
        .withColumn("left", F.least("bucket", "other"))
        .withColumn("right", F.greatest("bucket", "other"))
    )

    def products(table: pa.Table) -> pa.Table:
        donors, treated = split_roles(table)
        labels = block_labels(table["T0"][0].as_py(), table["T1"][0].as_py(), folds, anchor)
        left, right = table["left"][0].as_py(), table["right"][0].as_py()
        side = donors["bucket"].to_numpy()
        names, X = donors["unit"].to_numpy(), matrix(donors["xs"])
        parts: list[tuple] = []

        def add(rows, row_names, cols, col_names, keep, by_name=False):
            i, j = np.nonzero(keep)
            first, second = row_names[i], col_names[j]
            if by_name:
                swap = first > second
                first, second = np.where(swap, second, first), np.where(swap, first, second)
            for b, g in block_products(rows, cols, labels).items():
                parts.append((np.full(len(i), b, dtype=np.int32), first, second, g[i, j]))

        if len(names):
            X, Z = X[side == left], X[side == right]
            a, b = names[side == left], names[side == right]
            every = np.ones((len(a), len(b)))
            add(X, a, Z, b, np.triu(every) if left == right else every, by_name=True)
            if left == right and len(treated):
                own = treated["unit"].to_numpy()
                add(matrix(treated["xs"]), own, X, a, np.ones((len(own), len(a))))
        joined = [np.concatenate(p) for p in zip(*parts)] if parts else [[]] * 4
        return pa.table(
            {
                "batch_id": pa.array([table["batch_id"][0].as_py()] * len(joined[3]), pa.string()),
                "block": pa.array(joined[0], pa.int32()),
                "i": pa.array(joined[1], pa.string()),
                "j": pa.array(joined[2], pa.string()),
                "g": pa.array(joined[3], pa.float64()),
            }
        )

    keys = ["batch_id", "left", "right"]
    return spread(placed, *keys).groupBy(*keys).applyInArrow(products, GRAM_SCHEMA)


def fit_names(fits: Sequence[str], folds: int) -> list[str]:
    """Expand the request 'folds' into one fit per held-out block."""
    names = []
    for name in fits:
        names += [f"fold_{k}" for k in range(1, folds + 1)] if name == "folds" else [name]
    return names


def _solved(
    table: pa.Table, names: Sequence[str], folds: int, anchor: str, theta0: float
) -> Iterator[tuple]:
    """Every fit of a batch: (study, treated unit, fit, donor units, weights, gaps,
    synthetic values, periods used, prices of a tie, price of the sum)."""
    donors, treated = split_roles(table)
    t0, t1 = table["T0"][0].as_py(), table["T1"][0].as_py()
    if not (len(donors) and len(treated) and t0 >= 2 and t1 >= 1):
        return
    labels = block_labels(t0, t1, folds, anchor)
    raw, own = matrix(donors["xs"]), matrix(treated["xs"])
    X, Y = recentred(raw, own)
    null = Y - theta0 * (labels == POST_BLOCK)
    gram, cross = block_products(X, X, labels), block_products(null, X, labels)
    pre = [b for b in gram if b != POST_BLOCK]
    units = donors["unit"].to_pylist()
    for name in names:
        held_out = int(name.split("_")[1]) if name.startswith("fold_") else None
        use = list(gram) if name == "full" else [b for b in pre if b != held_out]
        if not use or (held_out is not None and held_out not in gram):
            continue
        G, periods = sum(gram[b] for b in use), np.isin(labels, use)
        for r, (sid, unit) in enumerate(zip(treated["study_id"].to_pylist(), treated["unit"].to_pylist())):
            c = sum(cross[b][r] for b in use)
            w, _ = simplex_ls(G, c)
            cost = tie_costs(X[:, periods], null[r][periods], units)
            w, prices = closest_weights(X[:, periods], G, c, w, cost)
            synth = w @ raw
            gap = (own[r] - theta0 * (labels == POST_BLOCK) - synth) * periods
            by_period = np.zeros(len(labels))
            by_period[periods] = prices[:-1]
            # prices of the series as they are stored, not as they are centred here
            sum_price = float(prices[-1] - by_period @ (raw[0] - X[0]))
            yield sid, unit, name, units, w, gap, synth * periods, periods, by_period, sum_price


def solve_weights(
    study: DataFrame,
    packed: DataFrame,
    fits: Sequence[str] = ("main",),
    folds: int = 2,
    anchor: str = "end",
    theta0: float = 0.0,
) -> DataFrame:
    """Simplex weights of every study and fit; only non-zero weights are rows.

    The group is a batch: its donors and at most a bucketful of treated units,
    as arrays over the study window. Where several weights fit equally well, those
    of the donors nearest to the treated unit are taken (``tie_costs``).
    """
    names = fit_names(fits, folds)

    def solve(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"study_id": [], "treated": [], "fit_id": [], "unit": [], "w": []}
        for sid, unit, name, units, w, *_ in _solved(table, names, folds, anchor, theta0):
            support = np.flatnonzero(w)
            out["study_id"] += [sid] * len(support)
            out["treated"] += [unit] * len(support)
            out["fit_id"] += [name] * len(support)
            out["unit"] += [units[j] for j in support]
            out["w"] += w[support].tolist()
        n = len(out["w"])
        return pa.table(
            {
                "study_id": pa.array(out["study_id"], pa.string()),
                "batch_id": pa.array([table["batch_id"][0].as_py()] * n, pa.string()),
                "treated": pa.array(out["treated"], pa.string()),
                "fit_id": pa.array(out["fit_id"], pa.string()),
                "unit": pa.array(out["unit"], pa.string()),
                "w": pa.array(out["w"], pa.float64()),
            }
        )

    members = spread(study_members(study, packed), "batch_id")
    return members.groupBy("batch_id").applyInArrow(solve, WEIGHT_SCHEMA)


def fitted_paths(
    study: DataFrame,
    packed: DataFrame,
    fits: Sequence[str],
    folds: int,
    anchor: str,
    theta0: float,
) -> DataFrame:
    """Gaps and synthetic values of every fit over the periods it uses (zero
    elsewhere), and the prices by which a donor outside would tie with it."""
    names = fit_names(fits, folds)
    fields = ("study_id", "fit_id", "us", "synths", "used", "prices", "sum_price")
    kinds = (pa.string(), pa.string(), *[pa.list_(pa.float64())] * 4, pa.float64())

    def solve(table: pa.Table) -> pa.Table:
        rows = [
            (sid, name, gap.tolist(), synth.tolist(), used.astype(float).tolist(), prices.tolist(), sum_price)
            for sid, _, name, _, _, gap, synth, used, prices, sum_price in _solved(table, names, folds, anchor, theta0)
        ]
        columns = zip(*rows) if rows else [[]] * len(fields)
        return pa.table({f: pa.array(list(x), k) for f, x, k in zip(fields, columns, kinds)})

    members = spread(study_members(study, packed), "batch_id")
    return members.groupBy("batch_id").applyInArrow(solve, PATH_SCHEMA)


def study_members(study: DataFrame, packed: DataFrame) -> DataFrame:
    """Donor rows of every batch in use, and treated rows tagged with their study."""
    own = study.select("batch_id", F.col("treated").alias("unit"), "study_id")
    treated = packed.filter(F.col("role") == "treated").join(own, ["batch_id", "unit"])
    donors = packed.filter(F.col("role") == "control").join(
        study.select("batch_id").distinct(), "batch_id", "left_semi"
    )
    columns = ["batch_id", "unit", "role", "T0", "T1", "xs"]
    return donors.select(*columns, F.lit(None).cast("string").alias("study_id")).unionByName(
        treated.select(*columns, "study_id")
    )


def uniform_weights(study: DataFrame, packed: DataFrame, fits: Sequence[str]) -> DataFrame:
    """Weight 1/J on every donor, for each named fit."""
    donors = packed.filter(F.col("role") == "control").select("batch_id", "unit")
    counts = donors.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_donors"))
    return (
        study.select("study_id", "batch_id", "treated")
        .join(counts, "batch_id")
        .join(donors, "batch_id")
        .select(
            "study_id",
            "batch_id",
            "treated",
            F.explode(F.array(*[F.lit(f) for f in fits])).alias("fit_id"),
            "unit",
            (F.lit(1.0) / F.col("n_donors")).alias("w"),
        )
    )


def weights_table(study: DataFrame, packed: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per study and donor of the main fit, zero weights included."""
    donors = packed.filter(F.col("role") == "control").select("batch_id", "unit")
    main = weights.filter(F.col("fit_id") == "main").select("study_id", "unit", "w")
    return (
        study.select("study_id", "batch_id", "treated", "outcome", "placebo", "treatment_date")
        .join(donors, "batch_id")
        .join(main, ["study_id", "unit"], "left")
        .select(
            F.col("unit").alias("control_unit"),
            F.coalesce("w", F.lit(0.0)).alias("weight"),
            "treated",
            "outcome",
            "placebo",
            "treatment_date",
        )
    )


def optimality(study: DataFrame, packed: DataFrame, weights: DataFrame, paths: DataFrame) -> DataFrame:
    """Certificate of the main fit from its gaps, one pass over the donors.

    With gaps u and synthetic values s before treatment, w is optimal on the
    simplex iff w >= 0, sum(w) = 1 and no donor x has u.(x - s) > 0. ``slack`` is
    the least -u.(x - s) / (|x - s| |s + u|): each donor is measured on its own
    scale. ``paths`` is ``counterfactual`` of the weights.
    """
    cell = F.struct("period_idx", F.col("diff").alias("u"), F.col("synth_c").alias("s"))
    before = paths.filter((F.col("fit_id") == "main") & (F.col("period_idx") <= F.col("T0")))
    fitted = before.groupBy("study_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    rows = (
        packed.filter(F.col("role") == "control")
        .join(study.select("study_id", "batch_id"), "batch_id")
        .join(fitted, "study_id")
        .withColumn("xs", F.slice("xs", 1, F.col("T0")))
    )

    def total(term) -> Column:
        return F.aggregate(F.zip_with("xs", "cells", term), F.lit(0.0), lambda acc, v: acc + v)

    gain = total(lambda x, c: c["u"] * (x - c["s"]))
    apart = total(lambda x, c: (x - c["s"]) * (x - c["s"]))
    size = total(lambda x, c: (c["s"] + c["u"]) * (c["s"] + c["u"]))
    slack = F.coalesce(F.try_divide(-gain, F.sqrt(apart) * F.sqrt(size)), F.lit(0.0))
    sums = weights.filter(F.col("fit_id") == "main").groupBy("study_id").agg(
        F.sum("w").alias("sum_w"), F.min("w").alias("min_w")
    )
    return sums.join(rows.groupBy("study_id").agg(F.min(slack).alias("slack")), "study_id")
