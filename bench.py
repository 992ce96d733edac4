"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpanel import estimate
from workload.panels import TREATED, Setup, nation_roles
from workload.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "counterfactual_series",
    "study_panel",
    "gram_matrix",
    "sc_weights_certificate",
    "ttest_two_donor",
    "conformal_block_two_donor",
    "conformal_iid_uniform",
    "conformal_ci_two_donor",
    "placebo_att_two_donor",
    "report_frame",
)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def full_run(spark: SparkSession, kind: str, shifts: tuple[int, ...], step: float) -> dict[str, float]:
    """All outputs of a whole analysis: real run and placebos, with bands."""
    s = Setup(spark, SF_DIR, kind, shifts=shifts)
    controls = nation_roles(spark, SF_DIR).filter("role = 'control'").select("unit")
    start = time.time()
    result = estimate(
        s.panel, TREATED, controls, s.outcomes, shifts=shifts, grain=kind, compute_ci=True, step=step
    )
    for table in (result.series, result.inference, result.weights):
        drain(table)
    took = time.time() - start
    points = result.bands.agg(F.sum((F.col("upper_ci") - F.col("lower_ci")) / step + 1)).first()[0]
    return {"sec": took, "studies": result.inference.count(), "accepted_points": points}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='counterpanel-')}")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain(QUERIES["counterfactual_series"](spark, SF_DIR))  # starts JVM and Python workers

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        drain(QUERIES[name](spark, SF_DIR))
        seconds[name] = round(time.time() - start, 3)

    runs = {
        "full_run_quarter_step_0.1": ("quarter", (0, 4), 0.1),
        "full_run_month_step_0.001": ("month", (0, 6, 12, 18), 0.001),
    }
    detail = {}
    for name, (kind, shifts, step) in runs.items():
        out = full_run(spark, kind, shifts, step)
        seconds[name] = round(out["sec"], 3)
        detail[name] = {
            "studies": out["studies"],
            "studies_per_sec": round(out["studies"] / out["sec"], 2),
            "accepted_grid_points": round(out["accepted_points"] or 0),
        }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "detail": detail,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
