"""Readers and the build-once source."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_D, _S, _N = T.DateType(), T.StringType(), T.DoubleType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


PRICE_SCHEMA = _schema(("date", _D), ("country", _S), ("DAP", _N))
INDEX_SCHEMA = _schema(("geo", _S), ("coicop", _S), ("TIME_PERIOD", _D), ("values", _N))
TAGS = (("T0", T.IntegerType()), ("outcome", _S), ("treated", _S), ("placebo", _S), ("treatment_date", _D))
SERIES_SCHEMA = _schema(
    ("date", _D), ("obs", _N), ("synth", _N), ("diff", _N), ("upper_ci", _N), ("lower_ci", _N), ("ci_status", _S), *TAGS
)
TTEST_SCHEMA = _schema(("att", _N), ("se", _N), ("lb", _N), ("ub", _N), *TAGS)
CONFORMAL_SCHEMA = _schema(("pval", _N), *TAGS)
WEIGHTS_SCHEMA = _schema(
    ("control_unit", _S), ("weight", _N), ("treated", _S), ("outcome", _S), ("placebo", _S), ("treatment_date", _D)
)
BANDS_SCHEMA = _schema(
    ("study_id", _S), ("period_idx", T.IntegerType()), ("lower_ci", _N), ("upper_ci", _N),
    ("lower_rounds", T.IntegerType()), ("upper_rounds", T.IntegerType()), ("ci_status", _S),
)

# as written by the sinks: with the grid step or the method, placebo as a partition
STORED_SERIES = _schema(*[(f.name, f.dataType) for f in SERIES_SCHEMA], ("ci_step", _N))
STORED_TTEST = _schema(*[(f.name, f.dataType) for f in TTEST_SCHEMA], ("method", _S))
STORED_CONFORMAL = _schema(*[(f.name, f.dataType) for f in CONFORMAL_SCHEMA], ("method", _S))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and the literal NA for a missing value; a row that
    does not fit the schema is an error."""
    return spark.read.csv(
        path, schema=schema, header=True, nullValue="NA", mode="FAILFAST", enforceSchema=False
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet unless the path names CSV files."""
    if path.endswith(".csv"):
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def read_results(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """A saved result table; ``schema`` is one of the STORED schemas."""
    options = dict(header=True, nullValue="NA", mode="FAILFAST") if fmt == "csv" else {}
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whichever file system its scheme names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _claimed(spark: SparkSession, path: str) -> bool:
    """Whether this call made the file at ``path``, which only one call can."""
    files, target = _file_system(spark, path)
    try:
        files.create(target, False).close()
    except Py4JJavaError as err:
        if files.exists(target):
            return False
        raise err
    return True


def load_or_build(
    spark: SparkSession,
    path: str,
    builder: Callable[[SparkSession], DataFrame],
    wait_seconds: float = 3600.0,
) -> DataFrame:
    """Read the table at ``path``, building and writing it first if absent.

    Whatever exists at the path is read and left as it is: CSV if the path says so,
    else parquet. The one exception is a folder that a write cut short has left
    unfinished, which is built again. The builder is called once: not where data
    exist (a CSV table is read in the schema kept beside it, and only without one in
    the builder's), and by one of several calls at a time: the others find its claim
    and wait. A claim whose owner died is an error after ``wait_seconds``, with the
    name of the file to remove.
    """
    claim, kept = f"{path}.claim", f"{path}.schema"
    ends = time.monotonic() + wait_seconds
    while not _complete(spark, path):
        if _claimed(spark, claim):
            try:
                if not _complete(spark, path):  # else it was finished just before the claim
                    _build(spark, path, kept, builder)
            finally:
                files, target = _file_system(spark, claim)
                files.delete(target, False)
            break
        if time.monotonic() > ends:
            raise TimeoutError(f"{path} is being built elsewhere; if that has ended, remove {claim}")
        time.sleep(0.2)
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    if path_exists(spark, kept):
        text = "".join(row[0] for row in spark.read.text(kept, wholetext=True).collect())
        return read_csv(spark, path, T.StructType.fromJson(json.loads(text)))
    return read_csv(spark, path, builder(spark).schema)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a table is there that no write has left unfinished."""
    unfinished = path_exists(spark, f"{path}/_temporary") and not path_exists(spark, f"{path}/_SUCCESS")
    return path_exists(spark, path) and not unfinished


def _build(spark: SparkSession, path: str, kept: str, builder: Callable[[SparkSession], DataFrame]) -> None:
    built = builder(spark)
    mode = "overwrite" if path_exists(spark, path) else "error"
    if not path.endswith(".csv"):
        built.write.mode(mode).parquet(path)
        return
    files, target = _file_system(spark, kept)
    out = files.create(target, True)
    out.write(bytearray(built.schema.json().encode()))
    out.close()
    built.write.mode(mode).csv(path, header=True, nullValue="NA")

