"""Session settings: where shared intermediate tables may be written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}  # by application, in order


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    A temporary local folder is used only where the setting is absent and the
    master is local; a cluster without the setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="counterpanel-")
    return _local_dirs[app]


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor, so a table used
    by several later jobs is computed once. Tables of one application share a
    folder named after it, which may be deleted when the application is over.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/counterpanel/{app}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(app, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written(spark: SparkSession) -> list[str]:
    """Paths of this application's written tables, oldest first."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    known = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in known:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            known.remove(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by key over all cores, a few waves deep.

    Used ahead of grouped tasks that compute far more than they read: adaptive
    execution would otherwise merge their small partitions into a few tasks.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(partitions, 4 * spark.sparkContext.defaultParallelism), *keys)
