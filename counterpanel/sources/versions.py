"""Result versions: all tables of a run, visible together or not at all.

A version's tables are written to a folder of their own, and its manifest last, by a
job whose commit marker makes it count. A run that is cut short leaves tables without
a manifest, which no reader sees; earlier versions stay as they are.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "name string, partitions array<string>, schema string, rows bigint, fmt string"


def commit_version(
    spark: SparkSession, base: str, tables: dict[str, tuple[DataFrame, list[str]]], fmt: str = "parquet"
) -> str:
    """Write ``tables`` (name: table, partition columns) as one version; its name.

    Names ascend with time. Each table is written once and counted from what was
    written; the manifest holds schemas, so CSV reads back in the right types.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    entries = []
    for name, (df, partitions) in tables.items():
        writer = df.write.partitionBy(*partitions) if partitions else df.write
        if fmt == "csv":
            writer = writer.option("header", True).option("nullValue", "NA")
        writer.format(fmt).save(f"{base}/versions/{version}/{name}")
        schema = T.StructType([f for f in df.schema if f.name not in partitions] + [df.schema[p] for p in partitions])
        rows = _read(spark, base, version, name, schema, fmt).count()
        entries.append((name, partitions, schema.json(), rows, fmt))
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.json(f"{base}/manifests/{version}")
    return version


def _read(spark: SparkSession, base: str, version: str, name: str, schema: T.StructType, fmt: str) -> DataFrame:
    options = dict(header=True, nullValue="NA", mode="FAILFAST") if fmt == "csv" else {}
    return spark.read.schema(schema).format(fmt).options(**options).load(f"{base}/versions/{version}/{name}")


def committed_versions(spark: SparkSession, base: str) -> list[str]:
    """Versions with a committed manifest, oldest first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{base}/manifests")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [status.getPath() for status in files.listStatus(folder) if status.isDirectory()]
    return sorted(p.getName() for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_version(spark: SparkSession, base: str, version: str | None = None) -> dict[str, DataFrame]:
    """Tables of a version, by default the newest; a table without its rows is an error."""
    known = committed_versions(spark, base)
    version = version or (known[-1] if known else None)
    if version not in known:
        raise FileNotFoundError(f"no committed version {version or ''} at {base}".replace("  ", " "))
    manifest = spark.read.schema(MANIFEST).json(f"{base}/manifests/{version}").collect()
    return {
        m["name"]: _read(spark, base, version, m["name"], T.StructType.fromJson(json.loads(m["schema"])), m["fmt"])
        for m in manifest
    }


def tagged(df: DataFrame, **values) -> DataFrame:
    """``df`` with constant columns, NULL ones as strings or doubles by their value."""
    return df.withColumns({k: F.lit(v) if v is not None else F.lit(None).cast("double") for k, v in values.items()})
