"""Parquet tables and reliable lineage cuts."""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the directory; times are read as UTC."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The copy survives the loss of executors. Sessions started with ``spark.cleaner.referenceTracking.cleanCheckpoints``
    remove it when it is no longer referred to.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``; on one machine, where that is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "mnemora-checkpoints")


def write_version(df: DataFrame, table: str) -> str:
    """Write ``df`` as the next version of a table folder, whole or not at all: its folder's path.

    A version is written beside the others; only then a pointer file is replaced, in one rename. Readers see the old
    version until that moment, and a job that fails leaves it as it was. Writers must not overlap.
    """
    spark = df.sparkSession
    fs, path = _files(spark, table)
    n = max([0, *(int(s.getPath().getName()[1:]) for s in fs.listStatus(path(table)) if s.getPath().getName().startswith("v"))]) + 1 if fs.exists(path(table)) else 1
    name = f"v{n:08d}"
    df.write.mode("error").parquet(f"{table}/{name}")
    made = fs.create(path(f"{table}/_current.new"), True)
    made.writeBytes(name)
    made.close()
    jvm = spark.sparkContext._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(table).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(path(f"{table}/_current.new"), path(f"{table}/_current"), how)
    return f"{table}/{name}"


def read_version(spark: SparkSession, table: str) -> DataFrame:
    """The version of a table that ``write_version`` has written last."""
    fs, path = _files(spark, table)
    f = fs.open(path(f"{table}/_current"))
    name = f.readLine()
    f.close()
    return spark.read.parquet(f"{table}/{name}")


def append_log(rows: DataFrame, folder: str) -> None:
    """Append rows of the event log (with ts), one folder for each day."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(folder)


@contextmanager
def logged(spark: SparkSession, folder: str, tool: str, agent: str | None = None) -> Iterator[dict]:
    """Log a tool call around a block: latency, what the block puts into the dictionary it gets, and an error if there is one (which goes on)."""
    detail: dict = {}
    began = time.time()
    try:
        yield detail
    except Exception as e:
        detail["error"] = f"{type(e).__name__}: {e}"[:200]
        raise
    finally:
        row = (datetime.now(timezone.utc).replace(tzinfo=None), "tool_call", tool, agent, int((time.time() - began) * 1000), json.dumps(detail, sort_keys=True))
        append_log(spark.createDataFrame([row], "ts timestamp_ntz, op string, tool string, agent string, latency_ms int, detail string"), folder)


def _files(spark: SparkSession, table: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

