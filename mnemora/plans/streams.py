"""Queries that run as streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators import ledger
from mnemora.plans.ledger import _FOLD
from mnemora.sources import read_table, shared_folder
from mnemora.streaming.ledger import decide, run_available


def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of the ledger fold, over the memories read as a stream of files."""
    schema = read_table(spark, sf_dir, "memories").schema
    path = f"{sf_dir}/memories.parquet"
    reader = spark.readStream.schema(schema)
    source = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "memories.parquet").parquet(sf_dir)
    said = ledger.statements(source).withColumn("key", F.to_json(F.struct(*ledger.KEY))).select("key", "seq", "value", "text", "obs")
    out = run_available(spark, decide(said), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    return out.select(F.from_json("key", "domain string, subject_id long, relation string").alias("k"), "seq", "outcome").select("k.*", "seq", "outcome")


QUERIES = {"ledger_stream": ledger_stream}
SQL = {"ledger_stream": _FOLD + " SELECT domain, subject_id, relation, seq, outcome FROM f"}
