"""Incremental loads with Structured Streaming.

The system we reproduce has no streaming; its loads are batch jobs over order files.  This module
only drives the existing batch operators from a file stream: each micro-batch of newly arrived
order files is cleaned (``operators.ingest``), upserted (``operators.merge.upsert``) into the
current snapshot and published as a new version named after the stream and the batch.  ``foreachBatch`` may run a batch again;
the version of a batch is always the same, a version is published once, and what a killed attempt wrote is in no one's way, so
every batch is published exactly once.  The stream's id is part of the version because batch numbers start
from 0 again with a new checkpoint.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.operators import ingest as ing
from swatch.operators.merge import upsert
from swatch.schemas import HEADER_MAP, ORIGINAL_ORDERS
from swatch.sources import snapshots as snap
from swatch.sources.files import LOCK_PREFIX


def order_file_stream(spark: SparkSession, path: str, headers=tuple(HEADER_MAP)) -> DataFrame:
    """A file stream of CSV order files (all columns text) with ``_file`` and ``_block``; the row
    ordinal is added per micro-batch (``upsert_batches``), where position ids are allowed.

    A stream has one schema: ``headers`` must be the header row of the files, which Spark checks
    against every file (a file with other headers fails instead of being read by position).
    """
    schema = T.StructType([T.StructField(h, T.StringType(), True) for h in headers])
    df = (spark.readStream.schema(schema).option("header", "true").option("pathGlobFilter", "*.csv")
          .option("enforceSchema", "false").csv(path))
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("_name"),
                   F.col("_metadata.file_block_start").alias("_block"))
    return df.where(~F.col("_name").startswith(LOCK_PREFIX)).drop("_name")


def upsert_batches(base: str, table: str = "original_orders", as_of=None, preserve_created: bool = True,
                   stream: str | None = None):
    """``foreachBatch`` function: clean the micro-batch, upsert it into ``table`` of the snapshot set
    at ``base`` (later files win), and publish version ``<stream>-b<batch id>``.  ``stream`` is by default the query's id, which
    lives in its checkpoint: a restart goes on with it, a new checkpoint has a new one."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = stream or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise RuntimeError("no stream id: call from foreachBatch or pass stream=")
        version = f"{name}-b{batch_id:012d}"
        if snap.is_published(spark, base, version):
            return  # already published by an earlier attempt of this batch
        entry = snap.current(spark, base)
        stamp = as_of or _dt.datetime.now().replace(microsecond=0)
        rows = batch.withColumn("_ordinal", F.struct("_block", F.monotonically_increasing_id())).drop("_block")
        good, _ = ing.prepare_batch(ing.preprocess(rows), ORIGINAL_ORDERS, stamp, align=False)
        target = snap.read_entry(spark, base, entry, table)
        res = upsert(target, good.drop("_ordinal"), stamp, order="_file", preserve_created=preserve_created)
        snap.publish(spark, base, version, {table: res.table}, based_on=entry)

    return run
