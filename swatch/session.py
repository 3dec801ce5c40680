"""Session settings and lineage helpers.

Operators are DataFrame transformations (some write intermediate tables); the session only fixes the few
settings the semantics depend on (UTC, ANSI) and the ones that make the plans scale (AQE with skew
join, runtime-measured broadcast only).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  Static broadcast from file-size estimates is switched off: Parquet
# sizes are compressed sizes, so an estimate is no bound.  AQE broadcasts a join side only after the
# side has been materialised and its real size measured, and splits skewed partitions otherwise.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key on the large side of a join that feeds an aggregate on the same key must still be
    # split: the extra shuffle this allows after the join only carries partial aggregates.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def scale_conf(input_bytes: int, total_cores: int, split_bytes: int = 256 << 20,
               input_per_shuffle_partition: int = 1 << 30, max_shuffle_partitions: int = 65536) -> dict:
    """Partition sizing for a run over ``input_bytes`` on ``total_cores`` cores.

    Scans split at ``split_bytes``.  Shuffles carry projected, partially aggregated rows, several
    times less than the input, so they start with one partition per GB of input (at least two waves
    of the cores, at most ``max_shuffle_partitions`` to keep the map-output block count sane) and
    AQE coalesces small stages down to the advisory size.  100 TB on 8000 cores: 65,536 shuffle
    partitions, ~400k scan splits.
    """
    n = min(max_shuffle_partitions, max(2 * total_cores, -(-input_bytes // input_per_shuffle_partition)))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split_bytes),
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
    }


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "swatch", extra: dict | None = None,
              input_bytes: int | None = None, total_cores: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    ``master`` is only for local runs; on a cluster the launcher supplies it.  With ``input_bytes``
    and ``total_cores`` the partition sizing of ``scale_conf`` is applied.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    if input_bytes and total_cores:
        conf.update(scale_conf(input_bytes, total_cores))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable part of ``SESSION_CONF`` to an existing session."""
    for k, v in SESSION_CONF.items():
        if k == "spark.ui.enabled":
            continue
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only when the cluster names none.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used as is (unset there is
    an error).  Only a local-mode session without the setting (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name shared storage on a cluster")
        configured = tempfile.mkdtemp(prefix="swatch-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table under the shared checkpoint directory and
    reading it back.

    Used where a non-deterministic column (``monotonically_increasing_id``) must be read twice with
    the same values.  One computation of the plan (an RDD checkpoint of an uncached plan computes it
    twice), and the copy lives on the cluster's shared storage, so it survives executor loss, unlike
    ``localCheckpoint``.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/swatch-{name}-{uuid.uuid4().hex}.parquet"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
