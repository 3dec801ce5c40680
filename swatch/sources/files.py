"""Order-file discovery and scan.

Files are read as text (every column ``string``): numbers and dates are typed later by the ingest
operators, so nothing is damaged by inference (phone numbers keep their form).  Each row carries
``_file`` (the whole path, as two folders may hold one name) and ``_ordinal`` (file block start and row position), which give "first
row in the file" a meaning after a distributed read.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCK_PREFIX = "~$"


def read_order_files(spark: SparkSession, path: str, suffixes: Sequence[str] = (".csv",), fmt: str = "csv",
                     options: dict | None = None, recursive: bool = False) -> DataFrame:
    """S3 + S4: every file under ``path`` whose name ends with one of ``suffixes`` and does not start
    with the lock-file prefix, as text, with ``_file`` and ``_ordinal``.

    CSV is read with its header row; JSON and Parquet carry their own column names.  Files of one
    read must share their header (another order of columns fails); ``recursive`` also reads subfolders;
    ``read_mixed_order_files`` reads files of any headers.
    """
    reader = spark.read.options(**(options or {}))
    globs = [f"*{s}" for s in suffixes]
    reader = reader.option("pathGlobFilter", globs[0] if len(globs) == 1 else "*{" + ",".join(suffixes) + "}")
    reader = reader.option("recursiveFileLookup", str(recursive).lower())
    if fmt == "csv":
        df = reader.option("header", "true").option("inferSchema", "false").option("enforceSchema", "false").csv(path)
    elif fmt == "json":
        df = reader.option("primitivesAsString", "true").json(path)
    else:
        df = reader.format(fmt).load(path)
    return _with_place(df)


def _with_place(df: DataFrame) -> DataFrame:
    """Text columns with the row's file and place in it; lock files left out."""
    df = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns],
                   F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_name").alias("_name"),
                   F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_pos"))
    df = df.where(~F.col("_name").startswith(LOCK_PREFIX)).drop("_name")
    return (df.withColumn("_ordinal", F.struct("_block", "_pos")).drop("_block", "_pos"))


def order_file_headers(spark: SparkSession, path: str, suffixes: Sequence[str] = (".csv",), recursive: bool = False,
                       threads: int = 16) -> dict[tuple[str, ...], list[str]]:
    """Header row → files that have it, in order of the file names.  Only the first line of each file is read, by the driver,
    several files at a time: what a listing costs.  Files without any line are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found, listing = [], fs.listFiles(root, recursive)
    while listing.hasNext():
        p = listing.next().getPath()
        if p.getName().endswith(tuple(suffixes)) and not p.getName().startswith((LOCK_PREFIX, "_", ".")):
            found.append(p)

    def header(p) -> tuple[str, ...]:
        stream = fs.open(p)
        try:
            codec = codecs.getCodec(p)
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
                codec.createInputStream(stream) if codec is not None else stream, "UTF-8"))
            line = lines.readLine()
        finally:
            stream.close()
        return tuple(next(csv.reader([line.removeprefix("\ufeff")]), ())) if line else ()

    groups: dict[tuple[str, ...], list[str]] = {}
    found.sort(key=lambda p: p.toString())
    with ThreadPoolExecutor(threads) as pool:
        for p, names in zip(found, pool.map(header, found)):
            if names:
                groups.setdefault(names, []).append(p.toString())
    return groups


def read_mixed_order_files(spark: SparkSession, path: str, suffixes: Sequence[str] = (".csv",),
                           options: dict | None = None, recursive: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """S3 + S4 over CSV files that need not share their header: files are grouped by header row, each group is one scan, and
    ``union_with_presence`` combines them.  Returns the frame and its ``present`` map."""
    frames = []
    for names, files in order_file_headers(spark, path, suffixes, recursive).items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        reader = spark.read.options(**(options or {})).option("header", "true").option("enforceSchema", "false")
        frames.append(_with_place(reader.schema(schema).csv(files)))
    if not frames:
        raise FileNotFoundError(f"no order files in {path}")
    return union_with_presence(frames)


def union_with_presence(frames: Sequence[DataFrame], skip: Sequence[str] = ("_file", "_ordinal")
                        ) -> tuple[DataFrame, dict[str, str]]:
    """Union order-file reads of different headers by name, with a ``_has_<column>`` flag per column
    telling whether the row's file carried it.  Returns the frame and the ``present`` map that
    ``operators.merge.upsert`` takes, so a column a file lacks never overwrites the target.
    """
    cols: list[str] = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols and c not in skip]
    parts = []
    for f in frames:
        parts.append(f.select(*[F.col(c) if c in f.columns else F.lit(None).cast("string").alias(c) for c in cols],
                              *[F.col(c) for c in skip if c in f.columns],
                              *[F.lit(c in f.columns).alias(f"_has_{c}") for c in cols]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, {c: f"_has_{c}" for c in cols}
