"""Versioned table snapshots and result sinks.

Every attempt to publish writes its tables into a folder of its own, ``<base>/v=<version>/<attempt>/<table>.parquet``, so
what a killed attempt left behind is never in the way of the next one.  Publishing then adds one entry,
``<base>/_published/<number>.json``: the version, and for every table of the set its schema and the folders
that hold it.  The entry is written beside its place and moved there without overwriting, which only
one of several writers can do: readers see the old set or the whole new one, and no entry is ever rewritten.

A writer that finds its number taken looks at what the other one published.  If that touched none of the tables
that it writes or was derived from, it takes the next number with the other's tables carried forward; otherwise it fails with
``PublishConflict`` and the caller starts again from the new state.  Tables that a publish does not pass are carried forward by name, without a copy.

A table may be published in buckets (a hash of its key, one folder each).  ``rewrite_buckets`` and ``sync_snapshot`` read and write
only the buckets that hold a changed key; the entry shares all other folders with the version before.

Errors while reading raise; only a missing ``_published`` folder means that nothing is published.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.operators import merge as mg
from swatch.operators.ids import assign_ids, next_id
from swatch.operators.merge import ACTION, INSERTED, UNCHANGED, MergeResult
from swatch.operators.quality import duplicate_keys, key_clashes
from swatch.session import materialize
from swatch.sources.tables import empty_table, read_table  # noqa: F401  (read_table: for callers)

PUBLISHED = "_published"
ENTRY = "seq long, version string, tables map<string, struct<key: string, schema: string, paths: array<string>>>"
BUCKET = "_bucket"


class PublishConflict(RuntimeError):
    """Another writer published a table that this one writes or was derived from."""


def version_dir(base: str, version: str) -> str:
    return f"{base.rstrip('/')}/v={version}"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, asked of the file system that holds it; none if it does not exist."""
    fs, p = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with ``text`` in one step, or return False if there is one."""
    fs, target = _file_system(spark, path)
    folder, name = path.rsplit("/", 1)
    beside = f"{folder}/_{name}.{uuid.uuid4().hex}"  # readers pass over names that begin with "_"
    _, source = _file_system(spark, beside)
    fs.mkdirs(source.getParent())
    if fs.getScheme() == "file":
        local, own = target.toUri().getPath(), source.toUri().getPath()
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, local)  # fails if the name exists
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    out = fs.create(source, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration()).rename(
            source, target, options)
        return True
    except Exception:  # noqa: BLE001  (py4j wraps the file system's own exception)
        fs.delete(source, False)
        if not fs.exists(target):
            raise
        return False


def current(spark: SparkSession, base: str) -> Row | None:
    """The newest published entry, or None before the first publish."""
    folder = f"{base.rstrip('/')}/{PUBLISHED}"
    names = [n for n in _names(spark, folder) if n.endswith(".json") and not n.startswith(("_", "."))]
    return spark.read.schema(ENTRY).json(f"{folder}/{names[-1]}").first() if names else None


def current_version(spark: SparkSession, base: str) -> str | None:
    """The published version, or None before the first publish."""
    entry = current(spark, base)
    return entry["version"] if entry else None


def is_published(spark: SparkSession, base: str, version: str) -> bool:
    """Whether any entry, the newest or an older one, has this version."""
    folder = f"{base.rstrip('/')}/{PUBLISHED}"
    if not _names(spark, folder):
        return False
    return bool(spark.read.schema("version string").json(folder).where(F.col("version") == version).limit(1).count())


def read_entry(spark: SparkSession, base: str, entry: Row | None, name: str,
               buckets: Sequence[int] | None = None) -> DataFrame:
    """A table as one entry holds it (only some of its buckets, if given)."""
    if entry is None or name not in entry["tables"]:
        return empty_table(spark, name)
    held = entry["tables"][name]
    schema = T.StructType.fromJson(json.loads(held["schema"]))
    paths = [held["paths"][b] for b in buckets] if buckets is not None else held["paths"]
    paths = [f"{base.rstrip('/')}/{p}" for p in paths if p]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_current(spark: SparkSession, base: str, name: str) -> DataFrame:
    """S1 over a snapshot set: the table as last published, or an empty one (S6) if none of it was."""
    return read_entry(spark, base, current(spark, base), name)


def bucket_of(key: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _write(spark: SparkSession, base: str, attempt: str, name: str, df: DataFrame, key: str | None, n: int) -> dict:
    """Write a table into the attempt's folder; returns what an entry holds of it."""
    folder = f"{attempt}/{name}.parquet"
    path = f"{base.rstrip('/')}/{folder}"
    held = {"key": key, "schema": df.schema.json(), "paths": [folder]}
    if key is None:
        df.write.mode("errorifexists").parquet(path)
        return held
    (df.withColumn(BUCKET, bucket_of(key, n)).repartition(BUCKET).write.mode("errorifexists")
     .partitionBy(BUCKET).parquet(path))
    found = {x for x in _names(spark, path) if x.startswith(f"{BUCKET}=")}
    held["paths"] = [f"{folder}/{BUCKET}={b}" if f"{BUCKET}={b}" in found else "" for b in range(n)]
    return held


def _begin(spark: SparkSession, base: str, version: str) -> str:
    """The folder of a new attempt, relative to ``base``."""
    if is_published(spark, base, version):
        raise ValueError(f"version {version} is already published")
    return f"v={version}/{uuid.uuid4().hex}"


def _commit(spark: SparkSession, base: str, version: str, before: Row | None, changed: Mapping[str, dict],
            depends: Sequence[str] = ()) -> None:
    own = {name: held.asDict(True) for name, held in (before["tables"] if before else {}).items()}
    seen, seq = dict(own), before["seq"] if before else 0
    while True:
        text = json.dumps({"seq": seq + 1, "version": version, "tables": {**own, **changed}}, ensure_ascii=False)
        if put_if_absent(spark, f"{base.rstrip('/')}/{PUBLISHED}/{seq + 1:012d}.json", text + "\n"):
            return
        now = current(spark, base)
        own, seq = {name: held.asDict(True) for name, held in now["tables"].items()}, now["seq"]
        clash = [name for name in {*changed, *depends} if own.get(name) != seen.get(name)]
        if clash or is_published(spark, base, version):
            raise PublishConflict(f"version {version}: {', '.join(sorted(clash)) or 'the version'} published meanwhile")


_NEWEST = object()


def publish(spark: SparkSession, base: str, version: str, tables: Mapping[str, DataFrame],
            drop_columns: Sequence[str] = (ACTION,), buckets: Mapping[str, tuple[str, int]] | None = None,
            based_on=_NEWEST, depends: Sequence[str] = ()) -> str:
    """Write the tables into a folder of this attempt, then add the version's entry; other tables are carried forward.

    ``buckets`` maps a table to its key and number of buckets.  ``based_on`` is the entry (``current``) that the tables
    were derived from, by default the newest now, and ``depends`` names tables that were read for them.  A version is published once: a
    retry of an attempt that died before its entry succeeds, one after it raises ``ValueError``."""
    before = current(spark, base) if based_on is _NEWEST else based_on
    attempt = _begin(spark, base, version)
    changed = {}
    for name, df in tables.items():
        key, n = (buckets or {}).get(name, (None, 0))
        changed[name] = _write(spark, base, attempt, name, df.drop(*drop_columns), key, n)
    _commit(spark, base, version, before, changed, depends)
    return f"{base.rstrip('/')}/{attempt}"


def _rewrite(spark: SparkSession, base: str, entry: Row, attempt: str, name: str, keys: DataFrame,
             merge: Callable[[DataFrame], DataFrame], drop_columns: Sequence[str]) -> tuple[dict, list[int]]:
    held = entry["tables"][name].asDict(True)
    if held["key"] is None:
        raise ValueError(f"{name} is not published in buckets")
    n = len(held["paths"])
    touched = sorted(r[0] for r in keys.select(bucket_of(held["key"], n)).distinct().collect())  # n numbers at most
    if touched:
        merged = merge(read_entry(spark, base, entry, name, touched)).drop(*drop_columns)
        new = _write(spark, base, attempt, name, merged, held["key"], n)["paths"]
        if stray := [b for b in range(n) if new[b] and b not in touched]:
            raise ValueError(f"{name}: rows for buckets {stray} that hold none of the keys")
        held["paths"] = [new[b] if b in touched else p for b, p in enumerate(held["paths"])]
    return held, touched


def rewrite_buckets(spark: SparkSession, base: str, version: str, name: str, keys: DataFrame,
                    merge: Callable[[DataFrame], DataFrame], drop_columns: Sequence[str] = (ACTION,)) -> list[int]:
    """Copy-on-write change of a bucketed table: ``merge`` gets the buckets that hold one of ``keys`` (a column named as the
    table's key) and returns their new rows, which must not leave them.  Returns the buckets written."""
    entry = current(spark, base)
    attempt = _begin(spark, base, version)
    held, touched = _rewrite(spark, base, entry, attempt, name, keys, merge, drop_columns)
    _commit(spark, base, version, entry, {name: held})
    return touched


def sync_snapshot(spark: SparkSession, base: str, version: str, source: DataFrame,
                  routes: Mapping[str, Sequence[str]], as_of, key: str = "order_id") -> dict[str, list[int]]:
    """M7 on bucketed tables: the source's changes are found from the keys and times of the targets alone, and only
    the buckets of changed keys are read in full and written; one entry for all routes.  Returns the buckets written."""
    entry = current(spark, base)
    attempt = _begin(spark, base, version)
    changed, touched = {}, {}
    for name, types in routes.items():
        target = read_entry(spark, base, entry, name)
        rows = materialize(mg.sync_changes(target, source, types, key), "sync-changes")
        after = next_id(target)
        changed[name], touched[name] = _rewrite(
            spark, base, entry, attempt, name, rows,
            lambda part, rows=rows, types=types, after=after: mg.sync_route(part, rows, types, as_of, key, first_id=after),
            (ACTION,))
    _commit(spark, base, version, entry, changed)
    return touched


def upsert_snapshot(spark: SparkSession, base: str, version: str, name: str, batch: DataFrame, as_of,
                    key: str = "order_id", **options) -> list[int]:
    """M1/M2 on a bucketed table: only the buckets of the batch's keys are read and written."""
    target = read_current(spark, base, name)
    batch = materialize(batch.where(F.col(key).isNotNull()), "upsert-batch")
    after = next_id(target)
    return rewrite_buckets(spark, base, version, name, batch.select(key),
                           lambda part: mg.upsert(part, batch, as_of, key, first_id=after, **options).table)


def ensure_tables(spark: SparkSession, base: str, version: str, names: Sequence[str]) -> str:
    """Create those of ``names`` that no published version holds, as empty tables of their declared
    schema; the others are carried over.  Recreating is publishing a version of empty tables."""
    entry = current(spark, base)
    missing = [n for n in names if entry is None or n not in entry["tables"]]
    return publish(spark, base, version, {n: empty_table(spark, n) for n in missing})


def write_csv(df: DataFrame, path: str, sort_by: Sequence[str] | None = None) -> None:
    """CSV with a header row; with ``sort_by`` the part files are in global order (range
    partitioned sort), without collapsing the output into one task."""
    out = df.orderBy(*sort_by) if sort_by else df
    out.write.mode("overwrite").option("header", "true").csv(path)


def append_load(target: DataFrame, batch: DataFrame, key: str = "order_id") -> MergeResult:
    """Append a batch whose keys are all new, all or nothing.

    The batch is aligned to the target by name.  If a key repeats in the batch or already exists in
    the target (Q2), nothing is inserted and every batch row counts as an error.
    """
    clashes = duplicate_keys(batch, key).select(key).unionByName(key_clashes(batch, target, key).select(key))
    clash = clashes.limit(1).count() > 0
    n_batch = batch.agg(F.count(F.lit(1)).alias("n"))
    if clash:
        stats = n_batch.select(F.lit(0).cast("long").alias("inserted"), F.col("n").alias("errors"))
        return MergeResult(target.withColumn(ACTION, F.lit(UNCHANGED)), stats)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in batch.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema.fields if f.name != "id"]
    new = batch.select(*cols)
    if "id" in target.columns:
        new = assign_ids(new, [key], start=next_id(target))
    table = (target.withColumn(ACTION, F.lit(UNCHANGED))
             .unionByName(new.withColumn(ACTION, F.lit(INSERTED)).select(*target.columns, ACTION)))
    stats = n_batch.select(F.col("n").alias("inserted"), F.lit(0).cast("long").alias("errors"))
    return MergeResult(table, stats)
