"""Incremental upsert: landing files stream into a table that keeps the latest record of each key.

The table is a log of buckets (hashes of the key).  A batch writes its own latest rows, bucket by
bucket, into a folder of its number, and reads nothing for it; readers take the latest of a bucket's
folders.  The manifest of a batch names the folders of every bucket.  A bucket with too many of
them is compacted into one, a fixed share of the buckets at a time, so what a batch reads stays level
however many batches there were.

A batch counts once its manifest is complete.  One that is replayed after that does nothing; one
that broke off before is written again from the manifest before it, so the sink is exactly once.
Files that a kept manifest names never change.  Rows older than the watermark, the latest event time of
the earlier batches less the allowed lateness, go to a side table and are counted in the manifest.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LATE = -1


@dataclass
class Manifest:
    """State of the table after a batch: (folder, bytes) by bucket, oldest first; and what the batch did."""

    batch: int = -1
    key: str = ""
    order: str = ""
    folders: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    late: list[str] = field(default_factory=list)
    latest_event: int | None = None
    rows: int = 0
    late_rows: int = 0
    read_bytes: int = 0
    written_bytes: int = 0


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _bytes(spark: SparkSession, folder: str) -> int:
    path, fs = _at(spark, folder)
    return fs.getContentSummary(path).getLength()


def _complete(spark: SparkSession, target: str, batch_id: int) -> bool:
    path, fs = _at(spark, f"{target}/manifest/batch={batch_id}/_SUCCESS")
    return fs.exists(path)


def manifest(spark: SparkSession, target: str, before: int | None = None) -> Manifest:
    """That of the newest batch (below ``before``); an empty one for a table without any."""
    ids = sorted((int(n.split("=")[1]) for n in _children(spark, f"{target}/manifest") if n.startswith("batch=")), reverse=True)
    for i in ids:
        if (before is None or i < before) and _complete(spark, target, i):
            return Manifest(**json.loads(spark.read.text(f"{target}/manifest/batch={i}").first()[0]))
    return Manifest()


def _commit(spark: SparkSession, target: str, state: Manifest) -> None:
    """Write the manifest: it counts once the writer has added its mark of success."""
    spark.createDataFrame([(json.dumps(asdict(state)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/manifest/batch={state.batch}")


def _read(spark: SparkSession, target: str, folders: dict[str, list], buckets: list[str] | None = None) -> DataFrame:
    paths = [f"{target}/data/{folder}/bucket={b}" for b in (buckets if buckets is not None else folders) for folder, _ in folders[b]]
    return spark.read.option("mergeSchema", True).parquet(*paths)


def _latest(rows: DataFrame, key: str, order: str, by: list[str]) -> DataFrame:
    """One row per key: the last by ``order``, a later batch before an earlier one."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(order), F.desc("_batch"), F.desc(F.xxhash64(*[c for c in rows.columns if rows.schema[c].dataType.typeName() != "map"])))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The latest record of each key (as of the batches below ``before``); None for a table without any."""
    state = manifest(spark, target, before)
    if not state.folders:
        return None
    return _latest(_read(spark, target, state.folders), state.key, state.order, [state.key]).withColumnRenamed("_batch", "batch")


def late_rows(spark: SparkSession, target: str) -> DataFrame | None:
    """Rows that came after the watermark had passed them, with their batch; None if there are none."""
    late = manifest(spark, target).late
    return spark.read.option("mergeSchema", True).parquet(*[f"{target}/data/{f}/bucket={LATE}" for f in late]).withColumnRenamed("_batch", "batch") if late else None


def merge(batch: DataFrame, batch_id: int, target: str, key: str, order: str, buckets: int = 64, event_time: str | None = None, late: str = "7 days", most: int = 8, spread: int = 1, keep: int = 3) -> Manifest:
    """Add a batch to the table: rows with a null key are left out; a later batch wins a tie of ``order``.

    ``buckets``: choose them so that one is some hundred MB, or raise ``spread``, the tasks (and files) of
    a bucket.  ``most``: folders of a bucket before it is compacted; a batch compacts at most a
    ``most``-th of the buckets, those with the most folders.  ``keep``: manifests that stay readable;
    what only older ones name is removed.  The number of buckets can't change later.
    """
    spark = batch.sparkSession
    if _complete(spark, target, batch_id):
        return manifest(spark, target, batch_id + 1)
    old = manifest(spark, target, batch_id)
    state = Manifest(batch_id, key, order, {b: list(f) for b, f in old.folders.items()}, list(old.late), old.latest_event)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    at = F.unix_micros(F.try_to_timestamp(F.col(event_time).cast("string"))) if event_time else F.lit(None).cast("long")
    if old.latest_event is not None:
        passed = F.unix_micros(F.timestamp_micros(F.lit(old.latest_event)) - F.expr(f"interval {late}"))
        bucket = F.when(at < passed, LATE).otherwise(bucket)
    fresh = batch.where(F.col(key).isNotNull()).withColumns({"bucket": bucket, "_batch": F.lit(batch_id), "_spread": F.pmod(F.xxhash64(key, F.lit(1)), F.lit(spread)), "_at": at})
    # late rows stay as they came; of the others the last of each key, dealt as they are written
    split = F.when(F.col("bucket") == LATE, F.monotonically_increasing_id())
    fresh = fresh.withColumn("_late", split).repartition("bucket", "_spread")
    _latest(fresh, key, order, ["bucket", "_spread", key, "_late"]).drop("_spread", "_late").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/{batch_id}")
    _listed(spark, target, str(batch_id), state)
    if state.written_bytes:
        written = spark.read.schema("_at long, bucket int").option("basePath", f"{target}/data/{batch_id}").parquet(f"{target}/data/{batch_id}")
        found = written.agg(F.max(F.when(F.col("bucket") != LATE, F.col("_at"))).alias("at"), F.count("*").alias("n"), F.count_if(F.col("bucket") == LATE).alias("late")).first()
        state.rows, state.late_rows = found.n - found.late, found.late
        state.latest_event = max((x for x in (old.latest_event, found.at) if x is not None), default=None)
    full = sorted((b for b, f in state.folders.items() if len(f) > most), key=lambda b: (-len(state.folders[b]), (int(b) - batch_id) % buckets))
    if full := full[: -(-buckets // most)]:
        state.read_bytes = sum(n for b in full for _, n in state.folders[b])
        rows = _read(spark, target, state.folders, full).withColumns({"bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), "_spread": F.pmod(F.xxhash64(key, F.lit(1)), F.lit(spread))})
        rows = _latest(rows.repartition("bucket", "_spread"), key, order, ["bucket", "_spread", key])
        rows.drop("_spread").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/{batch_id}c")
        for b in full:
            state.folders[b] = []
        _listed(spark, target, f"{batch_id}c", state)
    _commit(spark, target, state)
    vacuum(spark, target, keep)
    return state


def _listed(spark: SparkSession, target: str, folder: str, state: Manifest) -> None:
    """Note the buckets that a folder holds."""
    for name in _children(spark, f"{target}/data/{folder}"):
        if name.startswith("bucket="):
            size = _bytes(spark, f"{target}/data/{folder}/{name}")
            state.written_bytes += size
            if (b := name.split("=")[1]) == str(LATE):
                state.late.append(folder)
            else:
                state.folders.setdefault(b, []).append((folder, size))


def vacuum(spark: SparkSession, target: str, keep: int = 3) -> None:
    """Remove manifests older than the newest ``keep``, and data that no kept manifest names."""
    ids = sorted(int(n.split("=")[1]) for n in _children(spark, f"{target}/manifest") if n.startswith("batch="))
    done = [i for i in ids if _complete(spark, target, i)]
    if len(done) <= keep:
        return
    for i in [i for i in ids if i < done[-keep]]:
        path, fs = _at(spark, f"{target}/manifest/batch={i}")
        fs.delete(path, True)
    kept = [Manifest(**json.loads(r[0])) for r in spark.read.text([f"{target}/manifest/batch={i}" for i in done[-keep:]]).collect()]
    named = {(folder, b) for m in kept for b, folders in m.folders.items() for folder, _ in folders} | {(folder, str(LATE)) for m in kept for folder in m.late}
    whole = {folder for folder, _ in named}
    for folder in _children(spark, f"{target}/data"):
        gone = [folder] if folder not in whole else [f"{folder}/{n}" for n in _children(spark, f"{target}/data/{folder}") if n.startswith("bucket=") and (folder, n.split("=")[1]) not in named]
        for name in gone:
            path, fs = _at(spark, f"{target}/data/{name}")
            fs.delete(path, True)


def run(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, order: str, event_time: str | None = None, late: str = "7 days", max_files: int = 100, **options) -> None:
    """Take in all landing files that are there, batch by batch, and stop.

    With ``event_time`` rows that are later than ``late`` go to the side table; ``options`` are those of ``merge``.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(source)
    sink = lambda df, i: merge(df, i, target, key, order, event_time=event_time, late=late, **options) and None
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
