"""Watching for changes: a stream of change events that triggers rescans, one at a time."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from heddle.sources.files import ignore_regex

CHANGES = "change_type string, path string, ts timestamp"
#: Changes within this time belong together.
DEBOUNCE = "1600 milliseconds"


def change_stream(spark: SparkSession, folder: str, schema: str = CHANGES, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Change events from files that appear in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


# Temporary files of editors and systems, as a regular expression for paths.
TEMPORARY = r"(?:^|/)(?:\.#[^/]*|#[^/]*#|[^/]*~|[^/]*\.sw[a-z]|4913|[^/]*\.tmp|[^/]*\.(?:crdownload|part)|\.DS_Store)$|(?:^|/)(?:\.git|__pycache__)(?:/|$)"


def relevant(changes: DataFrame, root: str = "", gitignore: list[str] = ()) -> DataFrame:
    """Changes (path, ...) but those of temporary files and of what the root's ignore lines name; a later
    line with an exclamation mark takes a path back in."""
    rel = F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/", "") if root else F.col("path")
    out = F.lit(False)
    for line in gitignore:
        if rule := ignore_regex(line):
            pattern, again = rule[0], rule[1]
            out = F.when(rel.rlike(f"^{pattern}(?:/.*)?$"), F.lit(not again)).otherwise(out)
    return changes.where(~F.col("path").rlike(TEMPORARY) & ~out)


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(change_type, path) between two listings (path, stamp); the file source itself never sees deletions."""
    j = before.select("path", F.col("stamp").alias("s0")).join(now.select("path", F.col("stamp").alias("s1")), "path", "full")
    kind = F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "deleted").when(F.col("s0") != F.col("s1"), "modified")
    return j.select(kind.alias("change_type"), "path").where("change_type is not null")


def collapse(changes: DataFrame) -> DataFrame:
    """(path, change_type, n): the last change of each path and how many there were."""
    return changes.groupBy("path").agg(F.max_by("change_type", "ts").alias("change_type"), F.count("*").alias("n"))


def watch(stream: DataFrame, rescan: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, ignore: str | None = None) -> StreamingQuery:
    """Run ``rescan`` on each batch of collapsed changes.

    Batches never overlap: what arrives during a rescan forms the next batch, which is the
    queue of one. A failing rescan is noted and the watch goes on. ``once`` works off what
    is there and ends; otherwise DEBOUNCE is the trigger. Temporary files never count.
    """
    events = relevant(stream)
    events = events.where(~F.col("path").rlike(ignore)) if ignore else events
    errors: list[str] = []

    def handle(batch: DataFrame, number: int) -> None:
        changes = collapse(batch)
        if changes.isEmpty():
            return
        try:
            rescan(changes, number)
        except Exception as e:  # noqa: BLE001
            errors.append(f"batch {number}: {e}")

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()
    query.heddle_errors = errors  # type: ignore[attr-defined]
    return query


def stop(query: StreamingQuery) -> None:
    """End a watch; ending it twice does nothing."""
    if query.isActive:
        query.stop()


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per type and window, late ones up to a limit."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # event time must carry a zone; the session's is used
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_scan(command: list[str], timeout: float | None = None) -> int:
    """Run a scan as a process of its own; its exit code, or 124 if it takes longer than ``timeout`` seconds."""
    import subprocess

    try:
        return subprocess.run(command, timeout=timeout, check=False).returncode
    except subprocess.TimeoutExpired:  # the process has been killed
        return 124


def progress(done: DataFrame, keys: list[str], window: int = 20) -> DataFrame:
    """Adds rate (completions a second over the last ``window`` of its group, null before the second) and
    n_done to completions (keys, ts, and what orders equal times as ``seq``)."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq")
    last = w.rowsBetween(-(window - 1), 0)
    span = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.min(F.col("ts").cast("timestamp")).over(last))
    return done.withColumn("n_done", F.row_number().over(w)).withColumn("rate", F.when(span > 0, (F.count("*").over(last) - 1) * 1_000_000 / span))


def eta_seconds(progress: DataFrame, total: int) -> DataFrame:
    """Adds eta: seconds until ``total`` are done at the present rate; null without one."""
    return progress.withColumn("eta", F.when(F.col("rate") > 0, F.greatest(F.lit(0), F.lit(total) - F.col("n_done")) / F.col("rate")))
