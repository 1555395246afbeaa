"""Build reports as streams: validation, uniqueness, rolling success rate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from codescan.operators import builds as bd
from codescan.session import write_epoch


def _run(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest(reports: DataFrame, owners: DataFrame, accepted: str, rejected: str, checkpoint: str,
           once: bool = False) -> StreamingQuery:
    """Validated, owned reports go to ``accepted``, the others with their reason to ``rejected``.

    ``reports`` is a stream of the report schema plus webhook_secret and received_at.
    """
    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        checked = bd.validate_builds(bd.assign_owner(rows, owners))
        write_epoch(bd.flatten_builds(bd.valid_builds(checked).drop("owner_username")), accepted, epoch)
        bad = bd.rejected_builds(checked).select(F.col("buildId").alias("build_id"), F.array_join("errors", "; ").alias("reason"))
        lost = bd.unowned(rows, owners).select(F.col("buildId").alias("build_id"), F.lit("unknown secret").alias("reason"))
        write_epoch(bad.unionByName(lost), rejected, epoch)
        rows.unpersist()

    return _run(reports.writeStream.foreachBatch(batch), checkpoint, once)


def first_and_repeats(builds: DataFrame) -> DataFrame:
    """Adds is_first: whether a build id was never seen before, in this batch or any earlier one.

    The state holds one flag for an id, so a batch costs what it brings, however many builds are stored.  Of a
    batch the earliest report counts; the reports of one id pass through one task a chunk at a time.
    """
    columns = builds.columns

    def mark(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        for rows in chunks:
            rows = rows[columns].assign(is_first=False)
            if not state.exists:
                if held is None and len(rows) == 1:
                    held = rows
                    continue
                rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
                least = rows.sort_values(["received_at", *[c for c in columns if c != "received_at"]], kind="stable").index[:1]
                held, rows = rows.loc[least], rows.drop(least)
            if len(rows):
                yield rows
        if held is not None:
            state.update((True,))
            yield held.assign(is_first=True)

    out = StructType([*builds.schema.fields, StructField("is_first", BooleanType())])
    return builds.groupBy("build_id").applyInPandasWithState(
        mark, out, StructType([StructField("seen", BooleanType())]), "append", GroupStateTimeout.NoTimeout)


def dedupe(builds: DataFrame, sink: str, conflicts: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """The first report per build id goes to ``sink``, every repeat to ``conflicts``, however late either comes.

    No state expires, so ids stay unique for good; nothing that was written is read again.
    """
    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        write_epoch(rows.where("not is_first").drop("is_first"), conflicts, epoch)
        write_epoch(rows.where("is_first").drop("is_first"), sink, epoch)
        rows.unpersist()

    return _run(first_and_repeats(builds).writeStream.foreachBatch(batch), checkpoint, once)


def success_rate(builds: DataFrame, window: str = "30 days", slide: str = "1 day", delay: str = "1 day", panes: bool = True) -> DataFrame:
    """Builds, successes and success percentage per sliding window; batch or stream.

    Builds are counted once, in the pane of one slide they fall into; a window, a multiple of the slide long, sums its panes.
    A stream in complete mode has one aggregation only: without ``panes`` a build is counted in each of its windows.
    """
    rows = builds.withWatermark("received_at", delay) if builds.isStreaming else builds
    counted = rows.groupBy(F.window("received_at", slide).alias("pane")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("good"))
    return (
        (counted.groupBy(F.window(F.window_time("pane"), window, slide).alias("w"))
         .agg(F.sum("n").alias("builds"), F.sum("good").alias("successes")) if panes
         else rows.groupBy(F.window("received_at", window, slide).alias("w")).agg(
             F.count("*").alias("builds"), F.count_if(F.col("status") == "success").alias("successes")))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "builds", "successes",
                F.floor(F.col("successes") * 100 / F.col("builds") + 0.5).cast("long").alias("success_rate"))
    )


def write_success_rate(builds: DataFrame, sink: str, checkpoint: str, mode: str = "append", once: bool = False,
                       **options) -> StreamingQuery:
    """Append mode writes a window once it is closed; complete mode replaces all windows each time."""
    def batch(rows: DataFrame, epoch: int) -> None:
        if mode == "complete":
            rows.write.mode("overwrite").parquet(sink)
        else:
            write_epoch(rows, sink, epoch)

    return _run(success_rate(builds, panes=mode == "append", **options).writeStream.outputMode(mode).foreachBatch(batch), checkpoint, once)
