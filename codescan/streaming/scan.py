"""Files scanned as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from codescan.operators import findings as fd
from codescan.operators import secrets
from codescan.schemas import FINDING_COLUMNS
from codescan.session import write_epoch


def scan_stream(files: DataFrame, sink: str, checkpoint: str, baseline: DataFrame | None = None, rules=None,
                once: bool = False) -> StreamingQuery:
    """Line rules and literals on new (file, language, content) rows, known findings left out.

    The scan itself keeps no state; each batch is de-duplicated within its files.
    """
    def batch(rows: DataFrame, epoch: int) -> None:
        found = fd.dedupe_findings(secrets.scan_text(rows, rules)).select(*FINDING_COLUMNS)
        if baseline is not None:
            found = fd.suppress_baseline(found, baseline)
        write_epoch(found, sink, epoch)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
