"""Appending a stream to a stripe table, exactly once per micro-batch.

The engine has no streaming operators of its own; Structured Streaming's results are stored batch by batch.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..manifest import Manifest
from ..operators.table import StripeTable


def append_stream(stream: DataFrame, table: StripeTable, checkpoint: str, name: str, **trigger) -> StreamingQuery:
    """Start a query that appends stream to table; a batch that is run again after a failure is not stored twice."""
    key = f"stream:{name}"

    def store(batch: DataFrame, number: int) -> None:
        m = table.log.load()
        if m.options.get(key, -1) >= number:
            return
        new = table._write(table._conformed(batch, m.schema), m, m.options["codec"], m.options["rows_per_stripe"])

        def change(last: Manifest) -> Manifest:
            if last.options.get(key, -1) >= number:
                return last
            added = table.log.added(last, new)
            return replace(added, options=added.options | {key: number})

        table._commit(change, new)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
