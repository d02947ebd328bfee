"""Queries as a stream against a static reference.

Every step up to alignments is per query, so no state is kept: each micro-batch is matched like a
table and appended under its own number, which makes a repeated batch change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from helixframe.operators.matches import maximal_matches


def matched_stream(queries: DataFrame, refs: DataFrame, out: str, checkpoint: str, length: int = 20, strand: str = "forward", then: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Match the streaming ``queries`` (``seq_id, seq, len``) with ``refs``; results go to ``out/batch=N``."""

    def batch(rows: DataFrame, number: int) -> None:
        found = maximal_matches(refs, rows, length, strand)
        (then(found) if then else found).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
