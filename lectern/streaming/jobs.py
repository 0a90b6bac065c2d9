"""Job events as a stream: the latest state of each job, kept in a state store, and documents checked as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.issues import issues_of
from ..operators.jobs import FINAL, STEPS
from ..operators.rules import Options

_OUT = "job_id string, sequence int, status string, progress int, accepted boolean"
_STATE = "sequence int, status string, progress int"
#: Days by which an event may be late, and after which a job without events is forgotten.
LATE_DAYS = 7


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """Each event of a job, accepted where it goes on from the job's state: a later sequence, no step back, no fall, nothing after the end.

    An event that comes late, behind a later one, is told but not accepted. A job whose time has run out is forgotten.
    """
    if state.hasTimedOut:
        state.remove()
        return
    sequence, status, progress = state.get if state.exists else (-1, "", 0)
    rows, latest = [], None
    for frame in batches:
        for e in frame.sort_values("sequence").itertuples():
            back = status in STEPS and e.status in STEPS and STEPS.index(e.status) < STEPS.index(status)
            accepted = not (e.sequence <= sequence or status in FINAL or back or e.progress < progress)
            if accepted:
                sequence, status, progress = int(e.sequence), e.status, int(e.progress)
            rows.append((key[0], int(e.sequence), e.status, int(e.progress), accepted))
            latest = e.received_at if latest is None else max(latest, e.received_at)
    state.update((sequence, status, progress))
    if latest is not None:
        ends = int(latest.timestamp() * 1000) + LATE_DAYS * 86_400_000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(rows, columns=["job_id", "sequence", "status", "progress", "accepted"])


def states(events: DataFrame) -> DataFrame:
    """The stream of events with accepted, one state per job, which goes when no event has come for as long as one may be late."""
    return events.groupBy("job_id").applyInPandasWithState(advance, _OUT, _STATE, "append", "EventTimeTimeout")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Job events from parquet files as they appear in a folder, without those delivered twice within LATE_DAYS."""
    schema = "job_id string, sequence int, status string, progress int, message string, created_at timestamp, received_at timestamp"
    return spark.readStream.schema(schema).parquet(folder).withWatermark("received_at", f"{LATE_DAYS} days").dropDuplicatesWithinWatermark(["job_id", "sequence"])


def issue_stream(docs: DataFrame, into: str, checkpoint: str, options: Options = Options()):
    """Checks documents as they arrive and writes their issues; a batch that runs again replaces its own files."""

    def each(batch: DataFrame, number: int) -> None:
        issues_of(batch, options).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{into}/batch={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
