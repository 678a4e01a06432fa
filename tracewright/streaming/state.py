"""Stateful streams: throttling of failures.

A key's events are folded in order into a small state. Rows are dealt and sorted by key and folded a row at a time, so
that a hot key's events stream through its task without being held. The stream form folds each micro-batch together with
the states that the batch before it wrote; results and states are tables by batch number, so a batch that is run again
writes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Failures that lock a key, and seconds of the window and of the lock.
MOST_FAILURES, WINDOW = 5, 900


def failed(state: tuple[int, float, float] | None, at: float) -> tuple[int, float, float]:
    """(failures, first failure, locked until) after one more failure. The window starts at the first failure; once it is
    over a new one starts."""
    if state is None or state[1] <= at - WINDOW:
        count, first = 1, at
    else:
        count, first = state[0] + 1, state[1]
    return count, first, at + WINDOW if count >= MOST_FAILURES else 0.0


def _folded(rows: DataFrame, keep_state: bool) -> DataFrame:
    """Rows (event_id, k, kind, at, failures, first) by key and time: failures numbered, and the last states if asked for.
    A row of kind 'state' sets its key's state and comes first."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, last = None, None, 0.0
        columns = ["event_id", "k", "failures", "locked", "first", "at"]

        def end() -> list[tuple]:
            return [(None, held, state[0], None, state[1], last)] if keep_state and state is not None else []

        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                if row.k != held:
                    out += end()
                    held, state = row.k, None
                last = row.at
                if row.kind == "state":
                    state, last = (int(row.failures), row.first, 0.0), row.first
                elif row.kind == "success":
                    state = None
                else:
                    state = failed(state, row.at)
                    out.append((row.event_id, row.k, state[0], state[2] > 0, state[1], row.at))
            yield pd.DataFrame(out, columns=columns).astype({"event_id": "Int64", "locked": "boolean"})
        yield pd.DataFrame(end(), columns=columns).astype({"event_id": "Int64", "k": "Int64", "failures": "Int64", "locked": "boolean", "first": float, "at": float})

    dealt = rows.repartition("k").sortWithinPartitions("k", F.col("kind") != "state", "at", "event_id")
    return dealt.mapInPandas(fold, "event_id long, k long, failures long, locked boolean, first double, at double")


def _attempts(events: DataFrame, key: str, failure: str, success: str) -> DataFrame:
    kind = F.when(F.col("event_type") == failure, "failure").otherwise("success")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.filter(F.col("event_type").isin(failure, success)).select("event_id", F.col(key).alias("k"), kind.alias("kind"), at.alias("at"), F.lit(None).cast("long").alias("failures"), F.lit(None).cast("double").alias("first"))


def throttled(events: DataFrame, key: str = "user_id", failure: str = "error", success: str = "purchase") -> DataFrame:
    """Of each failure: its number in its window and whether it locks the key. A success clears the key's state."""
    return _folded(_attempts(events, key, failure, success), False).select("event_id", F.col("k").alias(key), "failures", "locked")


def throttle_stream(events: DataFrame, folder: str, key: str = "user_id", failure: str = "error", success: str = "purchase"):
    """A writer of the same over a stream: results under folder/out, states under folder/state, by batch number."""

    def batch(frame: DataFrame, number: int) -> None:
        rows = _attempts(frame, key, failure, success)
        if number:
            states = frame.sparkSession.read.schema("k long, failures long, first double").parquet(f"{folder}/state/batch={number - 1}")
            rows = rows.unionByName(states.select(F.lit(None).cast("long").alias("event_id"), "k", F.lit("state").alias("kind"), F.col("first").alias("at"), "failures", "first"))
        folded = f"{folder}/folded/batch={number}"
        _folded(rows, True).write.mode("overwrite").parquet(folded)
        found = frame.sparkSession.read.parquet(folded)
        found.filter("event_id is not null").select("event_id", F.col("k").alias(key), "failures", "locked").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        found.filter("event_id is null").select("k", "failures", "first").write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
