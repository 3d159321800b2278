"""Structured Streaming twins: session state, windowed counts with late data, and incremental refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jangbu.sources.sinks import refresh_buckets

SESSION = "session_id string, turn long, document_id string, active_document string"


def active_documents(turns: DataFrame, expire: bool = True) -> DataFrame:
    """``SESSION`` rows: the last document a session confirmed before a turn, overridden by the turn's own.

    ``turns`` streams ``session_id string, turn long, document_id string``; the state
    is one id per session and is dropped an hour after the session's last turn,
    unless it is not to ``expire``, as in a run that ends by itself.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, doc in zip(rows["turn"], rows["document_id"], strict=True):
            doc = None if pd.isna(doc) else doc
            now = doc or now
            out.append((key[0], turn, doc, now))
        state.update((now,))
        if expire:
            state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(out, columns=["session_id", "turn", "document_id", "active_document"])

    return turns.groupBy("session_id").applyInPandasWithState(step, SESSION, "active_document string", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value per window and type; what is later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def merge_into(path: str, key: str = "document_id") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: the newest delivery of each key replaces its partition, so that a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)

    return write


def merge_buckets(path: str, key: str = "document_id", newest: str | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body over a table of hash buckets, for any number of keys; see ``sinks.refresh_buckets``."""

    def write(batch: DataFrame, _: int) -> None:
        refresh_buckets(batch, path, key, newest, buckets)

    return write


USAGE = "item string, step long, tokens long, used long"


def usages(calls: DataFrame, expire: bool = True) -> DataFrame:
    """``USAGE`` rows: tokens used so far by an item, from 0 again for every item; ``calls`` streams ``item string, step long, tokens long``.

    A call without tokens counts 0.  The state is one number per item, dropped an
    hour after its last call unless it is not to ``expire``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        so_far = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("step")
        used = so_far + rows["tokens"].fillna(0).astype("int64").cumsum()
        state.update((int(used.iloc[-1]),))
        if expire:
            state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"item": key[0], "step": rows["step"], "tokens": rows["tokens"].astype("Int64"), "used": used})

    return calls.groupBy("item").applyInPandasWithState(step, USAGE, "used long", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def finished(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream to the end of what is there, into files, and read them: nothing of the result passes the driver."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
