"""Rate limits and resumable work."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def client_key(forwarded: Column, host: Column) -> Column:
    """The first forwarded address, else the host, else the local one."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.coalesce(F.when(first != "", first), host, F.lit("127.0.0.1"))


def trailing_excess(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """(user_id, event_id, over_limit) by a plain count of the requests less than ``seconds`` back."""
    w = Window.partitionBy("user_id").orderBy("__s").rangeBetween(1 - seconds * 1_000_000, 0)
    timed = events.withColumn("__s", F.unix_micros(F.col("ts").cast("timestamp")))
    return timed.select("user_id", "event_id", (F.count("*").over(w) > most).alias("over_limit"))


def admissions(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """(user_id, event_id, admitted), exact: a request is admitted if fewer than ``most`` admitted ones are less than ``seconds`` old.

    Rows are dealt by user and sorted; a pass over them holds one user's admitted times, at most
    ``most``, so a user with very many requests costs time in one task but no memory.
    """
    kind = events.schema["user_id"].dataType.simpleString()
    timed = events.select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user: Any = work
        kept: list[float] = []
        for batch in batches:
            out = []
            for who, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if who != user:
                    user, kept = who, []
                kept = [x for x in kept if x > t - seconds]
                out.append(len(kept) < most)
                if out[-1]:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["user_id", "event_id", "admitted"])

    return timed.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInArrow(work, f"user_id {kind}, event_id long, admitted boolean")


def admissions_stream(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """The same rule over a stream of (user_id, event_id, ts): the admitted times are the state of a user."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        out = []
        for t in rows["t"]:
            kept = [x for x in kept if x > t - seconds]
            out.append(len(kept) < most)
            if out[-1]:
                kept.append(float(t))
        state.update((kept,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "admitted": out})

    timed = events.select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, admitted boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def remaining(rows: DataFrame, done: Sequence[DataFrame], key: str) -> DataFrame:
    """``rows`` whose key is in none of the tables of finished or skipped work."""
    for d in done:
        rows = rows.join(d.select(key), key, "left_anti")
    return rows
