"""Incremental forms: tailing transcripts exactly once, and folding late evidence into each key's timeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import keyed
from ..sources.model import as_turns

MESSAGE = "session string, seq long, ts timestamp, role string, text string, source string"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None before anything was written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of turns from message files that appear in a folder; the checkpoint is the cursor."""
    raw = spark.readStream.schema(MESSAGE).json(folder)
    return as_turns(raw)


def sync(spark: SparkSession, folder: str, table: str, checkpoint: str) -> int:
    """Append what is new to a Parquet table and stop; replays add nothing, as (source, seq) is joined out first.

    Returns the number of turns in the table.
    """

    def append(batch: DataFrame, _: int) -> None:
        own = batch.dropDuplicates(["source", "seq"])
        known = _stored(spark, table)
        if known is not None:
            own = own.join(known.select("source", "seq"), ["source", "seq"], "left_anti")
        own.write.mode("append").parquet(table)

    query = tail(spark, folder).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(table).count()


STATE = "at array<long>, seq array<long>, norm array<string>"
OUT = "key string, norm string, valid_from long, valid_to long"


def late_timeline(assertions: DataFrame) -> DataFrame:
    """A stream of assertions to a stream of timelines, updated for every key that got evidence, however late.

    Each key's state is its evidence in order of time, then seq, of repeats of a seq the first; no watermark drops any.
    Runs of equal values fold to one row. What a key has seen is its state, so a batch costs what its keys hold.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = dict(zip(state.get[1], zip(state.get[0], state.get[2]))) if state.exists else {}
        for batch in batches:
            for seq, at, norm in zip(batch["seq"].tolist(), batch["at"].tolist(), batch["norm"].tolist()):
                rows.setdefault(seq, (at, norm))
        held = sorted((at, seq, norm) for seq, (at, norm) in rows.items())
        state.update(([x[0] for x in held], [x[1] for x in held], [x[2] for x in held]))
        runs = [r for i, r in enumerate(held) if i == 0 or held[i - 1][2] != r[2]]
        ends = [r[0] for r in runs[1:]] + [None]
        yield pd.DataFrame({"key": key[0], "norm": [r[2] for r in runs], "valid_from": [r[0] for r in runs], "valid_to": pd.array(ends, "Int64")})

    rows = keyed(assertions).select("key", "norm", "seq", F.unix_micros(F.col("valid_from").cast("timestamp")).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def derive_new(spark: SparkSession, turns: DataFrame, control: str, facts: str, derive: Callable[[DataFrame], DataFrame], ran_at: F.Column, stale_after: float | None = None) -> int:
    """Derive from the turns past the stored watermark, append what comes of it to ``facts``, then the new watermark to
    ``control`` (watermark, ran_at): facts go first, so a run that dies between the two is made again and its readers
    drop repeats. With ``stale_after`` (hours) nothing is done if the last run is younger. Returns the watermark.

    One run at a time is the scheduler's part (a trigger of available data); two at once would only repeat facts.
    """
    known = _stored(spark, control)
    mark, young = 0, False
    if known is not None:
        age = (F.unix_micros(ran_at.cast("timestamp")) - F.unix_micros(F.max(F.col("ran_at").cast("timestamp")))) / 3_600_000_000
        row = known.agg(F.max("watermark").alias("mark"), age.alias("age")).first()
        mark, young = row["mark"] or 0, stale_after is not None and row["age"] is not None and row["age"] < stale_after
    new = turns.where(F.col("id") > mark)
    last = None if young else new.agg(F.max("id")).first()[0]
    if last is None:
        return mark
    derive(new).write.mode("append").parquet(facts)
    spark.range(1).select(F.lit(last).cast("long").alias("watermark"), ran_at.alias("ran_at")).write.mode("append").parquet(control)
    return last


def restart_shrunk(stored: DataFrame, incoming: DataFrame, shrunk: DataFrame) -> DataFrame:
    """The store after a sync: sources whose file has shrunk start anew, of the others only new (source, seq) are added."""
    kept = stored.join(shrunk.select("source"), "source", "left_anti")
    return kept.unionByName(incoming.join(kept.select("source", "seq"), ["source", "seq"], "left_anti").select(*stored.columns))
