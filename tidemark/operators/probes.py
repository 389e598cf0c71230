"""Isolation probes of an experiment: did a run read what it must not see?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaks(transcripts: DataFrame, forbidden: dict[str, list[str]], required: list[str] = ()) -> DataFrame:
    """(run, probe, hits) of transcripts (run, text): how often each probe's texts occur, and probe missing where a text
    that every run must show does not."""
    counts = []
    for probe, texts in forbidden.items():
        total = F.lit(0)
        for t in texts:
            total = total + F.regexp_count(F.col("text"), F.lit("\\Q" + t + "\\E"))
        counts.append(F.struct(F.lit(probe).alias("probe"), total.cast("long").alias("hits")))
    if required:
        absent = F.lit(0)
        for t in required:
            absent = absent + F.when(F.contains("text", F.lit(t)), 0).otherwise(1)
        counts.append(F.struct(F.lit("missing").alias("probe"), absent.cast("long").alias("hits")))
    each = transcripts.select("run", F.inline(F.array(*counts)))
    return each.groupBy("run", "probe").agg(F.sum("hits").alias("hits")).where("hits > 0")
