"""Retraction with chain repair, pruning, redaction: plans as tables; applying one is a rewrite without the rows."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import make_key, pointer_session, pointer_turn

INVISIBLE = "[­​-‏⁠﻿]*"


def cited(beliefs: DataFrame) -> DataFrame:
    """Beliefs with the session and turn that their source points at, null where it is free text."""
    return beliefs.withColumns({"cited_session": pointer_session("source"), "cited_turn": pointer_turn("source")})


def orphaned(beliefs: DataFrame, turns: DataFrame) -> DataFrame:
    """Committed beliefs that cite a session no turn is left of."""
    own = cited(beliefs).where("status = 'committed' AND cited_session IS NOT NULL")
    return own.join(turns.select(F.col("session").alias("cited_session")).distinct(), "cited_session", "left_anti").select("id", "key", "cited_session")


def stale_citations(beliefs: DataFrame, turns: DataFrame) -> DataFrame:
    """Beliefs whose cited session is there but whose cited turn is not."""
    own = cited(beliefs).where("cited_session IS NOT NULL")
    there = own.join(turns.select(F.col("session").alias("cited_session")).distinct(), "cited_session", "left_semi")
    return there.join(turns.select(F.col("session").alias("cited_session"), F.col("id").alias("cited_turn")), ["cited_session", "cited_turn"], "left_anti").select("id", "cited_session", "cited_turn")


def repairs(beliefs: DataFrame, gone: DataFrame) -> DataFrame:
    """(action, id, valid_to, superseded_by): what retracting ``gone`` (id) does to the rows before them.

    A committed row ended by a retracted one is relinked to the next row of its key that survives, or reopened if
    there is none. Within a key the chain is the order of time, so the next survivor is a window, not a walk.
    """
    from pyspark.sql import Window

    marked = beliefs.join(gone.select("id").distinct().withColumn("out", F.lit(True)), "id", "left").withColumn("out", F.coalesce("out", F.lit(False)))
    order = Window.partitionBy("key").orderBy("valid_from", "id")
    alive = F.when(~F.col("out") & (F.col("status") == "committed"), F.struct("id", "valid_from"))
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    marked = marked.withColumns({"next_out": F.lead("out").over(order), "survivor": F.first(alive, ignorenulls=True).over(ahead)})
    retract = marked.where("out").select(F.lit("retract").alias("action"), "id", F.col("valid_from").alias("valid_to"), F.col("superseded_by"))
    repair = marked.where("NOT out AND next_out AND status = 'committed'")
    repair = repair.select(F.when(F.col("survivor").isNull(), "reopen").otherwise("relink").alias("action"), "id", F.col("survivor.valid_from").alias("valid_to"), F.col("survivor.id").alias("superseded_by"))
    return retract.unionByName(repair)


def retraction_plan(beliefs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(action, id, valid_to, superseded_by): what follows from the sessions that turns lose between ``before`` and ``after``.
    Committed beliefs that cite one are retracted and their chains repaired; those whose free-text source, a person's words,
    names one are kept, and say so."""
    from .upkeep import mentions

    gone = before.select("session").distinct().join(after.select("session").distinct(), "session", "left_anti")
    own = cited(beliefs)
    citing = own.where("status = 'committed'").join(gone.withColumnRenamed("session", "cited_session"), "cited_session", "left_semi").select("id")
    said = mentions(own.where("cited_session IS NULL AND source IS NOT NULL").select("id", "source"), gone).select("id").distinct()
    none = F.lit(None)
    kept = beliefs.join(said, "id", "left_semi").select(F.lit("keep").alias("action"), "id", none.cast("timestamp_ntz").alias("valid_to"), none.cast("long").alias("superseded_by"))
    return repairs(beliefs, citing).unionByName(kept)


def turn_matches(turns: DataFrame, needle: str) -> DataFrame:
    """One row: turns that start with, contain, and contain in any ASCII case a text."""
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return turns.agg(
        F.count_if(F.col("text").startswith(needle)).alias("starts"),
        F.count_if(F.col("text").contains(needle)).alias("contains"),
        F.count_if(folded.contains(needle.lower())).alias("any_case"),
    )


def prune_plan(turns: DataFrame, doomed: F.Column) -> DataFrame:
    """(session, doomed, turns, emptied): what a removal takes from each session it touches."""
    own = turns.groupBy("session").agg(F.count_if(doomed).alias("doomed"), F.count(F.lit(1)).alias("turns"))
    return own.where("doomed > 0").withColumn("emptied", F.col("doomed") == F.col("turns"))


def secret_pattern(secret: str) -> str:
    """A regular expression for a literal in its character forms (composed, decomposed, full width, percent-encoded)
    with invisible characters anywhere between."""
    parts = []
    for c in secret:
        forms = {c, unicodedata.normalize("NFC", c), unicodedata.normalize("NFD", c)}
        if "!" <= c <= "~":
            forms.add(chr(ord(c) + 0xFEE0))
        own = [re.escape(f) for f in sorted(forms)]
        own.append("".join(f"%(?i:{b:02x})" for b in c.encode()))
        parts.append("(?:" + "|".join(own) + ")")
    return INVISIBLE.join(parts)


def redact_plan(beliefs: DataFrame, secret: str, mark: str = "[redacted]", least_chars: int = 6, most_rows: int = 20) -> DataFrame:
    """(id, subject, relation, value, key, status): rows that hold a secret, rewritten; committed ones retract.

    Refused for a secret of under 6 visible characters, and when over 20 rows hold it."""
    if len("".join(secret.split())) < least_chars:
        raise ValueError(f"too short to redact: under {least_chars} visible characters")
    pattern = secret_pattern(secret)
    fields = ("subject", "relation", "value")
    held = beliefs.where(F.concat_ws("\u0001", *fields).rlike(pattern))
    if held.select("id").limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"over {most_rows} rows hold it: too common to redact")
    new = held.select("id", "status", *[F.regexp_replace(f, pattern, mark).alias(f) for f in fields])
    status = F.when(F.col("status") == "committed", "retracted").otherwise(F.col("status"))
    return new.select("id", *fields, make_key("subject", "relation").alias("key"), status.alias("status"))
