"""The bi-temporal ledger as folds over assertions ordered by (valid_from, seq) within a key."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import make_key, normalize


def keyed(assertions: DataFrame) -> DataFrame:
    return assertions.withColumn("key", make_key("subject", "relation")).withColumn("norm", normalize("value"))


def timeline(assertions: DataFrame) -> DataFrame:
    """The beliefs of an automatic ledger, one for each run of equal values: (id, key, subject, relation, value,
    valid_from, valid_to, superseded_by, reliability, use_count, source, status, recorded_at)."""
    order = Window.partitionBy("key").orderBy("valid_from", "seq")
    rows = keyed(assertions).withColumn("new", (F.coalesce(F.lag("norm").over(order) != F.col("norm"), F.lit(True))).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("valid_from", "seq", "subject", "relation", "value", "source"))
    runs = rows.groupBy("key", "island").agg(first.alias("f"), F.max("reliability").alias("reliability"), (F.count(F.lit(1)) - 1).alias("use_count"))
    runs = runs.select("key", "island", F.col("f.seq").alias("id"), "f.subject", "f.relation", "f.value", "f.valid_from", "f.source", "reliability", "use_count")
    later = Window.partitionBy("key").orderBy("island")
    return runs.withColumns(
        {"valid_to": F.lead("valid_from").over(later), "superseded_by": F.lead("id").over(later), "status": F.lit("committed"), "recorded_at": F.col("valid_from")}
    ).drop("island")


def auto_outcomes(assertions: DataFrame) -> DataFrame:
    """(seq, outcome): created, reinforced or superseded."""
    order = Window.partitionBy("key").orderBy("valid_from", "seq")
    before = F.lag("norm").over(order)
    outcome = F.when(before.isNull(), "created").when(before == F.col("norm"), "reinforced").otherwise("superseded")
    return keyed(assertions).select("seq", outcome.alias("outcome"))


def gated_outcomes(assertions: DataFrame) -> DataFrame:
    """(seq, outcome, incumbent): a weaker differing value waits for review and leaves the incumbent as it is.

    The incumbent's reliability is always the greatest so far, since whatever reaches it takes over or agrees. So a row
    that reaches the greatest before it holds the place, the incumbent value is that of the last holder, and its id the
    first of the holders that agree in a row: windows over one order, no fold.
    """
    order = Window.partitionBy("key").orderBy("valid_from", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed(assertions).select("key", "seq", "valid_from", "norm", "reliability", F.max("reliability").over(before).alias("most"))
    holds = F.col("most").isNull() | (F.col("reliability") >= F.col("most"))
    rows = rows.withColumn("holds", holds).withColumn("now", F.last(F.when(F.col("holds"), F.col("norm")), ignorenulls=True).over(before))
    takes = F.col("holds") & (F.col("now").isNull() | (F.col("now") != F.col("norm")))
    rows = rows.withColumn("incumbent", F.last(F.when(takes, F.col("seq")), ignorenulls=True).over(before))
    outcome = F.when(F.col("now").isNull(), "created").when(F.col("now") == F.col("norm"), "reinforced").when(~F.col("holds"), "pending_review").otherwise("superseded")
    return rows.select("seq", outcome.alias("outcome"), "incumbent")


def awaited_outcomes(assertions: DataFrame) -> DataFrame:
    """(seq, outcome, incumbent): the first value stands until someone approves another."""
    order = Window.partitionBy("key").orderBy("valid_from", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = keyed(assertions).withColumns({"v0": F.first("norm").over(order), "id0": F.first("seq").over(order)})
    outcome = F.when(F.col("seq") == F.col("id0"), "created").when(F.col("norm") == F.col("v0"), "reinforced").otherwise("pending_review")
    return rows.select("seq", outcome.alias("outcome"), F.when(F.col("seq") != F.col("id0"), F.col("id0")).alias("incumbent"))


class Arrivals:
    """One key's ledger as rows arrive: times and values of what is held, in order of time but where a repeated value moved
    the last one back."""

    def __init__(self) -> None:
        self.times, self.norms, self.ordered = [], [], True

    def take(self, at: float, norm: str | None) -> str:
        """The outcome of a row; what is older is found by bisection while the times are in order, else from the end."""
        times, norms = self.times, self.norms
        if times and norm == norms[-1]:
            times[-1] = min(times[-1], at)
            self.ordered = self.ordered and (len(times) < 2 or times[-2] <= times[-1])
            return "reinforced"
        if not times or not at < times[-1]:
            self.ordered = self.ordered and at == at and (not times or times[-1] <= at)
            times.append(at)
            norms.append(norm)
            return "superseded" if len(times) > 1 else "created"
        place = bisect.bisect_right(times, at) if self.ordered else next((i for i in range(len(times), 0, -1) if times[i - 1] <= at), 0)
        if place and norms[place - 1] == norm:
            return "reinforced"
        if self.ordered:
            times.insert(place, at)
            norms.insert(place, norm)
        else:
            held = sorted(zip([*times, at], [*norms, norm]), key=lambda h: h[0])
            self.times, self.norms = [t for t, _ in held], [n for _, n in held]
            self.ordered = all(a <= b for a, b in zip(self.times, self.times[1:]))
        return "historical"


def arrival_outcomes(assertions: DataFrame) -> DataFrame:
    """(key, seq, outcome) when rows are taken in order of seq, as they came in, automatic policy.

    An older row files into history; a repeated value only reinforces. Sequential by nature within a key: a partition's
    keys pass one after the other, each row once, and only what the present key holds is kept."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = object(), Arrivals()
        for batch in batches:
            keys, seqs, norms, times = (batch.column(c) for c in ("key", "seq", "norm", "valid_from"))
            outcomes = []
            for key, norm, at in zip(keys.to_pylist(), norms.to_pylist(), times.to_pylist()):
                if key != known:
                    known, held = key, Arrivals()
                outcomes.append(held.take(math.nan if at is None else at, norm))
            yield pa.RecordBatch.from_arrays([keys, seqs, pa.array(outcomes, pa.string())], ["key", "seq", "outcome"])

    rows = keyed(assertions).select("key", F.col("seq").cast("long").alias("seq"), "norm", F.unix_micros(F.col("valid_from").cast("timestamp")).alias("valid_from"))
    return rows.repartition("key").sortWithinPartitions("key", F.col("seq").asc_nulls_last()).mapInArrow(fold, "key string, seq long, outcome string")


def reviews(assertions: DataFrame) -> DataFrame:
    """(review_id, key, candidate, incumbent): the open reviews of a gated ledger."""
    pending = gated_outcomes(assertions).where("outcome = 'pending_review'")
    keys = keyed(assertions).select("seq", "key")
    return pending.join(keys, "seq").select(F.col("seq").alias("review_id"), "key", F.col("seq").alias("candidate"), "incumbent")


def decide(open_reviews: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(candidate, status, valid_to, incumbent, incumbent_valid_to) after decisions (review_id, decision): an approval
    commits the candidate and ends the incumbent where it begins; a rejection ends the candidate at once. Of several
    approvals against one incumbent the earliest candidate ends it."""
    rows = open_reviews.join(decisions, "review_id").join(candidates.select(F.col("seq").alias("candidate"), "valid_from"), "candidate")
    approved = F.col("decision") == "approve"
    ends = Window.partitionBy("incumbent")
    return rows.select(
        "candidate",
        F.when(approved, "committed").otherwise("rejected").alias("status"),
        F.when(~approved, F.col("valid_from")).alias("valid_to"),
        "incumbent",
        F.min(F.when(approved, F.col("valid_from"))).over(ends).alias("incumbent_valid_to"),
    )


def current(beliefs: DataFrame) -> DataFrame:
    return beliefs.where("valid_to IS NULL AND status = 'committed'")


def as_of(beliefs: DataFrame, at: F.Column) -> DataFrame:
    """What was believed at a time: open at or before it, not yet ended."""
    return beliefs.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def neighbours(beliefs: DataFrame, late: DataFrame) -> DataFrame:
    """(probe, before_id, after_id): for late evidence (probe, key, at) the latest belief of the key that begins at or
    before it and the earliest that begins after it. One ordered pass over both, no range join."""
    marks = beliefs.select("key", F.col("valid_from").alias("at"), F.lit(0).alias("side"), "id", F.lit(None).cast("long").alias("probe"))
    probes = late.select("key", "at", F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), "probe")
    order = Window.partitionBy("key").orderBy("at", "side", "id", "probe")
    back = F.last("id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first("id", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = marks.unionByName(probes).select("probe", "side", back.alias("before_id"), ahead.alias("after_id"))
    return rows.where("side = 1").select("probe", "before_id", "after_id")


def with_confirmations(beliefs: DataFrame, confirmations: DataFrame) -> DataFrame:
    """beliefs with confirmed: whether a person confirmed them (belief_id)."""
    ids = confirmations.select(F.col("belief_id").alias("id"), F.lit(True).alias("confirmed")).distinct()
    return beliefs.join(ids, "id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def history(beliefs: DataFrame, retractions: DataFrame) -> DataFrame:
    """Every belief but rejected candidates, with retracted_at and retracted_reason where it was retracted
    (belief_id, retracted_at, reason); by key, the oldest first."""
    gone = retractions.select(F.col("belief_id").alias("id"), "retracted_at", F.col("reason").alias("retracted_reason"))
    return beliefs.where("status <> 'rejected'").join(gone, "id", "left")


def belief_retraction(beliefs: DataFrame, reasons: DataFrame) -> DataFrame:
    """(id, valid_to, status, reason): the plan of retracting beliefs named by id (id, reason). Only current committed
    ones; nothing is reopened or relinked."""
    named = reasons.groupBy("id").agg(F.min("reason").alias("reason"))
    return current(beliefs).join(named, "id").select("id", F.col("valid_from").alias("valid_to"), F.lit("retracted").alias("status"), "reason")


def review_items(open_reviews: DataFrame, assertions: DataFrame) -> DataFrame:
    """Open reviews with what they weigh: the candidate's and, where there is one, the incumbent's subject, relation,
    value, reliability and source."""
    fields = ("subject", "relation", "value", "reliability", "source")
    side = lambda name: assertions.select(F.col("seq").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in fields])
    return open_reviews.join(side("candidate"), "candidate").join(side("incumbent"), "incumbent", "left")


def close_reviews(open_reviews: DataFrame, retracted: DataFrame) -> DataFrame:
    """(review_id, decision): reviews that end because their candidate or incumbent (id) was retracted or redacted."""
    ids = retracted.select("id").distinct()
    a = open_reviews.join(ids.withColumnRenamed("id", "candidate"), "candidate", "left_semi").select("review_id")
    b = open_reviews.join(ids.withColumnRenamed("id", "incumbent"), "incumbent", "left_semi").select("review_id")
    return a.union(b).distinct().withColumn("decision", F.lit("withdrawn"))
