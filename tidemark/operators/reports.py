"""Reports over a store: counts, provenance, utilization, what is left out of prompts, digest, retention, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durability import verdict
from ..functions.text import belief_line, project_dir
from .ledger import current

REASONS = ("measurement", "moving_version", "status", "instruction")


def store_stats(turns: DataFrame, passages: DataFrame, beliefs: DataFrame, open_reviews: DataFrame | None = None) -> DataFrame:
    """One row of totals; each table is read once."""
    t = turns.agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("session").alias("sessions"))
    p = passages.agg(F.count(F.lit(1)).alias("passages"))
    b = beliefs.agg(F.count(F.lit(1)).alias("beliefs"), F.count_if(F.expr("valid_to IS NULL AND status = 'committed'")).alias("current_beliefs"))
    rows = t.join(F.broadcast(p)).join(F.broadcast(b))  # one row each
    if open_reviews is None:
        return rows
    return rows.join(F.broadcast(open_reviews.agg(F.count(F.lit(1)).alias("reviews_open"))))


def provenance(turns: DataFrame, cited: DataFrame) -> DataFrame:
    """(entrypoint, sessions, turns, beliefs): a session with turns of two entrypoints counts under each."""
    own = turns.groupBy("entrypoint").agg(F.countDistinct("session").alias("sessions"), F.count(F.lit(1)).alias("turns"))
    at = cited.join(turns.select(F.col("session").alias("cited_session"), F.col("id").alias("cited_turn"), "entrypoint"), ["cited_session", "cited_turn"])
    beliefs = at.groupBy("entrypoint").agg(F.count(F.lit(1)).alias("beliefs"))
    joined = own.join(beliefs, own["entrypoint"].eqNullSafe(beliefs["entrypoint"]), "left").select(own["entrypoint"], "sessions", "turns", F.coalesce("beliefs", F.lit(0)).alias("beliefs"))
    return joined.orderBy(F.desc("sessions"), F.desc("turns"), F.col("entrypoint").asc_nulls_last())


def top_projects(turns: DataFrame, n: int = 5) -> DataFrame:
    """(dir, sessions, share): folders by their sessions, with the share of all sessions."""
    own = turns.groupBy(project_dir("source").alias("dir")).agg(F.countDistinct("session").alias("sessions"))
    total = turns.agg(F.countDistinct("session").alias("total"))
    return own.join(F.broadcast(total)).select("dir", "sessions", F.round(F.col("sessions") / F.col("total"), 4).alias("share")).orderBy(F.desc("sessions"), "dir").limit(n)


def utilization(uses: DataFrame, now: F.Column) -> DataFrame:
    """One row from (id, uses, last_used): used in the last 7 and 30 days, last use, share ever used."""
    since = lambda days: F.count_if(F.col("last_used") >= now - F.make_dt_interval(F.lit(days)))
    return uses.agg(since(7).alias("used_7d"), since(30).alias("used_30d"), F.max("last_used").alias("last_used"), F.round(F.avg((F.col("uses") > 0).cast("double")), 4).alias("ever_used"))


def utilization_both(beliefs: DataFrame, turns: DataFrame, now: F.Column) -> DataFrame:
    """One row from both tables' (id, last_used): recalled in 7 and 30 days, the share of turns ever recalled, the last use."""
    since = lambda days: F.count_if(F.col("last_used") >= now - F.make_dt_interval(F.lit(days)))
    b = beliefs.agg(since(7).alias("beliefs_7d"), since(30).alias("beliefs_30d"), F.max("last_used").alias("b"))
    t = turns.agg(since(7).alias("turns_7d"), since(30).alias("turns_30d"), F.round(F.avg(F.col("last_used").isNotNull().cast("double")), 4).alias("turns_share"), F.max("last_used").alias("t"))
    return t.join(F.broadcast(b)).withColumn("last_used", F.greatest("b", "t")).drop("b", "t")  # one row each


def derive_status(turns: DataFrame, runs: DataFrame, open_reviews: DataFrame) -> DataFrame:
    """One row: turns, those past the last run's watermark (runs: watermark, ran_at), how often and when it ran, open reviews."""
    done = runs.agg(F.coalesce(F.max("watermark"), F.lit(0)).alias("watermark"), F.count(F.lit(1)).alias("runs"), F.max("ran_at").alias("last_run"))
    marked = turns.select("id").join(F.broadcast(done.select("watermark")))
    sums = marked.agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("id") > F.col("watermark")).alias("turns_pending"), F.max("id").alias("max_turn_id"))
    return sums.join(F.broadcast(done)).join(F.broadcast(open_reviews.agg(F.count(F.lit(1)).alias("reviews_open"))))


def capture_status(sources: DataFrame, globs: list[str], home: str = "") -> DataFrame:
    """One row: sources, how many the globs exclude, and a warning where that is half of them or more."""
    from ..functions.text import glob_pattern
    from .upkeep import hiding_verdict

    hit = F.lit(False)
    for g in globs:
        hit = hit | F.col("source").rlike(glob_pattern(g, home))
    sums = sources.agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("excluded"))
    return sums.withColumn("warning", hiding_verdict(F.col("total"), F.col("excluded")))


def left_out(beliefs: DataFrame, now: F.Column) -> DataFrame:
    """(reason, beliefs): current beliefs that no prompt gets, by reason; a reason without any counts 0."""
    spark = beliefs.sparkSession
    reasons = spark.createDataFrame([(r,) for r in REASONS], "reason string")
    why = current(beliefs).select(F.split(verdict(now), ":")[0].alias("reason")).where("reason IS NOT NULL")
    found = why.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return reasons.join(found, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("beliefs"))


def sessions_with_news(turns: DataFrame, after_id: int, limit: int = 60) -> DataFrame:
    """(session, first_new): sessions with turns past the watermark, the earliest first."""
    new = turns.where(F.col("id") > after_id).groupBy("session").agg(F.min("id").alias("first_new"))
    return new.orderBy("first_new").limit(limit)


def pending(turns: DataFrame, after_id: int) -> DataFrame:
    return turns.agg(F.count_if(F.col("id") > after_id).alias("pending"), F.max("id").alias("last_id"))


def missing_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming (source, seq) that the store lacks: the append of an incremental sync."""
    return incoming.join(stored.select("source", "seq"), ["source", "seq"], "left_anti")


def session_activity(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session").agg(F.max("ts").alias("last_ts")).orderBy(F.col("last_ts").desc_nulls_last(), "session")


def digest_sessions(turns: DataFrame, folder: str, n: int = 10) -> DataFrame:
    """(session, last_ts, first_id): the latest sessions of a folder with their first prompt."""
    own = turns.where(F.col("source").startswith(folder + "/"))
    order = Window.partitionBy("session").orderBy(F.col("role") != "user", F.col("ts").asc_nulls_last(), "id")
    first = own.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("session", F.col("id").alias("first_id"))
    return session_activity(own).join(first, "session").orderBy(F.col("last_ts").desc_nulls_last(), "session").limit(n)


def budgeted(rows: DataFrame, by: str, line: str, order: list, budget: int) -> DataFrame:
    """Lines of each group while their running length, a line end each, stays within the budget; the first that
    overflows ends the list."""
    running = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length(line) + 1).over(running)).where(F.col("used") <= budget)


def context(beliefs: DataFrame, hits: DataFrame, now: F.Column, k: int = 6) -> DataFrame:
    """(qid, rank, line): of ranked hits (qid, rank, id) the first k that the gate lets in, as lines of a prompt."""
    own = beliefs.join(hits.select("id").distinct(), "id", "left_semi").withColumn("why", verdict(now)).where("why IS NULL")  # the gate costs more than the join
    kept = hits.join(own, "id")
    order = Window.partitionBy("qid").orderBy("rank")
    kept = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return kept.select("qid", F.col("place").alias("rank"), belief_line("subject", "relation", "value", "recorded_at").alias("line"))


def first_lines(hits: DataFrame, beliefs: DataFrame, k: int) -> DataFrame:
    """(qid, rank, line): of ranked hits (qid, rank, id) the first ``k`` that are among beliefs, as lines of a prompt."""
    order = Window.partitionBy("qid").orderBy("rank")
    kept = hits.select("qid", "rank", "id").join(beliefs, "id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return kept.select("qid", F.col("place").alias("rank"), belief_line("subject", "relation", "value", "recorded_at").alias("line"))


def retention(snapshots: DataFrame, now: F.Column, bands: tuple[int, ...] = (1, 3, 7, 14)) -> DataFrame:
    """(name, keep): of snapshots (name, taken) the newest of all and the oldest of each age band stay."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("taken").cast("timestamp"))) / 86_400_000_000
    band = F.lit(None).cast("int")
    for i, days in reversed(list(enumerate(bands))):
        band = F.when(age <= days, i).otherwise(band)
    rows = snapshots.withColumn("band", band)
    first = rows.where("band IS NOT NULL").groupBy("band").agg(F.min(F.struct("taken", "name"))["name"].alias("name"))
    last = rows.agg(F.min_by("name", F.struct(-F.unix_micros(F.col("taken").cast("timestamp")), "name")).alias("name"))
    stays = first.select("name").union(last).distinct().withColumn("keep", F.lit(True))  # six at most
    return rows.join(F.broadcast(stays), "name", "left").select("name", F.coalesce("keep", F.lit(False)).alias("keep"))


def snapshot_times(names: DataFrame) -> DataFrame:
    stamp = F.regexp_extract("name", r"-(\d{8}-\d{6})\.[a-z]+$", 1)
    return names.select("name", F.try_to_timestamp(stamp, F.lit("yyyyMMdd-HHmmss")).cast("timestamp_ntz").alias("taken")).where("taken IS NOT NULL")


def trim_log(log: DataFrame, now: F.Column, text_days: int, days: int) -> DataFrame:
    """A relevance log after its trim: rows older than ``days`` or of unknown time go, texts older than ``text_days`` are
    blanked."""
    fresh = log.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))
    keep_text = F.col("ts") >= now - F.make_dt_interval(F.lit(text_days))
    return fresh.withColumn("prompt", F.when(keep_text, F.col("prompt")))


def trim_counts(log: DataFrame, now: F.Column, text_days: int, days: int) -> DataFrame:
    """One row (scrubbed, dropped): what a trim of the log blanks and removes."""
    age = lambda n: F.coalesce(F.col("ts") >= now - F.make_dt_interval(F.lit(n)), F.lit(False))
    return log.agg(F.count_if(age(days) & ~age(text_days) & F.col("prompt").isNotNull()).alias("scrubbed"), F.count_if(~age(days)).alias("dropped"))


def exclude_preview(sources: DataFrame, globs: list[str]) -> DataFrame:
    """(pattern, sources): how many sources each glob hides, and all together (pattern null), each source once."""
    from ..functions.text import glob_pattern

    hits = [F.col("source").rlike(glob_pattern(g)) for g in globs]
    both = hits[0]
    for h in hits[1:]:
        both = both | h
    counts = sources.agg(*[F.count_if(h).alias(f"n{i}") for i, h in enumerate(hits)], F.count_if(both).alias("all"))
    pairs = [F.struct(F.lit(g).alias("pattern"), F.col(f"n{i}").alias("sources")) for i, g in enumerate(globs)]
    pairs.append(F.struct(F.lit(None).cast("string").alias("pattern"), F.col("all").alias("sources")))
    return counts.select(F.inline(F.array(*pairs)))
