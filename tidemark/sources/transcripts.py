"""Transcript, log and batch sources: tolerant JSON lines by harness, source filters, tab-separated assertions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import glob_pattern
from ..functions.words import BOILERPLATE
from .model import MAX_CHARS, MIN_CHARS, as_turns

#: The first bytes of a source in which a marker hides it as a whole.
HEAD_BYTES = 200_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    named = raw.select(F.col("value"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    order = Window.partitionBy("source").orderBy("block", "at")
    stem = F.regexp_extract("source", r"([^/]+)\.jsonl$", 1)
    return named.withColumns({"line": F.row_number().over(order) - 1, "stem": stem, "json": F.try_parse_json("value")}).where("json IS NOT NULL")


def _text(path: str) -> F.Column:
    return F.try_variant_get("json", path, "string")


def read_generic(spark: SparkSession, path: str) -> DataFrame:
    """Message lines {role, content: text or list of {text}, timestamp or ts, session or session_id}: one turn a line,
    the texts of a list joined by a space."""
    parts = F.array_join(F.filter(F.transform(F.try_variant_get("json", "$.content", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), lambda x: x.isNotNull()), " ")
    listed = F.schema_of_variant(F.try_variant_get("json", "$.content", "variant")).startswith("ARRAY")
    rows = _lines(spark, path).select(
        F.coalesce(_text("$.session"), _text("$.session_id"), F.col("stem")).alias("session"),
        F.col("line").alias("seq"),
        F.coalesce(_text("$.timestamp"), _text("$.ts")).alias("ts"),
        _text("$.role").alias("role"),
        F.when(listed, parts).otherwise(_text("$.content")).alias("text"),
        "source",
    )
    return as_turns(rows)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session lines {type: user or assistant, sessionId, timestamp, entrypoint, message: {content: text or blocks}}:
    one turn for each text block; user text that opens as the harness's own does is left out."""
    rows = _lines(spark, path).where(F.coalesce(_text("$.type"), F.lit("")).isin("user", "assistant"))
    blocks = F.try_variant_get("json", "$.message.content", "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.try_variant_get(b, "$.text", "string"))
    listed = F.schema_of_variant(F.try_variant_get("json", "$.message.content", "variant")).startswith("ARRAY")
    each = rows.select(
        F.coalesce(_text("$.sessionId"), F.col("stem")).alias("session"), "line", "source", _text("$.timestamp").alias("ts"), _text("$.type").alias("role"), _text("$.entrypoint").alias("entrypoint"),
        F.posexplode(F.when(listed, texts).otherwise(F.array(_text("$.message.content")))).alias("block", "text"),
    )
    order = Window.partitionBy("source").orderBy("line", "block")
    injected = F.lit(False)
    for opening in BOILERPLATE:
        injected = injected | F.trim("text").startswith(opening)
    kept = each.where((F.length(F.trim("text")) >= MIN_CHARS) & ~((F.col("role") == "user") & injected))
    return kept.select("session", (F.row_number().over(order) - 1).alias("seq"), "ts", "role", F.substring(F.trim("text"), 1, MAX_CHARS).alias("text"), "source", "entrypoint")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"generic": read_generic, "sessions": read_sessions}


def reader(harness: str) -> Callable[[SparkSession, str], DataFrame]:
    """The reader of a harness; an unknown one is a KeyError."""
    return READERS[harness]


def entrypoints(turns: DataFrame) -> DataFrame:
    """(source, entrypoint) of each source's first turn."""
    return turns.groupBy("source").agg(F.min_by("entrypoint", "seq").alias("entrypoint"))


def fill_entrypoints(turns: DataFrame) -> DataFrame:
    """Turns whose unknown entrypoint is filled from the source's first known one."""
    known = turns.where("entrypoint IS NOT NULL").groupBy("source").agg(F.min_by("entrypoint", "seq").alias("known"))
    return turns.join(known, "source", "left").withColumn("entrypoint", F.coalesce("entrypoint", "known")).drop("known")


def marked_sources(heads: DataFrame, markers: list[str]) -> DataFrame:
    """(source) of heads (source, head) in whose first bytes any marker occurs."""
    head = F.substring(F.col("head").cast("binary"), 1, HEAD_BYTES).cast("string")
    hit = F.lit(False)
    for m in markers:
        hit = hit | head.contains(m)
    return heads.groupBy("source").agg(F.bool_or(hit).alias("hit")).where("hit").select("source")


def listed_sources(sources: DataFrame, listed: DataFrame) -> DataFrame:
    """Sources that a no-capture list (path) names, themselves or by a folder above them with .jsonl after its name."""
    parts = F.split("source", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit(".jsonl")))
    every = sources.select("source", F.explode(F.concat(F.array("source"), above)).alias("path"))
    return every.join(listed.select("path").distinct(), "path", "left_semi").select("source").distinct()


def excluded_sources(sources: DataFrame, globs: list[str], home: str = "") -> DataFrame:
    hit = F.lit(False)
    for g in globs:
        hit = hit | F.col("source").rlike(glob_pattern(g, home))
    return sources.where(hit).select("source")


def sync_counts(stored: DataFrame, incoming: DataFrame, globs: list[str] = (), home: str = "") -> DataFrame:
    """(source, added): rows of (source, seq) that the store lacks, by source, without the sources that a glob excludes."""
    kept = incoming.join(excluded_sources(incoming.select("source").distinct(), list(globs), home), "source", "left_anti")
    return kept.join(stored.select("source", "seq"), ["source", "seq"], "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("added"))


def shrunk_sources(stored: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source) whose file (source, bytes) is shorter than the stored cursor (source, cursor): its turns go and it starts anew."""
    return stored.join(sizes, "source").where("bytes < cursor").select("source")


def kept_out(sessions: DataFrame, listed: DataFrame, globs: list[str], markers: list[str], off: bool = False) -> DataFrame:
    """sessions (session, source, prompt) with kept_out: capture is off, the source is listed or excluded, or the prompt
    holds a marker."""
    hidden = listed_sources(sessions.select("source"), listed).union(excluded_sources(sessions.select("source"), globs)).distinct()
    marked = F.lit(off)
    for m in markers:
        marked = marked | F.col("prompt").contains(m)
    both = sessions.join(hidden.withColumn("hidden", F.lit(True)), "source", "left")
    return both.select(*sessions.columns, (F.coalesce("hidden", F.lit(False)) | marked).alias("kept_out"))


def capture_rows(calls: DataFrame) -> DataFrame:
    """Message rows (session, seq, ts, role, text, source) of captured exchanges (session, nth, ts, user, assistant): two a call."""
    each = F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("user").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("assistant").alias("text"))))
    rows = calls.select("session", "nth", "ts", each.alias("m"))
    seq = F.col("nth") * 2 + F.when(F.col("m.role") == "user", 0).otherwise(1)
    return rows.select("session", seq.alias("seq"), "ts", "m.role", "m.text", F.concat("session", F.lit(".jsonl")).alias("source"))


def mirrored_notes(notes: DataFrame) -> DataFrame:
    """Assertions of mirrored notes (seq, target, content, ts, source): relation note, reliability 0.9."""
    return notes.select("seq", F.col("target").alias("subject"), F.lit("note").alias("relation"), F.col("content").alias("value"), F.col("ts").alias("valid_from"), F.lit(0.9).alias("reliability"), "source")


def assertion_lines(lines: DataFrame) -> DataFrame:
    """Tab-separated lines (value) as (subject, relation, value, source); blank lines and # comments are skipped, lines
    with fewer than three fields come back with error true."""
    rows = lines.where("trim(value) <> '' AND NOT value LIKE '#%'").withColumn("f", F.split("value", "\t"))
    return rows.select(
        F.get("f", F.lit(0)).alias("subject"), F.get("f", F.lit(1)).alias("relation"), F.get("f", F.lit(2)).alias("value"), F.get("f", F.lit(3)).alias("source"), (F.size("f") < 3).alias("error")
    )


#: Columns of the scan of an election's results.
ELECTION = (
    "variant string, model string, scenario string, repeat int, expect boolean, class string, recall_called boolean, first_tool string, n_phrasings int, valid boolean, "
    "recall_mismatch boolean, count_mismatch boolean"
)
DECISIONS = "review_id long, decision string, note string"


def read_log(spark: SparkSession, path: str, schema: str, now: F.Column | None = None, days: float | None = None) -> DataFrame:
    """JSON lines of a log; lines that don't parse are dropped, and with ``days`` those whose ts lies further back."""
    log = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if days is None:
        return log
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return log.where(age <= days * 86_400_000_000)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The review inbox: JSON lines {review_id, decision, note}; of several decisions on a review the first counts, and
    what is neither approve nor reject is no decision."""
    rows = spark.read.schema(DECISIONS).option("mode", "DROPMALFORMED").json(path).where(F.col("decision").isin("approve", "reject") & F.col("review_id").isNotNull())
    return rows.groupBy("review_id").agg(F.min(F.struct("decision", "note")).alias("d")).select("review_id", "d.decision", "d.note")
