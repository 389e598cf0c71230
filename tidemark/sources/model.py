"""The driver tables as the model's tables: turns, assertions, logs, verdicts and experiment cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_CHARS = 20
MAX_CHARS = 20_000
#: Every age and window is measured from here; the engine never reads the clock.
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def as_turns(messages: DataFrame) -> DataFrame:
    """Messages (session, seq, ts, role, text, source) as turns: user and assistant, trimmed, 20 to 20,000 characters."""
    text = F.trim(F.col("text"))
    kept = messages.where(F.col("role").isin("user", "assistant")).withColumn("text", text).where(F.length("text") >= MIN_CHARS)
    return kept.withColumn("text", F.substring("text", 1, MAX_CHARS))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, session, seq, ts, role, text, source, entrypoint) from conversations."""
    c = table(spark, sf_dir, "conversations")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ts = start + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"), F.lit(0))
    messages = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session"),
        F.col("turn").alias("seq"),
        ts.alias("ts"),
        "role",
        "text",
        F.concat(F.lit("/home/u/p"), (F.col("conv_id") % 7).cast("string"), F.lit("/conv-"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("source"),
        F.when(F.col("conv_id") % 3 == 0, "cli").when(F.col("conv_id") % 3 == 1, "desktop").alias("entrypoint"),
    )
    return as_turns(messages)


def document_turns(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """One long turn per document, each a session of its own: (id, session, text). ``most``: only so many characters,
    for queries whose SQL has that bound."""
    d = table(spark, sf_dir, "documents")
    text = F.col("text") if most is None else F.substring("text", 1, most)
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("session"), text.alias("text"))


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, subject, relation, value, valid_from, reliability, source) from events; values recur."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").alias("relation"),
        F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")).alias("value"),
        F.col("ts").cast("timestamp_ntz").alias("valid_from"),
        (F.floor(F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(100.0))) / 100).alias("reliability"),
        F.concat(F.lit("memory:session/conv-"), (F.col("event_id") % 400).cast("string"), F.lit("/turn/"), ((F.col("event_id") % 400) * 1000 + F.col("event_id") % 9).cast("string")).alias("source"),
    )


def order_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("subject"),
        F.lit("order status").alias("relation"),
        F.col("o_orderstatus").alias("value"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from"),
        F.lit(0.5).alias("reliability"),
        F.lit("import").alias("source"),
    )


def relevance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, prompt_id, belief_id, rank, p, today, error): up to 20 ranked candidates a prompt (one prompt a user and day)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    prompt = F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    ranked = e.withColumn("prompt_id", prompt).withColumn("rank", F.row_number().over(Window.partitionBy("prompt_id").orderBy("ts", "event_id")))
    p = F.col("value") - F.floor("value")
    return ranked.where("rank <= 20").select(
        "ts", "prompt_id", F.col("event_id").alias("belief_id"), "rank", p.alias("p"), (F.col("rank") <= 6).alias("today"), (F.col("event_type") == "error").alias("error")
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(belief_id, relevant): labels as verdicts on the log's candidates."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("belief_id"), (F.col("quality") == 1).alias("relevant"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment cells from events: variant, scenario, repeat, expect, recall_called, first_tool, phrasings, valid."""
    e = table(spark, sf_dir, "events")
    key = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    return e.withColumn("repeat", F.row_number().over(key) - 1).select(
        F.col("event_type").alias("variant"),
        F.col("user_id").alias("scenario"),
        "repeat",
        F.when(F.col("user_id") % 2 == 0, "recall").otherwise("none").alias("expect"),
        F.concat(F.lit("class"), (F.col("user_id") % 4).cast("string")).alias("class"),
        (F.col("value") > 40).alias("recall_called"),
        (F.col("value") > 80).alias("first_is_recall"),
        (F.col("event_id") % 4).alias("n_phrasings"),
        (F.col("event_id") % 17 != 0).alias("valid"),
    )
