"""What gets captured and why not, what a store's state says, explanations, and checks on answers of outside scorers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import durability
from ..functions.text import clip_middle, glob_pattern


def reasons(sources: DataFrame, listed: list[str], globs: list[str], markers: list[str]) -> DataFrame:
    """(source, head) with reason, null where captured; the first that applies: no capture, pattern, marker."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | F.col("source").rlike(glob_pattern(g))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.col("head").contains(m)
    reason = F.when(F.col("source").isin(listed), "no capture").when(hit, "pattern").when(marked, "marker")
    return sources.withColumn("reason", reason)


def mirror_counts(classified: DataFrame, copied: DataFrame) -> DataFrame:
    """(reason, sources): a mirror's skips by reason; of the rest, unchanged if the copy is as new and as large, else
    copied."""
    both = classified.join(copied.withColumnsRenamed({"mtime": "m", "size": "s"}), "source", "left")
    same = (F.col("m") >= F.col("mtime")) & (F.col("s") == F.col("size"))
    why = F.coalesce("reason", F.when(same, "unchanged").otherwise("copied"))
    return both.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("sources"))


def occurrences(files: DataFrame, needle: str) -> DataFrame:
    """(path, hits): how often a text occurs, overlaps included."""
    pattern = "(?=(" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in needle) + "))"
    return files.select("path", F.size(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("hits"))


def needles(value: str) -> list[str]:
    """A value as JSON text holds it: escaped, with and without escapes of what isn't ASCII."""
    return list(dict.fromkeys(json.dumps(value, ensure_ascii=plain)[1:-1] for plain in (False, True)))


def offset_hits(files: DataFrame, forms: list[str]) -> DataFrame:
    """(path, hits) of files (path, content binary): byte offsets at which any form begins, overlaps included, each once."""
    found = []
    for form in forms:
        raw = form.encode().hex().upper()
        places = f"filter(sequence(0, octet_length(content) - {len(raw) // 2}), i -> hex(substring(content, i + 1, {len(raw) // 2})) = '{raw}')"
        found.append(f"IF(octet_length(content) >= {len(raw) // 2}, {places}, array())")
    return files.select("path", F.expr(f"size(array_distinct(concat({', '.join(found)})))").alias("hits"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A table with rows merged in: for each key the latest by ``order`` wins."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return table.unionByName(rows).withColumn("__nth", F.row_number().over(newest)).where("__nth = 1").drop("__nth")


def emptied_sessions(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("session").distinct().join(after.select("session").distinct(), "session", "left_anti")


def plan_calls(regions: DataFrame, chunk: int) -> DataFrame:
    """One row: sessions, excerpts, and the calls that excerpts in chunks need, each session on its own."""
    own = regions.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return own.agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("excerpts"), F.sum(F.ceil(F.col("n") / chunk)).alias("calls"))


def store_verdicts(stats: DataFrame, *keys: str) -> DataFrame:
    """(keys, verdict): what is wrong with a store's totals (turns, sessions, passages, beliefs, current_beliefs)."""
    rules = [
        (F.col("turns") == 0, "no turns: nothing was captured"),
        ((F.col("turns") > 0) & (F.col("passages") < F.col("turns")), "turns without passages"),
        ((F.col("turns") > 0) & (F.col("beliefs") == 0), "no beliefs: nothing was derived"),
        ((F.col("beliefs") > 0) & (F.col("current_beliefs") == 0), "no current beliefs"),
        ((F.col("sessions") > 0) & (F.col("turns") / F.col("sessions") < 2), "under two turns a session"),
    ]
    said = F.array_compact(F.array(*[F.when(when, F.lit(text)) for when, text in rules]))
    return stats.select(*keys, F.explode(said).alias("verdict"))


def explain(beliefs: DataFrame) -> DataFrame:
    """Every test of the gate with its result, beside the class it leads to. Each triple is tested once, however many
    beliefs say it, and its veto is worked out once for all tests."""
    fields = ("subject", "relation", "value")
    tests = beliefs.select(*fields).distinct().withColumn("veto", durability.veto())
    tests = tests.withColumns(
        {
            "is_measurement": durability.measurement(vetoed="veto"),
            "is_moving_version": durability.moving_version(vetoed="veto"),
            "is_status": durability.status(vetoed="veto"),
            "order": durability.instruction_shape(),
        }
    )
    kind = F.when(F.col("is_measurement"), durability.MEASUREMENT).when(F.col("is_moving_version"), durability.MOVING_VERSION).when(F.col("is_status"), durability.STATUS)
    tests = tests.withColumn("class", kind).withColumnsRenamed({c: f"tested_{c}" for c in fields})
    same = [F.col(c).eqNullSafe(F.col(f"tested_{c}")) for c in fields]
    return beliefs.join(tests, same).drop(*[f"tested_{c}" for c in fields])


def fact_text(limit: int = 300) -> F.Column:
    return clip_middle("fact", limit)


def facts(beliefs: DataFrame, limit: int = 300) -> DataFrame:
    return beliefs.withColumn("fact", F.concat("subject", F.lit(" "), "relation", F.lit(": "), "value")).withColumn("fact", fact_text(limit))


def event_time(text: F.Column, now: F.Column) -> F.Column:
    """An ISO time to the second in UTC; null if it can't be read or lies more than a day ahead."""
    parsed = F.date_trunc("second", F.try_to_timestamp(text)).cast("timestamp_ntz")
    return F.when(parsed <= now + F.make_dt_interval(F.lit(1)), parsed)


def valid_scores(answers: DataFrame) -> DataFrame:
    """Answers (prompt_id, belief_id, p) of prompts where every candidate has one probability within [0, 1]; the answers of
    any other prompt count as none."""
    bad = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1)
    wrong = answers.groupBy("prompt_id").agg(F.bool_or(bad).alias("bad"), (F.count(F.lit(1)) != F.countDistinct("belief_id")).alias("twice")).where("bad OR twice")
    return answers.join(wrong.select("prompt_id"), "prompt_id", "left_anti")


def scored(log: DataFrame, scorer) -> DataFrame:
    """The log (prompt_id, belief_id, rank, prompt, fact, ...) with p from ``scorer``, a function of (prompt_id, belief_id,
    prompt, fact) to (prompt_id, belief_id, p), such as a model's answers. A prompt whose answers aren't one probability for
    each candidate has none: p is null throughout, and ``experiments.choose`` falls back to its order."""
    asked = log.select("prompt_id", "belief_id", "prompt", "fact")
    answers = valid_scores(scorer(asked).select("prompt_id", "belief_id", "p"))
    whole = answers.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("got"))
    wanted = log.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("want")).join(whole, "prompt_id").where("got = want").select("prompt_id")
    return log.drop("p").join(answers.join(wanted, "prompt_id", "left_semi"), ["prompt_id", "belief_id"], "left")


def needed_pairs(log: DataFrame, k: int, pools: list[int]) -> DataFrame:
    """(prompt_id, belief_id): what any pool's first k by p would pick; these need labels."""
    order = Window.partitionBy("prompt_id", "pool").orderBy(F.desc("p"), "rank")
    rows = log.where("p IS NOT NULL").withColumn("pool", F.explode(F.array(*[F.lit(p) for p in pools]))).where(F.col("rank") <= F.col("pool"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("prompt_id", "belief_id").distinct()


def parsed_answers(raw: DataFrame) -> DataFrame:
    """(id, n, anchor, keep, subject, relation, value) from model output (id, text): code fences off, a JSON array, or
    whatever flat objects with n can be saved from it."""
    item = "struct<n:int,anchor:string,keep:boolean,subject:string,relation:string,value:string>"
    bare = F.regexp_replace(F.trim("text"), r"^```[a-z]*\s*|\s*```$", "")
    whole = F.from_json(bare, f"array<{item}>")
    saved = F.transform(F.regexp_extract_all(bare, F.lit(r"(\{[^{}]*\})"), 1), lambda x: F.from_json(x, item))
    usable = F.when(F.size(F.filter(whole, lambda x: x["n"].isNotNull())) > 0, whole).otherwise(saved)
    return raw.select("id", F.inline(F.filter(usable, lambda x: x["n"].isNotNull())))


def out_of_copy(calls: DataFrame, root: str) -> DataFrame:
    """(run, path): path arguments (run, args array) that are absolute and leave the working copy."""
    each = calls.select("run", F.explode("args").alias("path"))
    return each.where(F.col("path").startswith("/") & ~(F.col("path").startswith(root + "/") | (F.col("path") == root))).distinct()
