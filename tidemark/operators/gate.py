"""The injection gate with manifests: what keeps a current belief out of prompts, in which order, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.durability import classify, instruction_shape, tokens
from ..functions.text import array_of, belief_line, release, subject_terms

DERIVED_RELIABILITY, DERIVED_SOURCE = 0.5, "memory:session/"
OLDER, CONTRADICTED, INSTRUCTION = "older_version", "contradicted", "instruction"


def person(beliefs: DataFrame) -> DataFrame:
    """beliefs with the three exemptions: above (reliability), stated (source is no session pointer), confirmed."""
    return beliefs.withColumns(
        {
            "above": F.coalesce(F.col("reliability") > DERIVED_RELIABILITY, F.lit(False)),
            "stated": ~F.coalesce("source", F.lit("")).startswith(DERIVED_SOURCE),
            "confirmed": F.coalesce("confirmed", F.lit(False)),
        }
    )


def manifest_rule(beliefs: DataFrame, declared: DataFrame) -> DataFrame:
    """(id, manifest, named): beliefs that the version a manifest declares (package, version, path) overrules.

    The subject must share a term with the package, the first such package by path counts. older_version: beside the
    package's name stands a version behind the declared one. contradicted: the belief is about the package's own version
    and names another. Placeholder versions 0.0.0 declare nothing. Terms are joined by equality.
    """
    real = declared.where(~F.col("version").startswith("0.0.0"))
    packages = real.select("package", "version", "path", F.explode(subject_terms("package")).alias("term"))
    rows = beliefs.select("id", "subject", "relation", "value", F.explode(subject_terms("subject")).alias("term"))
    first = Window.partitionBy("id").orderBy("path", "package")
    met = rows.join(packages, "term").dropDuplicates(["id", "path", "package", "term"])
    met = met.withColumn("nth", F.dense_rank().over(first)).where("nth = 1")
    beside = r"(?i)(?<![\\w.-])\\Q', term, '\\E[\\s@_-]*v?(\\d+(?:\\.\\d+){1,3})\\b"
    named = F.expr(f"regexp_extract_all(concat(subject, ' ', relation), concat('{beside}'), 1)")
    met = met.withColumn("behind", F.filter(named, lambda v: release_of(v) < release("version")))
    rest = F.expr(f"array_except({tokens('concat(subject, chr(32), relation)')}, {tokens('package')})")
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^v", "")
    own = F.arrays_overlap(rest, F.expr(array_of(W.VERSION_NOUNS))) & (F.size(F.array_except(rest, F.expr(array_of(W.OWN_VERSION_WORDS)))) == 0)
    against = own & F.trim("value").rlike(W.VERSION) & (plain("value") != plain("version"))
    found = met.withColumns({"older": F.try_element_at("behind", F.lit(1)), "against": against, "length": F.length("term")})
    best = found.groupBy("id").agg(
        F.max_by("older", F.when(F.col("older").isNotNull(), F.col("length"))).alias("older"), F.max("against").alias("against"), F.min(F.trim("value")).alias("value")
    )
    kind = F.when(F.col("older").isNotNull(), OLDER).when(F.col("against"), CONTRADICTED)
    return best.select("id", kind.alias("manifest"), F.coalesce("older", "value").alias("named")).where("manifest IS NOT NULL")


def release_of(version: F.Column) -> F.Column:
    """As ``release``, of a column within a lambda."""
    parts = F.transform(F.split(version, "\\."), lambda x: x.cast("int"))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 8)), 1, 8)


def explain(beliefs: DataFrame, declared: DataFrame, now: F.Column, window_days: float = 7.0) -> DataFrame:
    """beliefs with every test and the reason: an order; else nothing for what a person stated; else what a manifest
    overrules; else a volatile class outside the window. Columns added: above, stated, confirmed, manifest, named, class,
    young, order, reason (null: injected)."""
    rows = person(beliefs).join(manifest_rule(beliefs, declared), "id", "left")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("valid_from").cast("timestamp"))
    rows = rows.withColumns({"class": classify(), "young": F.coalesce(age < window_days * 86_400_000_000, F.lit(False)), "order": instruction_shape()})
    reason = (
        F.when(F.col("order").isNotNull(), INSTRUCTION)
        .when(F.col("above") | F.col("stated") | F.col("confirmed"), None)
        .when(F.col("manifest").isNotNull(), F.col("manifest"))
        .when(~F.col("young"), F.col("class"))
    )
    return rows.withColumn("reason", reason)


def admits_hit(volatile: F.Column, valid_from: F.Column, now: F.Column, window_days: float = 0.0) -> F.Column:
    """Whether a reader that has only a recall hit may show it: never an order, a volatile one only inside the window."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(valid_from.cast("timestamp"))
    young = F.coalesce(age < window_days * 86_400_000_000, F.lit(False)) if window_days else F.lit(False)
    return F.when(volatile == INSTRUCTION, False).when(volatile.isNull(), True).otherwise(young)


def prefetch(hits: DataFrame, beliefs: DataFrame, now: F.Column, k: int = 6, window_days: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """((qid, rank, line), uses (kind, id, ts)): of ranked hits (qid, rank, id) the first ``k`` that may be shown, and the
    use that showing them records."""
    volatile = F.when(instruction_shape().isNotNull(), INSTRUCTION).otherwise(classify())
    own = beliefs.withColumn("admitted", admits_hit(volatile, F.col("valid_from"), now, window_days)).where("admitted")
    order = Window.partitionBy("qid").orderBy("rank")
    kept = hits.select("qid", "rank", "id").join(own, "id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    shown = kept.select("qid", F.col("place").alias("rank"), belief_line("subject", "relation", "value", "recorded_at").alias("line"))
    return shown, kept.select(F.lit("belief").alias("kind"), "id", now.alias("ts")).distinct()


def project_beliefs(beliefs: DataFrame, names: list[str]) -> DataFrame:
    """Current beliefs whose subject shares a whole term with a project's names, the newest first."""
    wanted = sorted({n.lower().strip("./-") for n in " ".join(names).split()} - {""})
    hit = F.arrays_overlap(subject_terms("subject"), F.expr(array_of(wanted))) if wanted else F.lit(False)
    return beliefs.where(hit & F.expr("valid_to IS NULL AND status = 'committed'")).orderBy(F.desc("valid_from"), F.desc("id"))

