"""Temperature mixing of sources, in DataFrame functions only.

A source's weight is its token share raised to an exponent between 0 (all alike) and 1 (natural), normalised. The
exponent is bisected, a hundred parts at a time down to 1e-6, over sums by source that executors compute: it is the
largest that reaches ``target_entropy`` (nats) if one is given, and at least the smallest under which no source is
repeated more than ``max_repetition`` times if one is given. The limit goes before the entropy; where even 1 breaks
it, 1 is taken.

Realised by block permutations: a source's documents fall by hash into blocks of about ``block_docs``; each block gets
its share of the source's token budget: whole passes over all its documents, and for the rest the documents that come
first in that pass's own permutation, up to the nearest document. No window spans more than a block, whatever a
source's size.

Defined results: tokens are words; a null source is the source ''; documents without a word weigh nothing and a source
of such documents alone is left out. A document without doc_id goes by the MD5 of its text. Repeated rows are documents
of their own; rows of one doc_id with as many tokens are alike to the rule. Empty tables give empty ones; columns of the
input are carried along, but for clashes with the four that are added (epoch, block, tokens, shuffle_key), where the
added ones win (``mixed_rows`` keeps all).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, cut, read

ADDED = ("epoch", "block", "tokens", "shuffle_key")
_SALTS = 16
_STEPS = (100, 10_000, 1_000_000)


@dataclass(frozen=True)
class Target:
    """Budget as a multiple of all tokens, and what the exponent has to meet."""

    budget_ratio: float = 1.0
    target_entropy: float | None = None
    max_repetition: float | None = 2.0
    block_docs: int = 512
    seed: int = 1


def _first(sizes: DataFrame, meets: F.Column, total: float) -> int:
    """The least exponent, in millionths, that meets a condition on (z, zl, least) which holds from there up to 1."""
    low, high = 0, 1_000_000  # the answer lies in [low, high]; 1 is taken unasked
    for parts in _STEPS:
        step = 1_000_000 // parts
        grid = list(range(low, high, step))
        share = F.log(F.col("tokens") / F.lit(total))
        rows = sizes.select(share.alias("l"), F.explode(F.array(*[F.lit(g) for g in grid])).alias("g"))
        power = F.exp(F.col("g") / 1e6 * F.col("l"))
        sums = rows.groupBy("g").agg(F.sum(power).alias("z"), F.sum(power * F.col("l")).alias("zl"), F.min("l").alias("least"))
        good = [r["g"] for r in sums.where(meets).select("g").collect()]
        high = min(good, default=high)
        low = max(low, high - step)
    return high


def exponent(sizes: DataFrame, target: Target) -> tuple[float, float]:
    """(exponent, total tokens) for ``sizes``: one row with tokens > 0 a source. Only sums by exponent reach the driver."""
    total = sizes.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0, 0.0
    a = F.col("g") / 1e6
    chosen = 1_000_000
    if target.target_entropy is not None:
        entropy = F.log("z") - a * F.col("zl") / F.col("z")
        below = _first(sizes, entropy < target.target_entropy, total)
        chosen = below if below == 1_000_000 else max(0, below - 1)
    if target.max_repetition is not None:
        most = target.budget_ratio / F.col("z") * F.exp((a - 1) * F.col("least"))
        least = _first(sizes, most <= target.max_repetition, total)
        chosen = max(chosen, least) if target.target_entropy is not None else least
    return chosen / 1e6, float(total)


def _hash(*parts) -> F.Column:
    return F.md5(F.concat_ws(":", *parts))


def repetitions(sizes: DataFrame, target: Target) -> DataFrame:
    """(source, passes, n): how often each source is passed over, and its number of documents."""
    alpha, total = exponent(sizes, target)
    power = F.exp(F.lit(alpha) * F.log(F.col("tokens") / F.lit(total or 1.0)))
    summed = sizes.agg(F.sum(power)).first()[0] or 1.0
    passes = F.lit(target.budget_ratio * total / summed) * power / F.col("tokens")
    return sizes.select("source", passes.alias("passes"), "n")


def mix(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The rows to train on: columns of ``docs`` (doc_id, text and source among them), epoch, block, tokens, shuffle_key.

    A document appears once for each pass it is in. Order of training: by epoch, block hash and shuffle_key.
    """
    carried = [c for c in docs.columns if c not in ADDED]
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary")))
    counted = docs.select(*carried, F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"), name.alias("__name"))
    sizes = counted.groupBy(source.alias("source")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes.where("tokens > 0"), "mixing-sizes")
    share = repetitions(sizes, target).withColumnsRenamed({"source": "__source", "passes": "__passes", "n": "__n"})
    seed, doc = F.lit(str(target.seed)), F.col("__name")
    share = share.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))  # a source's rows don't meet in one task
    rows = counted.withColumns({"__source": source, "__salt": F.pmod(F.xxhash64(doc), F.lit(_SALTS)).cast("int")}).join(share, ["__source", "__salt"])
    blocks = F.ceil(F.col("__n") / target.block_docs)
    rows = rows.withColumn("block", (F.conv(F.substring(_hash(seed, doc), 1, 7), 16, 10).cast("long") % blocks).cast("int"))
    whole = F.floor("__passes")
    block = Window.partitionBy("__source", "block")
    order = block.orderBy(_hash(seed, doc, whole), doc, "tokens").rowsBetween(Window.unboundedPreceding, -1)
    before, own = F.coalesce(F.sum("tokens").over(order), F.lit(0)), F.sum("tokens").over(block)
    extra = before + F.col("tokens") / 2 < (F.col("__passes") - whole) * own
    rows = rows.withColumn("__times", (whole + F.when(extra, 1).otherwise(0)).cast("int")).where("__times > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    return rows.select(*carried, "epoch", "block", "tokens", F.substring(_hash(seed, doc, F.col("epoch")), 1, 16).alias("shuffle_key"))


def mixed_rows(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """What ``mix`` takes of ``docs``, a row for each pass, with all columns of ``docs`` and no other, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", "source")
    return mix(rows, target).select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return mix(docs).select("doc_id", "source", "epoch", "block", "tokens", "shuffle_key")


def _sql(target: Target) -> str:
    """The same for DuckDB, with the bisection unrolled."""
    find, low, high = [], "0", "1000000"
    for k, parts in enumerate(_STEPS):
        step = 1_000_000 // parts
        find.append(
            f"""grid{k} AS (SELECT g::DOUBLE AS g FROM (SELECT unnest(range({low}, {high}, {step})) AS g)),
            sums{k} AS (SELECT g, sum(exp(g / 1e6 * l)) AS z, min(l) AS least FROM grid{k}, logs GROUP BY g),
            found{k} AS (SELECT coalesce(min(g) FILTER (WHERE {target.budget_ratio} / z * exp((g / 1e6 - 1) * least) <= {target.max_repetition})::BIGINT, ({high})) AS high FROM sums{k})"""
        )
        high = f"(SELECT high FROM found{k})"
        low = f"greatest(0, {high} - {step})"
    return f"""
    WITH counted AS (SELECT doc_id, source, coalesce(source, '') AS s, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS d,
            len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS tokens FROM documents),
    sizes AS (SELECT s, sum(tokens)::BIGINT AS t, count(*) AS n FROM counted GROUP BY s HAVING sum(tokens) > 0),
    total AS (SELECT sum(t)::DOUBLE AS total FROM sizes),
    logs AS (SELECT ln(t / total) AS l FROM sizes, total),
    {", ".join(find)},
    powers AS (SELECT s, t, n, exp({high} / 1e6 * ln(t / total)) AS p, total FROM sizes, total),
    share AS (SELECT s, n, {target.budget_ratio} * total / (SELECT sum(p) FROM powers) * p / t AS passes FROM powers),
    blocked AS (SELECT *, (('0x' || substr(md5(concat_ws(':', '{target.seed}', d)), 1, 7))::BIGINT % ceil(n / {target.block_docs}.0)::BIGINT)::INTEGER AS block,
            floor(passes)::BIGINT AS whole FROM counted JOIN share USING (s)),
    timed AS (SELECT *, whole + CASE WHEN
            coalesce(sum(tokens) OVER (PARTITION BY s, block ORDER BY md5(concat_ws(':', '{target.seed}', d, whole)), d, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + tokens / 2.0 < (passes - whole) * sum(tokens) OVER (PARTITION BY s, block) THEN 1 ELSE 0 END AS times FROM blocked),
    epochs AS (SELECT *, unnest(range(0, times)) AS e FROM timed)
    SELECT doc_id, source, e::INTEGER AS epoch, block, tokens, substr(md5(concat_ws(':', '{target.seed}', d, e)), 1, 16) AS shuffle_key FROM epochs"""


SQL = _sql(Target())
