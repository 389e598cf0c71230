"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by SHA-256. The ledger holds, for a blob and a rule version, the
spans found, none included. A scan reads only blobs that the ledger lacks under the present rule version; its rows
join the ledger, and the ledger's findings join back to all paths. Changing a rule changes the rule version, so all
blobs come up again; a copy of a known text never does.

Positions: the pieces between matches (split) and the matches themselves, summed up in order, give each match's start
in code points. Matches are leftmost and don't overlap within a kind.

Defined results: a null text counts as empty: no spans. Repeated versions give repeated rows; a text of any length is
scanned whole; empty tables give empty ones; other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read, shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` has fewer than ``least`` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The kinds in the order in which equal starts are listed. The first three are the base kinds; lengths
# stand in the pattern where that can't change what a match consumes.
BASE = (
    Rule("assign", "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED
LEDGER = "blob binary, rule_version string, spans array<struct<start:int,ord:int,stop:int,kind:string>>"
SPANS = "array<struct<start:int,ord:int,stop:int,kind:string>>"


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans_of(text: str, rules: tuple[Rule, ...]) -> F.Column:
    """All spans of a text column, by start, then kind as listed."""
    return F.array_sort(F.concat(*[_spans(text, order, rule) for order, rule in enumerate(rules)]))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, order: int, rule: Rule) -> F.Column:
    pattern = _literal(rule.pattern)
    sql = f"""
    CASE WHEN {text} RLIKE {pattern} THEN aggregate(
        zip_with(
            regexp_extract_all({text}, {pattern}, 0),
            zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, {rule.group}), (p, g) -> struct(length(p) AS gap, length(g) AS size)),
            (m, x) -> struct(length(m) AS size, x.gap AS gap, x.size AS kept)),
        CAST(struct(0, array()) AS struct<at:int,found:{SPANS}>),
        (a, x) -> struct(
            a.at + x.gap + x.size AS at,
            IF(x.size IS NOT NULL AND x.kept >= {rule.least},
               concat(a.found, array(struct(a.at + x.gap AS start, {order} AS ord, a.at + x.gap + x.size AS stop, '{rule.kind}' AS kind))),
               a.found) AS found),
        a -> a.found) ELSE CAST(array() AS {SPANS}) END"""
    return F.expr(sql)


def content_id(text: str = "text") -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the blobs of ``versions`` (text) that ``ledger`` lacks."""
    version = rule_version(rules)
    blobs = versions.select(content_id().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return blobs.select("blob", F.lit(version).alias("rule_version"), spans_of("text", rules).alias("spans"))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path, None if nothing was written there yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def update(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks of ``versions``, append it there, and return the ledger as it then is.

    A second call over the same versions, or over copies of their texts at other paths, scans nothing.
    """
    spark = versions.sparkSession
    scan_unseen(versions, stored(spark, path), rules).write.mode("append").parquet(path)
    return stored(spark, path)


def join_back(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All paths of ``versions`` with their blob's spans under the present rules."""
    known = ledger.where(F.col("rule_version") == rule_version(rules)).select("blob", "spans")
    paths = versions.select(*[c for c in versions.columns if c != "text"], content_id().alias("blob"))
    return paths.join(known, "blob", "left")


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    versions = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ledger = update(versions, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")  # a new one: the whole table is unseen
    found = join_back(versions, ledger)
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select(
        "doc_id",
        *[F.expr(f"size(filter(spans, s -> s.kind = '{r.kind}'))").cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    lists = []
    for order, rule in enumerate(RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        lists.append(
            f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {pattern})) + 1), lambda i: {{
                'start': list_sum(list_transform((string_split_regex(t, {pattern}))[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform((regexp_extract_all(t, {pattern}))[1:i - 1], lambda x: length(x))), 0),
                'ord': {order},
                'size': length((regexp_extract_all(t, {pattern}))[i]),
                'kept': length((regexp_extract_all(t, {pattern}, {rule.group}))[i]),
                'kind': '{rule.kind}'}}), lambda z: z.kept >= {rule.least})"""
        )
    show = "list_transform({}, lambda y: concat(y.kind, ':', y.start::BIGINT, ':', (y.start + y.size)::BIGINT))"
    counts = ", ".join(f"len(list_filter(all_spans, lambda x: x.kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE)
    base = f"list_filter(all_spans, lambda x: x.ord < {len(BASE)})"
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS (SELECT doc_id, list_sort(list_concat({", ".join(lists)})) AS all_spans FROM texts)
    SELECT doc_id, {counts}, sha256(coalesce(array_to_string({show.format(base)}, ','), '')) AS base_sha256,
        coalesce(array_to_string({show.format("all_spans")}, ','), '') AS spans
    FROM found"""


SQL = _sql()
