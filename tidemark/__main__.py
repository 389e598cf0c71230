"""Command line over a folder of driver tables: python -m tidemark FOLDER COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Memory
from .operators import mining, recall, repair, reports, upkeep
from .session import local_session
from .sources import model, sinks, transcripts

K = ("--k", {"type": int, "default": 5})
#: Command: its arguments, and what it shows for (memory, arguments).
COMMANDS: dict[str, tuple[list, object]] = {
    "recall": ([("queries", {"nargs": "+"}), K], lambda m, a: m.recall(a.queries, a.k)),
    "recall-all": ([("queries", {"nargs": "+"}), K], lambda m, a: m.recall_all(a.queries, a.k)),
    "facts": ([("queries", {"nargs": "+"}), K, ("--subject-rule", {"action": "store_true"})], lambda m, a: m.recall_beliefs(a.queries, a.k, a.subject_rule)),
    "read": ([("session", {}), ("--anchor", {"type": int}), ("--window", {"type": int, "default": 5})], lambda m, a: m.read_session(a.session, a.anchor, a.window)),
    "beliefs": ([("--subject", {}), ("--at", {})], lambda m, a: m.beliefs(a.subject, a.at)),
    "stale": ([], lambda m, a: m.stale().select("id", "subject", "relation", "value", "reason")),
    "explain": ([("--subject", {})], lambda m, a: m.explain().where(F.lit(True) if a.subject is None else F.col("subject") == a.subject)),
    "history": ([("subject", {}), ("relation", {})], lambda m, a: m.history(a.subject, a.relation)),
    "retract": ([("ids", {"nargs": "+", "type": int}), ("--reason", {"default": "by hand"})], lambda m, a: m.retract(dict.fromkeys(a.ids, a.reason))[1]),
    "review": ([], lambda m, a: m.pending_reviews()),
    "review-items": ([], lambda m, a: m.review_items()),
    "review-sync": ([("inbox", {})], lambda m, a: m.decide_inbox(a.inbox)),
    "approve": ([("id", {"type": int})], lambda m, a: _decided(m, a.id, "approve")),
    "reject": ([("id", {"type": int})], lambda m, a: _decided(m, a.id, "reject")),
    "assert": ([("file", {})], lambda m, a: _asserted(m, a.file)),
    "context": ([("prompt", {}), ("--k", {"type": int, "default": 6})], lambda m, a: m.context(m.spark.createDataFrame([(0, a.prompt)], "qid long, text string"), a.k).select("line")),
    "digest": ([("project", {}), ("--name", {"action": "append", "default": []})], lambda m, a: m.project_digest(a.project, a.name) if a.name else m.digest(a.project)),
    "stats": ([], lambda m, a: m.stats()),
    "projects": ([], lambda m, a: reports.top_projects(m.turns)),
    "provenance": ([], lambda m, a: reports.provenance(m.turns, repair.cited(m.timeline()).select("cited_session", "cited_turn"))),
    "exclude": ([("globs", {"nargs": "+"})], lambda m, a: reports.exclude_preview(m.turns.select("source").distinct(), a.globs)),
    "prune": ([("text", {})], lambda m, a: m.prune(F.col("text").contains(a.text))[1]),
    "redact": ([("secret", {})], lambda m, a: upkeep.withheld_plan(m.redact(a.secret), a.secret)),
    "unindex": ([("sources", {"nargs": "+"})], lambda m, a: m.unindex(a.sources).stats()),
    "derive": ([], lambda m, a: mining.derive(mining.regions(m.turns), mining.copula_extractor)),
    "passages": ([("session", {})], lambda m, a: recall.passage_table(m.turns.where(F.col("session") == a.session))),
    "snapshot": ([("backups", {}), ("stamp", {})], lambda m, a: _said(m, sinks.write_snapshot(m.turns, a.backups, a.stamp))),
    "snapshots": ([("backups", {})], lambda m, a: _said(m, *sinks.snapshots(m.spark, a.backups))),
}


def _said(memory: Memory, *lines: str) -> DataFrame:
    return memory.spark.createDataFrame([(x,) for x in lines], "line string")


def _decided(memory: Memory, review: int, decision: str) -> DataFrame:
    return memory.decide(memory.spark.createDataFrame([(review, decision)], "review_id long, decision string"))


def _asserted(memory: Memory, file: str) -> DataFrame:
    """The outcome of the current beliefs once a file of tab-separated facts is remembered."""
    lines = transcripts.assertion_lines(memory.spark.read.text(file)).where("NOT error")
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("user"))
    return memory.remember(lines.select("subject", "relation", "value", source.alias("source"))).beliefs()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("folder")
    parser.add_argument("--json", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (options, _) in COMMANDS.items():
        sub = commands.add_parser(name)
        for flag, how in options:
            sub.add_argument(flag, **how)
    given = parser.parse_args(args)
    spark = local_session()
    memory = Memory(spark, model.turns(spark, given.folder), model.assertions(spark, given.folder))
    rows = COMMANDS[given.command][1](memory, given)
    shown = sinks.as_json(rows) if given.json else sinks.as_tsv(rows, rows.columns)
    for line in shown.toLocalIterator():
        print(line["line"])


if __name__ == "__main__":
    main()
