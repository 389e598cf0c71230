"""The Memory object and the command line over the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark import __main__ as cli
from tidemark.api import Memory, clamp
from tidemark.sources import model


@pytest.fixture(scope="module")
def memory(spark, small):
    return Memory(spark, model.turns(spark, small), model.assertions(spark, small))


def test_clamp():
    assert [clamp(v, 1, 50) for v in (-3, 7, 99)] == [1, 7, 50]


def test_recall_and_read(memory):
    text = memory.turns.orderBy("id").first()["text"]
    words = " ".join(text.split()[:12])
    hits = memory.recall([words, words.upper(), text[:80]], k=3).collect()
    assert [r["rank"] for r in hits] == list(range(1, len(hits) + 1)) and hits
    first = memory.turns.orderBy("id").first()
    assert memory.read_session(first["session"], first["seq"], 0).count() == 1


def test_beliefs(memory):
    now = memory.beliefs()
    assert now.groupBy("key").count().where("count > 1").count() == 0
    subject = now.first()["subject"]
    assert memory.beliefs(f' "{subject.upper()}" ').count() == now.where(F.col("subject") == subject).count() > 0
    assert memory.beliefs(at="2020-01-01").count() == 0
    assert memory.history(subject, now.where(F.col("subject") == subject).first()["relation"]).count() >= 1


def test_remember_supersedes(spark, memory):
    one = memory.beliefs().first()
    more = memory.remember(spark.createDataFrame([(one["subject"], one["relation"], "brand new")], "subject string, relation string, value string"))
    assert more.beliefs(one["subject"]).where(F.col("relation") == one["relation"]).first()["value"] == "brand new"
    gated = Memory(spark, memory.turns, memory.assertions, policy="gate")
    assert gated.accepted().count() + gated.pending_reviews().count() == memory.assertions.count()


def test_prune_retracts_only_what_it_orphans(memory):
    session = memory.turns.first()["session"]
    after, plan = memory.prune(F.col("session") == session)
    assert after.turns.where(F.col("session") == session).count() == 0
    cited = memory.timeline().where(F.col("source").startswith(f"memory:session/{session}/")).count()
    assert plan.where("action = 'retract'").count() == cited


def test_digest_and_stats(memory):
    folder = memory.turns.first()["source"].rsplit("/", 1)[0]
    assert memory.digest(folder).first()["text"].startswith("- 2024")
    assert memory.stats().first()["turns"] == memory.turns.count()


def test_command_line(small, capsys, memory):
    cli.main([small, "stats"])
    assert capsys.readouterr().out.split("\t")[0] == str(memory.turns.count())
    cli.main([small, "--json", "beliefs", "--subject", memory.beliefs().first()["subject"]])
    assert capsys.readouterr().out.startswith("{")
