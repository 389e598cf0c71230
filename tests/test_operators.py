"""Ledger, recall, repair, experiments, sources and streams on small cases."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiments, ledger, recall, repair, reports
from tidemark.sources import sinks, transcripts
from tidemark.streaming import incremental

DAY = dt.datetime(2024, 1, 1)


def facts(spark, rows):
    """(value, day, reliability) in order of arrival, all of one key."""
    data = [(i + 1, "Repo", "default branch", v, DAY + dt.timedelta(days=d), r, "import") for i, (v, d, r) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, subject string, relation string, value string, valid_from timestamp_ntz, reliability double, source string")


def test_supersession(spark):
    got = ledger.timeline(facts(spark, [("8080", 0, 0.5), ("8443", 31, 0.5)])).orderBy("valid_from").collect()
    assert [(r.value, r.valid_to) for r in got] == [("8080", DAY + dt.timedelta(days=31)), ("8443", None)]


def test_reinforcement(spark):
    got = ledger.timeline(facts(spark, [("main", 0, 0.5), (" MAIN. ", 1, 0.9)])).collect()
    assert [(r.value, r.reliability, r.use_count) for r in got] == [("main", 0.9, 1)]


def test_order_of_arrival_does_not_matter(spark):
    rows = [("a", 1, 0.5), ("b", 2, 0.5), ("a", 3, 0.5), ("c", 4, 0.5)]
    seen = set()
    for k in range(4):
        shuffled = random.Random(k).sample(rows, len(rows))
        seen.add(tuple((r.value, r.valid_from, r.valid_to) for r in ledger.timeline(facts(spark, shuffled)).orderBy("valid_from").collect()))
    assert len(seen) == 1


def test_arrival_mode_only_reinforces_a_value_that_returns(spark):
    got = {r.seq: r.outcome for r in ledger.arrival_outcomes(facts(spark, [("a", 1, 0.5), ("a", 3, 0.5), ("b", 2, 0.5)])).collect()}
    assert got == {1: "created", 2: "reinforced", 3: "superseded"}


def test_gate_and_review(spark):
    rows = facts(spark, [("a", 1, 0.9), ("b", 2, 0.3), ("c", 3, 0.95)])
    assert [r.outcome for r in ledger.gated_outcomes(rows).orderBy("seq").collect()] == ["created", "pending_review", "superseded"]
    opened = ledger.reviews(rows)
    approve = opened.select("review_id", F.lit("approve").alias("decision"))
    got = ledger.decide(opened, rows, approve).first()
    assert (got.status, got.incumbent, got.incumbent_valid_to) == ("committed", 1, DAY + dt.timedelta(days=2))


def test_await(spark):
    got = ledger.awaited_outcomes(facts(spark, [("a", 1, 0.1), ("b", 2, 0.9), ("a", 3, 0.5)])).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["created", "pending_review", "reinforced"]


def test_repairs(spark):
    beliefs = ledger.timeline(facts(spark, [("a", 1, 0.5), ("b", 2, 0.5), ("c", 3, 0.5), ("d", 4, 0.5)]))
    plan = lambda ids: {(r.action, r.id, r.superseded_by) for r in repair.repairs(beliefs, spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert plan([2, 3]) == {("retract", 2, 3), ("retract", 3, 4), ("relink", 1, 4)}
    assert plan([4]) == {("retract", 4, None), ("reopen", 3, None)}


def test_redaction(spark):
    rows = [(1, "api", "token", "hunter2-secret", "committed"), (2, "api", "token", "h​unter2-secret", "committed"), (3, "api", "port", "80", "committed")]
    beliefs = spark.createDataFrame(rows, "id long, subject string, relation string, value string, status string")
    got = {r.id: (r.value, r.status) for r in repair.redact_plan(beliefs, "hunter2-secret").collect()}
    assert got == {1: ("[redacted]", "retracted"), 2: ("[redacted]", "retracted")}
    with pytest.raises(ValueError):
        repair.redact_plan(beliefs, "abc")


def test_identical_prompts_take_one_slot(spark):
    rows = [(i, f"s{i}", 0, DAY + dt.timedelta(days=i), "user", "deploy the gateway to port 8443 today") for i in range(3)] + [(9, "s9", 0, DAY, "user", "an unrelated turn about nothing")]
    turns = spark.createDataFrame(rows, "id long, session string, seq long, ts timestamp_ntz, role string, text string")
    queries = spark.createDataFrame([(1, "gateway port")], "qid long, text string")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    assert [r.id for r in recall.search_turns(turns, queries, now).collect()] == [2]
    assert {r.id for r in recall.search_turns(turns, queries, now, collapse=False).collect()} == {0, 1, 2}
    assert recall.search_turns(turns, spark.createDataFrame([(1, "is the of")], "qid long, text string"), now).count() == 0


def test_passages_join_with_a_mark(spark):
    rows = spark.createDataFrame([([(0, "a"), (1, "b"), (3, "c")],)], "parts array<struct<ord:int,text:string>>")
    assert rows.select(recall.joined_passages("parts")).first()[0] == "ab … c"


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "the api-1 is up"), (2, "1 api")], "id long, text string")
    queries = spark.createDataFrame([(1, "api-1")], "qid long, text string")
    got = recall.phrase_postings(docs, recall.phrase_keywords(queries), {"text": 1.0}, "id").collect()
    assert [(r.term, r.key, r.tf) for r in got] == [("api 1", 1, 1.0)]


def test_wilson_and_sign_test(spark):
    one = spark.createDataFrame([(8, 10, 7, 1)], "k long, n long, w long, l long")
    low, high = experiments.wilson(F.col("k"), F.col("n"))
    row = one.select(low.alias("a"), high.alias("b"), experiments.sign_test("w", "l").alias("p")).first()
    assert (round(row.a, 4), round(row.b, 4), row.p) == (0.4902, 0.9433, 0.0703125)


def test_stale_only_when_the_old_value_leads(spark):
    rows = [("q1", "stale", "now 8443, was 8080", ["8443"], ["8080"]), ("q2", "stale", "8080 then 8443", ["8443"], ["8080"]), ("q3", "negative", "nothing", ["8443"], [])]
    scores = experiments.eval_scores(spark.createDataFrame(rows, "id string, type string, context string, expect array<string>, reject array<string>"))
    assert {r.id: (r.stale, r.ok) for r in scores.collect()} == {"q1": (False, True), "q2": (True, False), "q3": (False, True)}


def test_retention_keeps_the_newest_and_each_bands_oldest(spark):
    names = spark.createDataFrame([(f"snapshot-202401{d:02d}-000000.db",) for d in range(1, 21)], "name string")
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    kept = {r["name"] for r in reports.retention(reports.snapshot_times(names), now).where("keep").collect()}
    assert kept == {f"snapshot-202401{d:02d}-000000.db" for d in (20, 18, 14, 7)}


def test_generic_and_session_readers(spark, tmp_path):
    long = "a text that is long enough to be kept"
    generic = [{"role": "user", "content": long, "ts": "2024-01-01", "session": "s1"}, {"role": "tool", "content": long}, {"role": "assistant", "content": [{"text": "two parts"}, {"text": "joined into one text"}]}]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "one.jsonl").write_text("\n".join([json.dumps(r) for r in generic] + ["{bad"]))
    got = transcripts.reader("generic")(spark, str(tmp_path / "g")).orderBy("seq").collect()
    assert [(r.session, r.text) for r in got] == [("s1", long), ("one", "two parts joined into one text")]
    block = lambda t: {"type": "text", "text": t}
    session = [
        {"type": "user", "sessionId": "x", "entrypoint": "cli", "timestamp": "t", "message": {"content": long}},
        {"type": "user", "sessionId": "x", "message": {"content": "<system> " + long}},
        {"type": "assistant", "sessionId": "x", "message": {"content": [block(long + " 1"), {"type": "tool_use"}, block("short"), block(long + " 2")]}},
        {"type": "summary", "summary": "none"},
    ]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "two.jsonl").write_text("\n".join(map(json.dumps, session)))
    got = transcripts.read_sessions(spark, str(tmp_path / "s")).orderBy("seq").collect()
    assert [(r.seq, r.text) for r in got] == [(0, long), (1, long + " 1"), (2, long + " 2")]
    with pytest.raises(KeyError):
        transcripts.reader("unknown")


def test_assertion_lines_and_tsv(spark):
    lines = spark.createDataFrame([("a\tb\tc\td",), ("# note",), ("",), ("a\tb",)], "value string")
    assert [(r.subject, r.value, r.error) for r in transcripts.assertion_lines(lines).collect()] == [("a", "c", False), ("a", None, True)]
    rows = spark.createDataFrame([("x\ty", None)], "a string, b string")
    assert sinks.as_tsv(rows, ["a", "b"]).first()[0] == "x y\t"


def test_sync_is_exactly_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda i: json.dumps({"session": "s", "seq": i, "ts": "2024-01-01T00:00:00Z", "role": "user", "text": f"a message that is long enough {i}", "source": "f"})
    (folder / "a.json").write_text("\n".join(map(row, range(3))))
    assert incremental.sync(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "c")) == 3
    (folder / "b.json").write_text("\n".join(map(row, range(2, 5))))
    assert incremental.sync(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "c")) == 5
    assert incremental.sync(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "c")) == 5


def test_regions_and_facts_of_every_document(spark, tmp_path):
    from tidemark.operators import mining
    from tidemark.plans.catalog import QUERIES
    from tidemark.sources import model

    fact = "The deploy gateway%d defaults to cluster-%d in the office."
    rows = [(i, fact % (i, i), "src0") for i in range(40)] + [(40, "Filler words go on here. " * 1000 + fact % (40, 40), "src0")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["trigger_regions"](spark, str(tmp_path)).collect()
    assert {(r.session, f"gateway{r.session} " in r.region) for r in found} == {(str(i), True) for i in range(41)}
    facts = mining.derive(mining.regions(model.document_turns(spark, str(tmp_path))), mining.copula_extractor)
    assert {r.session for r in facts.collect()} == {str(i) for i in range(41)}
