"""Stems against SQLite, the gate, confirmations and retractions, streams, settings, projects, snapshots, commands."""

from __future__ import annotations

import datetime as dt
import json
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark import __main__ as cli
from tidemark import config
from tidemark.api import Memory
from tidemark.functions import text as tx
from tidemark.functions.porter import stem
from tidemark.functions.words import STOPWORDS
from tidemark.operators import experiments as ex
from tidemark.operators import gate, ledger, recall, upkeep
from tidemark.plans.catalog import QUERIES
from tidemark.sources import model, project, sinks, transcripts
from tidemark.streaming import incremental


# -- stems --------------------------------------------------------------------------------------------------------
def index_of(rows: list[tuple]) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", rows)
    return con


def test_stems_are_those_of_sqlite():
    endings = "s es ed ing ational tional izer ization iveness fulness ousli biliti logi bli eed ies sses y ement ion able icate ative ness ful al ence ll e".split()
    roots = "run hop fall rel ad triplic operat sky happ agree plaster bl siz tan fail fil motor conflat troubl gener ration valenc hesit digit conform radic vile analog vietnam feud decis hope callous formal sensit sensib".split()
    words = sorted({a + b for a in roots for b in endings} | set(roots) | {"a", "is", "as", "by", "x" * 70, "über", "naïvely"})
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize=\"porter unicode61 remove_diacritics 0\")")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(words)))
    assert {words[d]: s for s, d in con.execute("SELECT term, doc FROM v")} == {w: stem(w) for w in words}


def test_stemmed_frequencies_and_scores_are_those_of_sqlite(spark, small):
    turns = [(r.id, r.text) for r in model.turns(spark, small).select("id", "text").collect()]
    con = index_of(turns)
    got = {r.term: (r.df, r.cf) for r in QUERIES["doc_freq_stemmed"](spark, small).collect()}
    assert got == {t: (d, n) for t, d, n in con.execute("SELECT term, doc, cnt FROM v")}
    docs = spark.createDataFrame(turns, "key long, text string")
    asked = [(i, " ".join(re.findall(r"[a-z]{4,}", t.lower())[:4]) + " first-choice") for i, t in turns[:6]]
    queries = spark.createDataFrame(asked, "qid long, text string")
    scores = recall.bm25(*recall.asked_postings(docs, {"text": 1.0}, "key", queries, stem=True))
    mine = {(r.qid, r.key): r.score for r in scores.collect()}
    theirs = {}
    for qid, text in asked:
        match = " OR ".join(f'"{w}"' for w in dict.fromkeys(text.split()) if w not in STOPWORDS)
        theirs |= {(qid, i): -s for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    assert mine.keys() == theirs.keys() and all(abs(mine[k] - theirs[k]) < 1e-6 for k in mine)


def test_stemmed_recall_finds_inflected_forms(spark):
    rows = [(1, "s", 0, None, "user", "We tested the running deployments twice yesterday", "f", None), (2, "s", 1, None, "user", "Nothing of the kind was ever mentioned here", "f", None)]
    turns = spark.createDataFrame(rows, "id long, session string, seq int, ts timestamp_ntz, role string, text string, source string, entrypoint string")
    asked = spark.createDataFrame([(0, "test run deployment")], "qid long, text string")
    assert [r.id for r in recall.search_turns(turns, asked, model.now(), stem=True).collect()] == [1]
    assert recall.search_turns(turns, asked, model.now()).count() == 0
    top = QUERIES["recall_turns_stemmed"]
    assert top is not None


def test_compound_keywords_match_as_phrases(spark):
    docs = spark.createDataFrame([(1, "set max_rows low"), (2, "rows max"), (3, "max rows, max rows"), (4, "other words")], "key long, text string")
    asked = spark.createDataFrame([(0, "max_rows")], "qid long, text string")
    assert {r.key for r in recall.bm25(*recall.asked_postings(docs, {"text": 1.0}, "key", asked)).collect()} == {1, 3}


def test_fusion_shows_a_text_once(spark):
    lists = spark.createDataFrame([(0, 0, 1, 10, 1.0, "same"), (0, 0, 2, 11, 0.9, " same "), (0, 1, 1, 12, 1.0, "other"), (0, 1, 2, 10, 0.5, "same")], "qid long, list long, rank int, id long, score double, text string")
    assert [(r["rank"], r.id) for r in recall.fuse_texts(lists, 5).orderBy("rank").collect()] == [(1, 10), (2, 12)]


# -- text ---------------------------------------------------------------------------------------------------------
def test_globs_have_classes_and_home(spark):
    import fnmatch

    paths = ["/home/u/a1/x", "/home/u/b/x", "/home/u/[z]/x", "/a/.b", "/a-b/c^d", "/home/u"]
    for glob in ("/home/u/[ab]*", "/home/u/[!a]*", "*[0-9]*", "*/[[]z]/*", "*[", "/a/.?", "*[]]*", "*c[^]d", "?home?u", "*[a-c]^d"):
        rows = spark.createDataFrame([(p,) for p in paths], "p string").where(F.col("p").rlike(tx.glob_pattern(glob))).collect()
        assert {r.p for r in rows} == {p for p in paths if fnmatch.fnmatchcase(p, glob)}, glob
    assert tx.glob_pattern("~/x", "/home/u") == tx.glob_pattern("/home/u/x")


def test_folder_names_agree(spark):
    paths = ["/a b/é", "/x/😀/y", "q" * 300, "/deep/" * 60 + "😀"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", tx.project_dir_name("p").alias("n")).collect()
    assert {r.p: r.n for r in rows} == {p: project.dir_name(p) for p in paths}
    assert project.dir_name("/x/😀/y") == "-x----y" and len(project.dir_name("q" * 300)) > 200


# -- gate and ledger ----------------------------------------------------------------------------------------------
AT = dt.datetime(2023, 1, 1)


def beliefs(spark, rows):
    return spark.createDataFrame([(*r, AT, AT, None, "committed") for r in rows], "id long, subject string, relation string, value string, reliability double, source string, confirmed boolean, valid_from timestamp_ntz, recorded_at timestamp_ntz, valid_to timestamp_ntz, status string")


def test_gate_order(spark):
    s = "memory:session/s/turn/1"
    rows = beliefs(spark, [
        (1, "api", "version", "0.4.0", 0.5, s, False), (2, "api", "version", "0.4.0", 0.9, s, False), (3, "api", "uses api 0.2.9", "x", 0.5, s, False), (4, "repo", "test count", "91 tests", 0.5, s, False),
        (5, "repo", "test count", "91 tests", 0.5, s, True), (6, "x", "y", "please run it", 0.9, "me", True), (7, "api", "colour", "blue", 0.5, s, False), (8, "repo", "test count", "91 tests", 0.5, None, False),
    ])
    declared = spark.createDataFrame([("api", "0.5.0", "a"), ("other", "0.0.0", "b")], "package string, version string, path string")
    got = {r.id: r.reason for r in gate.explain(rows, declared, model.now()).collect()}
    assert got == {1: "contradicted", 2: None, 3: "older_version", 4: "measurement", 5: None, 6: "instruction", 7: None, 8: None}
    young = gate.explain(rows, declared, F.lit("2023-01-03 00:00:00").cast("timestamp_ntz"))
    assert {r.id: r.reason for r in young.collect()}[4] is None
    shown, uses = gate.prefetch(rows.select(F.lit(0).alias("qid"), F.col("id").cast("int").alias("rank"), "id"), rows, model.now(), 2)
    assert [r["rank"] for r in shown.collect()] == [1, 2] and uses.count() == 2
    assert gate.project_beliefs(rows, ["API", "my-repo"]).count() == 4


def test_memory_with_retractions_confirmations_and_reviews(spark, small, tmp_path):
    memory = Memory(spark, model.turns(spark, small), model.assertions(spark, small))
    some = [r.id for r in memory.beliefs().limit(2).collect()]
    after, plan = memory.retract({some[0]: "wrong", -1: "no such"})
    assert [(r.id, r.status) for r in plan.collect()] == [(some[0], "retracted")]
    assert {r.id for r in memory.beliefs().collect()} - {r.id for r in after.beliefs().collect()} == {some[0]}
    row = memory.beliefs().where(F.col("id") == some[0]).first()
    assert [r.retracted_reason for r in after.history(row.subject, row.relation).where(F.col("id") == some[0]).collect()] == ["wrong"]
    sure = Memory(spark, memory.turns, memory.assertions, confirmations=spark.createDataFrame([(some[1],)], "belief_id long"))
    assert [r.id for r in sure.timeline().where("confirmed").collect()] == [some[1]]
    source = memory.turns.first().source
    assert memory.unindex([source]).turns.where(F.col("source") == source).count() == 0
    both = memory.recall_all(["user click"], 3)
    assert {r.kind for r in both.collect()} <= {"belief", "turn"} and both.columns[0] == "kind"
    review = memory.review_items().first()
    inbox = tmp_path / "inbox.json"
    inbox.write_text("\n".join([json.dumps({"review_id": review.review_id, "decision": "approve"}), "{broken", json.dumps({"review_id": -5, "decision": "approve"}), json.dumps({"review_id": 1, "decision": "maybe"})]))
    assert [(r.candidate, r.status) for r in memory.decide_inbox(str(inbox)).collect()] == [(review.candidate, "committed")]
    assert memory.project_digest("/home/u/p3", ["12"]).count() == 1
    assert memory.stats().first().reviews_open > 0


def test_gated_windows_are_the_fold(spark):
    import random

    rng = random.Random(3)
    rows = [(i, f"s{rng.randrange(40)}", "r", rng.choice("abc"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(60)), rng.randrange(4) / 4, "x") for i in range(3000)]
    want, state = {}, {}
    for seq, subject, _, value, at, rel, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        now = state.get(subject)
        if now is None:
            want[seq], state[subject] = ("created", None), [value, rel, seq]
        elif value == now[0]:
            want[seq] = ("reinforced", now[2])
            now[1] = max(now[1], rel)
        elif rel < now[1]:
            want[seq] = ("pending_review", now[2])
        else:
            want[seq], state[subject] = ("superseded", now[2]), [value, rel, seq]
    frame = spark.createDataFrame(rows, "seq long, subject string, relation string, value string, valid_from timestamp_ntz, reliability double, source string")
    assert {r.seq: (r.outcome, r.incumbent) for r in ledger.gated_outcomes(frame).collect()} == want


def test_decisions_per_model(spark):
    cells = [("new", m, f"s{i}", 0, True, m == "x" or i > 8, True) for m in "xy" for i in range(10)] + [("old", m, f"s{i}", 0, True, i > 7, True) for m in "xy" for i in range(10)]
    frame = spark.createDataFrame(cells, "variant string, model string, scenario string, repeat int, expect boolean, recall_called boolean, valid boolean")
    decided = ex.decide(frame, "new", "old")
    assert {r.model: (r.wins, r.losses, r.passes) for r in decided.collect()} == {"x": (8, 0, True), "y": (0, 1, False)}
    assert ex.ships(decided).first().ship is False and ex.ships(decided.where("model = 'x'")).first().ship is True
    assert ex.ships(decided.limit(0)).first().ship is False


def test_notices_come_once(spark):
    stale, shown = spark.range(3), spark.createDataFrame([("stale",)], "key string")
    assert upkeep.notice(stale, shown, "stale").count() == 0 and upkeep.notice(stale, shown, "other").first().beliefs == 3
    assert upkeep.notice(stale.limit(0), shown, "other").count() == 0


# -- streams ------------------------------------------------------------------------------------------------------
def test_late_evidence_by_time_then_seq(spark, tmp_path):
    schema = "seq long, subject string, relation string, value string, valid_from timestamp, reliability double, source string"
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, rows):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(["seq", "subject", "relation", "value", "valid_from", "reliability", "source"], (s, "a", "b", v, at, 0.5, "x")))) for s, v, at in rows))

    stream = incremental.late_timeline(spark.readStream.schema(schema).json(str(folder)))
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen.setdefault(r.key, []).append((r.norm, r.valid_to is None))

    def run():
        seen.clear()
        query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return seen.get("a|b")

    put("1.json", [(2, "z", "2024-01-02T00:00:00Z"), (1, "y", "2024-01-02T00:00:00Z")])
    assert run() == [("y", False), ("z", True)]
    put("2.json", [(3, "w", "2024-01-01T00:00:00Z"), (2, "other", "2024-01-09T00:00:00Z")])
    assert run() == [("w", False), ("y", False), ("z", True)]


def test_deriving_follows_a_watermark(spark, tmp_path):
    control, facts = str(tmp_path / "control"), str(tmp_path / "facts")
    turns = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    make = lambda new: new.select("id")
    assert incremental.derive_new(spark, turns, control, facts, make, at) == 5
    assert incremental.derive_new(spark, turns, control, facts, make, at) == 5
    more = turns.unionByName(spark.createDataFrame([(9,)], "id long"))
    later = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    assert incremental.derive_new(spark, more, control, facts, make, later, stale_after=2.0) == 5
    assert incremental.derive_new(spark, more, control, facts, make, later) == 9
    assert sorted(r.id for r in spark.read.parquet(facts).collect()) == [1, 2, 3, 4, 5, 9]


def test_a_shrunk_source_starts_anew(spark):
    stored = spark.createDataFrame([("a", 0, "old"), ("a", 1, "old"), ("b", 0, "old")], "source string, seq int, text string")
    incoming = spark.createDataFrame([("a", 0, "new"), ("b", 0, "new"), ("b", 1, "new")], stored.schema)
    got = incremental.restart_shrunk(stored, incoming, spark.createDataFrame([("a",)], "source string"))
    assert sorted(map(tuple, got.collect())) == [("a", 0, "new"), ("b", 0, "old"), ("b", 1, "new")]


# -- driver side --------------------------------------------------------------------------------------------------
def test_settings():
    assert [config.number(x) for x in (True, "1.5", "nan", None, 3)] == [None, 1.5, None, None, 3.0]
    assert [config.threshold(x) for x in (0.2, 1.1, "1")] == [0.2, None, 1.0] and config.quantity("6", 1, 20) == 6 and config.quantity(6.5, 1, 20) is None
    assert config.mode(" Filter ") == "filter" and config.mode("on") is None and config.name("  ") is None
    assert config.ascii_only(environment={"LANG": "C"}) and not config.ascii_only(environment={"LANG": "en_US.UTF-8"}) and not config.ascii_only(environment={})
    assert config.ascii_only(environment={"TIDEMARK_ASCII": "1", "LANG": "en_US.UTF-8"})
    assert config.settings({"a": {"k": "7", "on": 1}}, {"a.k": 5, "a.on": False, "b": "x"}) == ({"a.k": 7.0, "a.on": False, "b": "x"}, ["a.on"])


def test_checkouts_of_a_repository(tmp_path):
    main, linked = tmp_path / "main", tmp_path / "linked"
    (main / ".git" / "worktrees" / "linked").mkdir(parents=True)
    (main / "src").mkdir()
    linked.mkdir()
    (main / ".git" / "worktrees" / "linked" / "gitdir").write_text(f"{linked}/.git\n")
    (main / ".git" / "worktrees" / "linked" / "commondir").write_text("../..\n")
    (linked / ".git").write_text(f"gitdir: {main}/.git/worktrees/linked\n")
    assert project.checkouts(main / "src") == (main, [main / "src", main, linked], ["main"])
    assert project.checkouts(linked) == (linked, [linked, main], ["linked", "main"])
    outside = tmp_path / "plain"
    outside.mkdir()
    assert project.checkouts(outside) == (outside, [outside], ["plain"])
    dirs = project.transcript_dirs([main], ["/r1", "/r2"], "/own/s.jsonl")
    assert dirs[0] == "/own" and f"/r2/{project.dir_name(str(main))}" in dirs


def test_snapshots_and_restore(spark, tmp_path):
    folder, table = str(tmp_path / "backups"), str(tmp_path / "turns")
    spark.range(3).write.parquet(table)
    sinks.write_snapshot(spark.range(7), folder, "20240101-000000")
    sinks.write_snapshot(spark.range(9), folder, "20240102-000000")
    assert [s.rpartition("-")[0][-8:] for s in sinks.snapshots(spark, folder)] == ["20240102", "20240101"]
    assert sinks.restore(spark, folder, table, "x").count() == 9 and spark.read.parquet(f"{table}-before-x").count() == 3
    with pytest.raises(FileNotFoundError):
        sinks.restore(spark, str(tmp_path / "none"), table, "y")
    assert sinks.backup_warning(500, 399) and sinks.backup_warning(500, 400) is None


def test_logs_and_boilerplate(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"ts": "2024-01-31T00:00:00", "n": 1}\n{"ts": "2023-01-01T00:00:00", "n": 2}\nnot json\n')
    rows = transcripts.read_log(spark, str(tmp_path / "log.json"), "ts timestamp_ntz, n int", model.now(), 10)
    assert [r.n for r in rows.collect()] == [1]
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps({"type": "user", "sessionId": "s", "timestamp": "t", "message": {"content": c}}) for c in ("Base directory for this skill: somewhere", "<tag> of the harness, long enough", "a person wrote this sentence")))
    assert [r.text for r in transcripts.read_sessions(spark, str(tmp_path)).collect()] == ["a person wrote this sentence"]


def test_every_command_runs(spark, small, tmp_path, capsys):
    (tmp_path / "facts.tsv").write_text("api\tport\t8080\tme\n# note\n")
    (tmp_path / "inbox.json").write_text('{"review_id": 1, "decision": "approve"}\n')
    given = {
        "recall": ["est"], "recall-all": ["user click"], "facts": ["user"], "read": ["conv-1"], "history": ["User 7", "click"], "retract": ["1"], "review-sync": [str(tmp_path / "inbox.json")], "approve": ["1"], "reject": ["1"],
        "assert": [str(tmp_path / "facts.tsv")], "context": ["what about user 7"], "digest": ["/home/u/p3"], "exclude": ["*p1*"], "prune": ["que"], "redact": ["User 12"], "unindex": ["/home/u/p2/conv-2.jsonl"], "passages": ["conv-1"],
        "snapshot": [str(tmp_path / "b"), "20240101-000000"], "snapshots": [str(tmp_path / "b")],
    }
    for name in cli.COMMANDS:
        try:
            cli.main([small, "--json", name, *given.get(name, [])])
        except ValueError as e:
            assert name == "redact" and "rows hold it" in str(e)
    assert "snapshot-20240101" in capsys.readouterr().out


def test_calls_by_name(spark, small):
    memory = Memory(spark, model.turns(spark, small), model.assertions(spark, small))
    assert [r.value for r in memory.call("remember", subject="api", relation="port", value="8080").collect()] == ["8080"]
    assert memory.call("read", session="conv-1").count() > 0 and memory.call("beliefs", subject="user 7").count() > 0
    with pytest.raises(KeyError):
        memory.call("forget")


def test_outbox_and_labels(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "b\tc"), (2, None, "d")], "review_id long, x string, longer string")
    sinks.write_outbox(rows, str(tmp_path / "out"))
    assert sorted(r.review_id for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2]
    assert {r.review_id: r.block for r in sinks.as_labelled(rows, ["x", "longer"], "review_id").collect()} == {1: "     x : a\nlonger : b c", 2: "longer : d"}


def test_grids_and_warnings(spark):
    grid = upkeep.grid_cells(["a", "b"], spark.createDataFrame([(1,), (2,)], "scenario long"), ["m"], 2, 5)
    assert grid.count() == 8 and grid.select("place").distinct().count() == 8
    got = spark.createDataFrame([(4, 2), (4, 1), (0, 0)], "t long, h long").select(upkeep.hiding_verdict(F.col("t"), F.col("h")).alias("w")).collect()
    assert [r.w is not None for r in got] == [True, False, False]


@pytest.mark.parametrize("stem", [False, True])
def test_a_stored_index_finds_the_same(spark, small, tmp_path, stem):
    turns, asked = model.turns(spark, small), QUERIES and model.table(spark, small, "benchmark").select(F.col("item_id").alias("qid"), "text")
    recall.store_index(recall.build_index(turns, stem), str(tmp_path), 8)
    index = recall.stored_index(spark, str(tmp_path), asked, 8, stem)
    show = lambda rows: sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in rows.collect())
    assert show(recall.search_turns(turns, asked, model.now(), index=index)) == show(recall.search_turns(turns, asked, model.now(), stem=stem))


def test_computed_versions(tmp_path):
    from tidemark.sources import manifests

    for name, tool, file in (("one-two", "", "src/one_two/__init__.py"), ("three", '[tool.hatch.version]\npath = "v.py"\n', "v.py"), ("four", '[tool.setuptools.dynamic]\nversion = {attr = "inner.about.__version__"}\n', "inner/about.py"), ("none", "", "other.py")):
        folder = tmp_path / name
        (folder / file).parent.mkdir(parents=True, exist_ok=True)
        (folder / "pyproject.toml").write_text(f'[project]\nname = "{name}"\ndynamic = ["version"]\n{tool}')
        (folder / file).write_text('x = 1\n__version__ = "1.2.3"\n')
    assert sorted(p for p, v, _ in manifests.declared(str(tmp_path)) if v == "1.2.3") == ["four", "one-two", "three"]
