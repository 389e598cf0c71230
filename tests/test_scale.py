"""Steps that must not grow faster than their input, held against the plain way of doing the same."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import recall
from tidemark.plans.catalog import QUERIES, SQL


def ranked(rows):
    return sorted((r.qid, r.place, r.key, round(r.score, 9)) for r in rows)


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_best_pool_is_the_top_of_bm25(spark, monkeypatch, common):
    monkeypatch.setattr(recall, "COMMON", common)
    rnd = random.Random(7)
    words = ["user", "click", "view", "error", "blue", "green", "left-hand side", "k1", "k2"]
    docs = spark.createDataFrame([(i, f"User {i % 40} " + " ".join(rnd.choices(words, k=rnd.randint(1, 4)))) for i in range(160)], "key long, text string")
    asked = spark.createDataFrame([(i, f"user {i} " + " ".join(rnd.sample(words, 3))) for i in range(30)] + [(None, "user 7 blue"), (99, "zzz"), (98, None)], "qid long, text string")
    about = docs.where("key % 3 <> 0").select("key", F.length("text").alias("n"))
    given = recall.asked_postings(docs, {"text": 1.0}, "key", asked)
    pools = recall.best_pool(*given, 7, about).select("qid", F.posexplode("pool").alias("place", "x")).select("qid", F.col("place") + 1, "x.key", "x.score", "x.about.n").toDF("qid", "place", "key", "score", "n")
    want = recall.top(recall.bm25(*given, about), 7)
    rows = pools.where("qid IS NOT NULL").collect()
    assert ranked(rows) == ranked(want.where("qid IS NOT NULL").collect()) and len(rows) > 100
    assert {r.key: r.n for r in rows}.items() <= {r.key: r.n for r in about.collect()}.items()
    assert ranked(pools.where("qid IS NULL").fillna(-1, ["qid"]).collect()) == ranked(want.where("qid IS NULL").fillna(-1, ["qid"]).collect())


def test_pairs_of_a_common_term_are_not_listed(spark):
    """2,000 queries and 2,000 documents share a term: 4 million pairs, of which none is scored by itself."""
    docs = spark.range(2000).select(F.col("id").alias("key"), F.concat(F.lit("user "), F.col("id")).alias("text"))
    asked = spark.range(2000).select(F.col("id").alias("qid"), F.concat(F.lit("user "), F.col("id")).alias("text"))
    pools = recall.best_pool(*recall.asked_postings(docs, {"text": 1.0}, "key", asked), 5, docs.select("key"))
    rows = {r.qid: [x.key for x in r.pool] for r in pools.collect()}
    assert rows[77] == [77, 0, 1, 2, 3] and rows[12] == [12, 0, 1, 2, 3] and len(rows) == 2000


def agrees(spark, sf_dir, name):
    from test_catalog import canonical

    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(SQL[name]).df()
    for c in want.columns:
        if want[c].dtype.kind in "if" and got[c].dtype.kind in "if":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["recall_beliefs", "recall_beliefs_multi"])
def test_common_terms_agree_with_sql(spark, name):
    agrees(spark, "/root/testdata/sf0.01", name)


def test_subjects_of_short_turns_agree_with_sql(spark, tmp_path):
    said = ["user visits blue", "", "user", "the left blue green white", None, "one two blue four user six"]
    talk = spark.createDataFrame([(i // 2, i % 2, "user", t) for i, t in enumerate(said + said[::-1])], "conv_id long, turn long, role string, text string")
    talk.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    asked = spark.createDataFrame([(1, "blue user"), (2, "white things")], "item_id long, text string")
    asked.coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("conversations", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["subject_rule"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(SQL["subject_rule"]).fetchall()) and len(got) == 2


def held_list(rows):
    """The fold as its definition says it, by whole lists: (at, norm) of one key."""
    out, held = [], []
    for at, norm in rows:
        now = held[-1] if held else None
        if now is None or (norm != now[1] and not at < now[0]):
            held.append([at, norm])
            out.append("superseded" if now else "created")
        elif norm == now[1]:
            now[0] = min(now[0], at)
            out.append("reinforced")
        else:
            earlier = [h for h in held if h[0] <= at]
            out.append("reinforced" if earlier and earlier[-1][1] == norm else "historical")
            if out[-1] == "historical":
                held.append([at, norm])
                held.sort(key=lambda h: h[0])
    return out


def test_arrivals_of_a_key_cost_their_rows_not_their_square():
    import time

    from tidemark.operators.ledger import Arrivals

    for seed in range(300):
        rnd = random.Random(seed)
        rows = [(rnd.randint(0, 30), rnd.choice("abc")) for _ in range(60)]
        one = Arrivals()
        assert [one.take(*r) for r in rows] == held_list(rows)
    one, began = Arrivals(), time.process_time()
    for i in range(100_000):  # every second row is older than all that is held
        one.take(-i if i % 2 else i, f"v{i % 7}")
    assert time.process_time() - began < 20


def test_arrivals_run_over_batches_and_keys(spark):
    rnd = random.Random(3)
    rows = [(i, f"s{rnd.randint(0, 4)}", "r", rnd.choice("abc"), rnd.randint(0, 50)) for i in range(3000)]
    a = spark.createDataFrame(rows, "seq long, subject string, relation string, value string, at int")
    a = a.withColumn("valid_from", F.timestamp_seconds("at").cast("timestamp_ntz")).repartition(7)
    from tidemark.operators.ledger import arrival_outcomes

    got = {r.seq: r.outcome for r in arrival_outcomes(a).collect()}
    for subject in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == subject]
        assert [got[r[0]] for r in own] == held_list([(r[4], r[3]) for r in own])


def test_names_that_begin_alike_meet_only_their_own_sources(spark):
    from tidemark.operators.upkeep import mentions

    names = [f"conv-{i}" for i in range(1200)] + ["", "x"] + ["conv-é7"]
    told = [(i, f"seen in conv-{i}, noted" if i % 2 else f"conv-{i}") for i in range(0, 1500, 7)] + [(9000, "x"), (9001, ""), (9002, None), (9003, "conv-é7"), (9004, "conv-")]
    for own in (names, [n for n in names if n != "x"], []):
        got = mentions(spark.createDataFrame(told, "id long, source string"), spark.createDataFrame([(n,) for n in own], "session string"))
        assert sorted(map(tuple, got.collect())) == sorted((i, n) for i, t in told if t for n in own if n and n in t)
    many = spark.range(3000).select("id", F.concat(F.lit("seen in conv-"), 1000 + F.col("id") % 1000).alias("source"))
    found = mentions(many, spark.range(1000, 6000).select(F.concat(F.lit("conv-"), "id").alias("session")))
    assert found.count() == 3000
    assert "contains(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()  # no pairs of a source and names that begin alike


def test_recall_all_searches_the_turns(spark, tmp_path):
    """Turns that the questions meet, read from the table: the SQL finds them too."""
    rnd = random.Random(5)
    talk = [(i // 3, i % 3, rnd.choice(["user", "assistant"]), f"user {i % 17} had a {rnd.choice(['click', 'view', 'error'])} and then nothing more") for i in range(120)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    for name in ("conversations", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["recall_all"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(SQL["recall_all"]).fetchall())
    assert {r[3] for r in got if r[0] == "turn"} <= {c * 1000 + t for c, t, *_ in talk} and sum(r[0] == "turn" for r in got) == 75


def test_stems_of_a_batch_hold_each_word_once(spark, monkeypatch):
    from tidemark.functions import porter

    rows = [(0, ["running", "flies", "running"]), (1, None), (2, []), (3, ["flies", None, "x"]), (4, ["caresses"])]
    got = spark.createDataFrame(rows, "id int, t array<string>").coalesce(1).select("id", porter.stemmed(F.col("t")).alias("s")).collect()
    assert {r.id: r.s for r in got} == {i: None if t is None else [None if w is None else porter.stem(w) for w in t] for i, t in rows}
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(porter, "stem", lambda w: seen.append(w) or w)
    tokens = pa.array([["a", "b", "a"]] * 1000 + [None], pa.list_(pa.string()))
    assert porter._udf().func(tokens.slice(5)).to_pylist() == tokens.slice(5).to_pylist() and sorted(seen) == ["a", "b"]


def test_the_gate_tests_a_triple_once(spark):
    from tidemark.functions import durability
    from tidemark.operators.capture import explain

    said = [("api", "test count", "91 tests"), ("repo", "current version", "0.4.0"), ("PR", "status", "open and green"), ("build job", "retry limit", "5"), (None, "status", "x"), ("a", None, None)]
    rows = spark.createDataFrame([(i, *said[i % 6]) for i in range(60)], "id long, subject string, relation string, value string")
    got = explain(rows)
    assert [c for c in got.columns] == ["id", "subject", "relation", "value", "veto", "is_measurement", "is_moving_version", "is_status", "order", "class"]
    want = rows.select("id", durability.veto(), durability.measurement(), durability.moving_version(), durability.status(), durability.instruction_shape(), durability.classify())
    assert sorted(map(str, got.drop("subject", "relation", "value").toLocalIterator())) and sorted(tuple(map(str, r)) for r in got.drop("subject", "relation", "value").collect()) == sorted(tuple(map(str, r)) for r in want.collect())
    assert "Aggregate" in got._jdf.queryExecution().optimizedPlan().toString()
