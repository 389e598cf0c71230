"""The query catalogue: each operator over the driver's tables, with its DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import durability, text as tx
from ..operators import experiments as ex
from ..operators import ledger as lg
from ..operators import mining as mn
from ..operators import recall as rc
from ..operators import repair as rp
from ..operators import reports as rs
from ..sources import model, transcripts
from . import oracle as o
from . import rules_sql as rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


QUERY = "q AS (SELECT item_id AS qid, text FROM benchmark)"


# -- text ---------------------------------------------------------------------------------------------------------
@query(f"WITH {o.TURN}, t AS (SELECT id, {o.query_terms('text')} AS terms FROM turn) SELECT id, array_to_string(terms, ' ') AS terms, len(terms)::INTEGER AS n FROM t")
def fts_terms(spark, sf_dir):
    t = model.turns(spark, sf_dir).select("id", tx.query_terms("text").alias("terms"))
    return t.select("id", F.array_join("terms", " ").alias("terms"), F.size("terms").alias("n"))


_subject_terms = o.distinct_in_order(f"list_filter(list_transform(regexp_extract_all(p_name, {o.quoted(o.W.TOKEN)}), lambda w: trim(lower(w), './-')), lambda w: w <> '' AND NOT list_contains({o.words(o.W.STOPWORDS)}, w))")


@query(f"SELECT p_partkey, array_to_string({_subject_terms}, ' ') AS terms FROM part")
def subject_terms(spark, sf_dir):
    return model.table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.subject_terms("p_name"), " ").alias("terms"))


@query(r"""SELECT c_custkey, regexp_replace(regexp_replace(lower('  "' || c_name || '". ' || c_mktsegment || '!'), '^[\s"''`.,;:!?()\[\]{}]+|[\s"''`.,;:!?()\[\]{}]+$', '', 'g'), '\s+', ' ', 'g') AS key FROM customer""")
def normalize_key(spark, sf_dir):
    c = model.table(spark, sf_dir, "customer")
    return c.select("c_custkey", tx.normalize(F.concat(F.lit('  "'), "c_name", F.lit('". '), "c_mktsegment", F.lit("!"))).alias("key"))


@query(f"WITH RECURSIVE d AS (SELECT doc_id AS id, text FROM documents), {o.passage_table('d')} SELECT turn_id, ord, start::INTEGER AS start, stop::INTEGER AS stop, md5(text) AS digest FROM part")
def passages(spark, sf_dir):
    parts = rc.passage_table(model.document_turns(spark, sf_dir))
    return parts.select("turn_id", "ord", "start", "stop", F.md5("text").alias("digest"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id AS id, text FROM documents), {o.passage_table('d')}
    SELECT count(*) AS passages, count(DISTINCT turn_id) AS turns, sum(stop - start)::BIGINT AS chars, max(stop - start)::INTEGER AS longest, sum(greatest(1, round_even((stop - start) / 4, 0)))::BIGINT AS tokens FROM part""")
def passage_stats(spark, sf_dir):
    parts = rc.passage_table(model.document_turns(spark, sf_dir)).withColumn("n", F.col("stop") - F.col("start"))
    return parts.agg(
        F.count(F.lit(1)).alias("passages"), F.countDistinct("turn_id").alias("turns"), F.sum("n").alias("chars"), F.max("n").alias("longest"), F.sum(tx.est_tokens("text")).alias("tokens")
    )


@query(f"WITH {o.TURN} SELECT term, count(*) AS df, sum(n)::BIGINT AS cf FROM (SELECT id, term, count(*) AS n FROM (SELECT id, unnest({o.analyze('text')}) AS term FROM turn) GROUP BY id, term) GROUP BY term")
def doc_freq(spark, sf_dir):
    terms = model.turns(spark, sf_dir).select("id", F.explode(tx.analyze("text")).alias("term"))
    return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


@query(f"WITH {o.TURN} SELECT id, CASE WHEN length(text) <= 90 THEN text ELSE left(text, 60) || ' … ' || right(text, 30) END AS clipped FROM turn")
def clipped_text(spark, sf_dir):
    return model.turns(spark, sf_dir).select("id", tx.clip_middle("text", 90).alias("clipped"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '/[^/]*$', ''), '/[^/]+/subagents$', '') AS dir, regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') AS name FROM pages")
def project_names(spark, sf_dir):
    return model.table(spark, sf_dir, "pages").select("page_id", tx.project_dir("url").alias("dir"), tx.project_dir_name("url").alias("name"))


@query(f"WITH {o.ASSERTION} SELECT seq, regexp_extract(source, '^memory:session/(.+)/turn/(\\d+)$', 1) AS session, regexp_extract(source, '^memory:session/(.+)/turn/(\\d+)$', 2)::BIGINT AS turn FROM assertion")
def pointers(spark, sf_dir):
    return model.assertions(spark, sf_dir).select("seq", tx.pointer_session("source").alias("session"), tx.pointer_turn("source").alias("turn"))


# -- recall -------------------------------------------------------------------------------------------------------
_PARTS = f"WITH RECURSIVE {o.TURN}, {QUERY}, {o.passage_table('turn')}, keyed AS (SELECT *, turn_id * 1000 + ord AS key FROM part)"


@query(f"{_PARTS}, {o.bm25('keyed', {'text': 1.0}, 'key', 'q')} SELECT qid, key, round(score, 6) AS score FROM scored")
def bm25_passages(spark, sf_dir):
    parts = rc.passage_table(model.turns(spark, sf_dir)).withColumn("key", F.col("turn_id") * 1000 + F.col("ord"))
    return rc.bm25(*rc.asked_postings(parts, {"text": 1.0}, "key", _queries(spark, sf_dir))).select("qid", "key", F.round("score", 6).alias("score"))


_TURN_HITS = f"""{_PARTS}, {o.bm25('keyed', {'text': 1.0}, 'key', 'q')},
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS place FROM scored) WHERE place <= 200),
    weighed AS (SELECT pool.qid, k.turn_id, k.ord, k.text, t.text AS whole, pool.score * {o.activation('t.ts', '0', 0.5)} AS score FROM pool JOIN keyed k USING (key) JOIN turn t ON t.id = k.turn_id),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, turn_id ORDER BY round(score, 9) DESC, ord) AS nth FROM weighed) WHERE nth <= 3),
    turns AS (SELECT qid, turn_id, max(score) AS score, any_value(whole) AS whole FROM best GROUP BY qid, turn_id),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, trim(whole) ORDER BY round(score, 9) DESC, turn_id) AS copy FROM turns) WHERE copy = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, turn_id) AS rank FROM once)"""


@query(f"{_TURN_HITS} SELECT qid, rank::INTEGER AS rank, turn_id AS id, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def recall_turns(spark, sf_dir):
    hits = rc.search_turns(model.turns(spark, sf_dir), _queries(spark, sf_dir), model.now())
    return hits.select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query(f"""{_TURN_HITS}, lists AS (SELECT qid // 4 AS fid, qid AS list, rank, turn_id AS id, score, whole FROM ranked WHERE rank <= 20),
    sums AS (SELECT fid, id, sum(1 / (60 + rank)) AS fused, min(rank) AS best, min(trim(whole)) AS said FROM lists GROUP BY fid, id),
    told AS (SELECT *, row_number() OVER (PARTITION BY fid, said ORDER BY round(fused, 12) DESC, best, id) AS copy FROM sums),
    placed AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY round(fused, 12) DESC, best, id) AS rank FROM told WHERE copy = 1)
    SELECT fid AS qid, rank::INTEGER AS rank, id, round(fused, 9) AS fused FROM placed WHERE rank <= 5""")
def recall_multi_rrf(spark, sf_dir):
    hits = rc.search_turns(model.turns(spark, sf_dir), _queries(spark, sf_dir), model.now(), k=20)
    lists = hits.select(F.floor(F.col("qid") / 4).alias("qid"), F.col("qid").alias("list"), "rank", "id", "score", "text")
    return rc.fuse_texts(lists, 5).select("qid", "rank", "id", F.round("fused", 9).alias("fused"))


_BELIEF_QUERY = "q AS (SELECT user_id AS qid, 'user ' || user_id || ' ' || string_agg(DISTINCT event_type, ' ') AS text FROM events GROUP BY user_id)"
_BELIEF_HITS = f"""WITH {o.BELIEF}, {_BELIEF_QUERY}, {o.bm25('belief', {'subject': 3.0, 'relation': 1.0, 'value': 1.0}, 'id', 'q')},
    pool AS (SELECT * FROM (SELECT scored.*, b.subject, b.reliability, b.use_count, b.recorded_at, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, scored.key) AS place
        FROM scored JOIN belief b ON b.id = scored.key WHERE valid_to IS NULL AND status = 'committed') WHERE place <= 100),
    weighed AS (SELECT qid, key, subject, score * reliability * {o.activation('recorded_at', 'use_count', 0.1)} AS score FROM pool),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM weighed)"""


def _belief_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.table(spark, sf_dir, "events")
    kinds = F.array_join(F.collect_set("event_type"), " ")
    return e.groupBy("user_id").agg(F.concat(F.lit("user "), F.first("user_id").cast("string"), F.lit(" "), kinds).alias("text")).withColumnRenamed("user_id", "qid")


@query(f"{_BELIEF_HITS} SELECT qid, rank::INTEGER AS rank, key AS id, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def recall_beliefs(spark, sf_dir):
    hits = rc.search_beliefs(lg.timeline(model.assertions(spark, sf_dir)), _belief_queries(spark, sf_dir), model.now())
    return hits.select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {o.TURN}, {QUERY}, subj AS (SELECT conv_id, min(split_part(trim(text), ' ', 3) || ' ' || split_part(trim(text), ' ', 5)) AS subject FROM conversations GROUP BY conv_id),
    part AS (SELECT id, list_distinct({o.analyze('text')}) AS terms FROM turn), total AS (SELECT count(*) AS n FROM part),
    share AS (SELECT term, count(*) / n AS share FROM (SELECT unnest(terms) AS term FROM part), total GROUP BY term, n),
    st AS (SELECT conv_id, {o.distinct_in_order(f"list_filter(list_transform(regexp_extract_all(subject, {o.quoted(o.W.TOKEN)}), lambda w: trim(lower(w), './-')), lambda w: w <> '' AND NOT list_contains({o.words(o.W.STOPWORDS)}, w))")} AS s FROM subj),
    qt AS (SELECT qid, list_filter(list_transform(regexp_extract_all(text, {o.quoted(o.W.TOKEN)}), lambda w: trim(lower(w), './-')), lambda w: w <> '' AND NOT list_contains({o.words(o.W.STOPWORDS)}, w)) AS t FROM q),
    met AS (SELECT qid, conv_id, list_filter(s, lambda x: list_contains(t, x)) AS common FROM st, qt WHERE list_has_any(s, t))
    SELECT qid, conv_id AS key, len(common)::INTEGER AS shared, (len(common) >= 2 OR (len(common) = 1 AND (coalesce(share, 0) <= 0.1 OR n < 1000))) AS kept
    FROM met LEFT JOIN share ON share.term = CASE WHEN len(common) = 1 THEN common[1] END, total""")
def subject_rule(spark, sf_dir):
    c = model.table(spark, sf_dir, "conversations")
    word = lambda i: F.coalesce(F.get(F.split(F.trim("text"), " "), F.lit(i - 1)), F.when(F.col("text").isNotNull(), ""))  # noqa: E731  (short turns have empty words)
    subjects = c.groupBy(F.col("conv_id").alias("key")).agg(F.min(F.concat(word(3), F.lit(" "), word(5))).alias("subject"))
    asked = _queries(spark, sf_dir)
    parts = model.turns(spark, sf_dir).select(F.col("id").alias("turn_id"), F.lit(0).alias("ord"), "text")
    return rc.subject_rule(rc.subject_pairs(subjects, asked), asked, rc.passage_shares(parts))


@query(f"WITH {o.TURN} SELECT min(id) AS id, count(*) AS copies FROM turn GROUP BY trim(text)")
def collapse_identical(spark, sf_dir):
    return rc.identical_turns(model.turns(spark, sf_dir))


@query(f"WITH {o.TURN} SELECT t.session, a.seq AS anchor, t.id, t.seq, t.role FROM turn a JOIN turn t USING (session) WHERE a.seq % 3 = 0 AND t.seq BETWEEN a.seq - 1 AND a.seq + 1")
def read_window(spark, sf_dir):
    t = model.turns(spark, sf_dir)
    return rc.read_window(t, t.where("seq % 3 = 0"), 1)


@query(f"WITH {o.TURN} SELECT session, id FROM (SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY role <> 'user', ts NULLS LAST, id) AS nth FROM turn) WHERE nth = 1")
def first_prompt(spark, sf_dir):
    return rc.first_prompts(model.turns(spark, sf_dir))


# -- ledger -------------------------------------------------------------------------------------------------------
_BELIEF_COLUMNS = "id, key, value, valid_from, valid_to, superseded_by, reliability, use_count"


@query(f"WITH {o.BELIEF} SELECT {_BELIEF_COLUMNS} FROM belief")
def ledger_auto_timeline(spark, sf_dir):
    return lg.timeline(model.assertions(spark, sf_dir)).select(*_BELIEF_COLUMNS.split(", "))


@query(f"WITH {o.BELIEF} SELECT id, subject, relation, value FROM belief WHERE valid_to IS NULL")
def ledger_current(spark, sf_dir):
    return lg.current(lg.timeline(model.assertions(spark, sf_dir))).select("id", "subject", "relation", "value")


@query(f"WITH {o.BELIEF} SELECT id, key, value FROM belief WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR TIMESTAMP '2024-01-15' < valid_to)")
def ledger_as_of(spark, sf_dir):
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return lg.as_of(lg.timeline(model.assertions(spark, sf_dir)), at).select("id", "key", "value")


@query("""WITH a AS (SELECT o_orderkey AS seq, o_custkey AS key, o_orderstatus AS v, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
    SELECT seq, CASE WHEN before IS NULL THEN 'created' WHEN before = v THEN 'reinforced' ELSE 'superseded' END AS outcome FROM a""")
def ledger_auto_outcomes(spark, sf_dir):
    return lg.auto_outcomes(model.order_assertions(spark, sf_dir))


_GATE = f"""WITH RECURSIVE {o.ASSERTION}, placed AS (SELECT seq, key, value, reliability, row_number() OVER (PARTITION BY key ORDER BY valid_from, seq) AS n FROM assertion),
    fold AS (SELECT key, n, seq, value AS inc, reliability AS rel, seq AS id, 'created' AS outcome, NULL::BIGINT AS incumbent FROM placed WHERE n = 1
    UNION ALL SELECT p.key, p.n, p.seq,
        CASE WHEN p.value = f.inc OR p.reliability < f.rel THEN f.inc ELSE p.value END,
        CASE WHEN p.value = f.inc THEN greatest(f.rel, p.reliability) WHEN p.reliability < f.rel THEN f.rel ELSE p.reliability END,
        CASE WHEN p.value = f.inc OR p.reliability < f.rel THEN f.id ELSE p.seq END,
        CASE WHEN p.value = f.inc THEN 'reinforced' WHEN p.reliability < f.rel THEN 'pending_review' ELSE 'superseded' END, f.id
        FROM fold f JOIN placed p ON p.key = f.key AND p.n = f.n + 1)"""


@query(f"{_GATE} SELECT seq, outcome, incumbent FROM fold")
def ledger_gate_outcomes(spark, sf_dir):
    return lg.gated_outcomes(model.assertions(spark, sf_dir))


@query(f"""WITH {o.ASSERTION}, a AS (SELECT seq, value, first_value(value) OVER w AS v0, first_value(seq) OVER w AS id0 FROM assertion WINDOW w AS (PARTITION BY key ORDER BY valid_from, seq))
    SELECT seq, CASE WHEN seq = id0 THEN 'created' WHEN value = v0 THEN 'reinforced' ELSE 'pending_review' END AS outcome, CASE WHEN seq <> id0 THEN id0 END AS incumbent FROM a""")
def ledger_await(spark, sf_dir):
    return lg.awaited_outcomes(model.assertions(spark, sf_dir))


@query(rules.ARRIVAL)
def ledger_arrival(spark, sf_dir):
    return lg.arrival_outcomes(model.assertions(spark, sf_dir))


@query(f"{_GATE} SELECT seq AS review_id, key, seq AS candidate, incumbent FROM fold WHERE outcome = 'pending_review'")
def open_reviews(spark, sf_dir):
    return lg.reviews(model.assertions(spark, sf_dir))


@query(f"""{_GATE}, r AS (SELECT fold.seq AS candidate, incumbent, CASE WHEN fold.seq % 3 = 0 THEN 'approve' ELSE 'reject' END AS decision, valid_from FROM fold JOIN assertion USING (seq) WHERE outcome = 'pending_review' AND fold.seq % 2 = 1)
    SELECT candidate, CASE decision WHEN 'approve' THEN 'committed' ELSE 'rejected' END AS status, CASE WHEN decision <> 'approve' THEN valid_from END AS valid_to, incumbent,
    min(CASE WHEN decision = 'approve' THEN valid_from END) OVER (PARTITION BY incumbent) AS incumbent_valid_to FROM r""")
def approve_reject(spark, sf_dir):
    a = model.assertions(spark, sf_dir)
    opened = lg.reviews(a)
    decided = opened.where("review_id % 2 = 1").select("review_id", F.when(F.col("review_id") % 3 == 0, "approve").otherwise("reject").alias("decision"))
    return lg.decide(opened, a, decided)


@query(f"""WITH {o.BELIEF}, late AS (SELECT seq AS probe, key, valid_from + INTERVAL 1 HOUR AS at FROM assertion)
    SELECT probe, (SELECT arg_max(id, (valid_from, id)) FROM belief b WHERE b.key = late.key AND b.valid_from <= late.at) AS before_id,
    (SELECT arg_min(id, (valid_from, id)) FROM belief b WHERE b.key = late.key AND b.valid_from > late.at) AS after_id FROM late""")
def late_evidence_neighbours(spark, sf_dir):
    a = lg.keyed(model.assertions(spark, sf_dir))
    late = a.select(F.col("seq").alias("probe"), "key", (F.col("valid_from") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("at"))
    return lg.neighbours(lg.timeline(model.assertions(spark, sf_dir)), late)


@query(f"WITH {o.BELIEF} SELECT key, string_agg(value || '@' || strftime(valid_from, '%Y-%m-%d'), ' > ' ORDER BY valid_from, id) AS history, count(*) AS n FROM belief GROUP BY key")
def belief_history(spark, sf_dir):
    b = lg.timeline(model.assertions(spark, sf_dir))
    step = F.concat("value", F.lit("@"), F.date_format("valid_from", "yyyy-MM-dd"))
    each = F.array_sort(F.collect_list(F.struct("valid_from", "id", step.alias("step"))))
    return b.groupBy("key").agg(F.array_join(F.transform(each, lambda x: x["step"]), " > ").alias("history"), F.count(F.lit(1)).alias("n"))


# -- repair, prune, redact ----------------------------------------------------------------------------------------
_CITED = f"{o.BELIEF}, cited AS (SELECT *, regexp_extract(source, '^memory:session/(.+)/turn/(\\d+)$', 1) AS cs, regexp_extract(source, '^memory:session/(.+)/turn/(\\d+)$', 2)::BIGINT AS ct FROM belief)"


@query(f"WITH {o.TURN}, {_CITED} SELECT id, key, cs AS cited_session FROM cited WHERE cs NOT IN (SELECT session FROM turn)")
def orphaned_beliefs(spark, sf_dir):
    return rp.orphaned(lg.timeline(model.assertions(spark, sf_dir)), model.turns(spark, sf_dir))


@query(f"WITH {o.TURN}, {_CITED} SELECT id, cs AS cited_session, ct AS cited_turn FROM cited WHERE cs IN (SELECT session FROM turn) AND ct NOT IN (SELECT id FROM turn)")
def stale_turn_citations(spark, sf_dir):
    return rp.stale_citations(lg.timeline(model.assertions(spark, sf_dir)), model.turns(spark, sf_dir))


@query(f"""WITH {o.BELIEF}, m AS (SELECT *, id % 5 = 0 AS gone FROM belief),
    nxt AS (SELECT *, lead(gone) OVER w AS next_gone FROM m WINDOW w AS (PARTITION BY key ORDER BY valid_from, id))
    SELECT 'retract' AS action, id, valid_from AS valid_to, superseded_by FROM m WHERE gone
    UNION ALL SELECT CASE WHEN s.id IS NULL THEN 'reopen' ELSE 'relink' END, n.id, s.valid_from, s.id FROM nxt n
    LEFT JOIN LATERAL (SELECT id, valid_from FROM m WHERE m.key = n.key AND NOT m.gone AND (m.valid_from, m.id) > (n.valid_from, n.id) ORDER BY m.valid_from, m.id LIMIT 1) s ON true WHERE NOT n.gone AND n.next_gone""")
def retraction_repairs(spark, sf_dir):
    b = lg.timeline(model.assertions(spark, sf_dir))
    return rp.repairs(b, b.where("id % 5 = 0").select("id"))


@query("""SELECT count(*) FILTER (WHERE starts_with(text, 'The')) AS starts, count(*) FILTER (WHERE contains(text, 'The')) AS contains, count(*) FILTER (WHERE contains(lower(text), 'the')) AS any_case FROM (SELECT text FROM documents)""")
def turn_matches(spark, sf_dir):
    return rp.turn_matches(model.document_turns(spark, sf_dir).select("text"), "The")


@query(f"WITH {o.TURN} SELECT session, count(*) FILTER (WHERE contains(text, 'que')) AS doomed, count(*) AS turns, count(*) FILTER (WHERE contains(text, 'que')) = count(*) AS emptied FROM turn GROUP BY session HAVING count(*) FILTER (WHERE contains(text, 'que')) > 0")
def prune_plan(spark, sf_dir):
    return rp.prune_plan(model.turns(spark, sf_dir), F.col("text").contains("que"))


@query(f"WITH {o.BELIEF} SELECT id, subject, relation, replace(value, 'k3', '[redacted]') AS value, key, 'retracted' AS status FROM belief WHERE contains(value, 'k3')")
def redact_plan(spark, sf_dir):
    b = lg.timeline(model.assertions(spark, sf_dir))
    return rp.redact_plan(b, "k3", least_chars=2, most_rows=2_000_000_000).select("id", "subject", "relation", "value", F.lower(F.concat("subject", F.lit("|"), "relation")).alias("key"), "status")


# -- rules --------------------------------------------------------------------------------------------------------
_NOUNS = ["test count", "open issue", "current version", "status", "row count", "retry limit", "null rate", "cards", "current branch", "ci status"]
_VALUES = ["91 tests", "4,200 rows", "0.4.0", "open and green", "83%", "5", "3 of 5", "must pass", "fixed in 0.5.0", "feature/x"]
_SUBJECTS = ["api", "export-schedule", "max_rows", "main branch", "PR", "build job", "repo", "rate limit", "t_12ab7591", "test suite"]


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as triples over fixed phrases that exercise every rule."""
    p = model.table(spark, sf_dir, "part")
    pick = lambda items, n: F.element_at(F.array(*[F.lit(x) for x in items]), (F.floor(F.col("p_partkey") / n) % 10 + 1).cast("int"))
    return p.select("p_partkey", pick(_SUBJECTS, 100).alias("subject"), pick(_NOUNS, 10).alias("relation"), pick(_VALUES, 1).alias("value"))


_TRIPLES = f"""tri AS (SELECT p_partkey, ({o.words(_SUBJECTS)})[(p_partkey // 100) % 10 + 1] AS subject, ({o.words(_NOUNS)})[(p_partkey // 10) % 10 + 1] AS relation, ({o.words(_VALUES)})[p_partkey % 10 + 1] AS value FROM part)"""


def _toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _has(x: str, items: list[str]) -> str:
    return f"list_has_any({x}, {o.words(items)})"


_VETO = f"""coalesce((list_filter({_toks('relation')}, lambda t: list_contains({o.words(o.W.QUALIFIERS)}, t)))[1],
    (list_filter(list_transform(list_transform(regexp_extract_all(lower(subject), '[a-z0-9]+(?:[_-][a-z0-9]+)*'), lambda w: regexp_split_to_array(w, '[_-]')), lambda p: CASE
        WHEN len(p) = 1 THEN CASE WHEN list_contains({o.words(o.W.QUALIFIERS)}, p[1]) THEN p[1] END
        WHEN list_contains({o.words(o.W.QUALIFIERS)}, p[-1]) THEN p[-1]
        WHEN {_has('p', o.W.BOUNDS)} THEN (list_filter(p, lambda y: list_contains({o.words(o.W.BOUNDS)}, y)))[1]
        WHEN {_has('p', o.W.QUALIFIERS)} AND {_has('p', o.W.MEASURED_NOUNS)} THEN (list_filter(p, lambda y: list_contains({o.words(o.W.QUALIFIERS)}, y)))[1] END), lambda x: x IS NOT NULL))[1])"""


@query(f"WITH {_TRIPLES} SELECT p_partkey, {_VETO} AS veto FROM tri")
def veto_words(spark, sf_dir):
    return _triples(spark, sf_dir).select("p_partkey", durability.veto().alias("veto"))


_JOINED = f"array_to_string({_toks('relation')}, ' ')"
_COUNTED = f"({_has(_toks('relation'), o.W.COUNT_WORDS)} OR contains({_JOINED}, 'number of'))"
_BOTH = f"list_concat({_toks('relation')}, {_toks('value')})"
_MEASURE = f"""CASE WHEN NOT regexp_matches(trim(value), {o.quoted(o.W.QUANTITY)}) THEN false WHEN {_VETO} IS NOT NULL THEN false WHEN regexp_matches(relation, {o.quoted(o.W.REQUIREMENT)}) THEN false
    WHEN list_contains({o.words(o.W.EXACT_MEASURES)}, {_JOINED}) THEN true
    WHEN {_COUNTED} AND {_has(_BOTH, o.W.ACCUMULATING)} THEN true
    WHEN {_COUNTED} AND ({_has(_toks('relation'), o.W.WORK_ITEMS)} OR list_contains({o.words(o.W.WORK_ITEMS)}, ({_toks('subject')})[-1])) THEN true
    WHEN list_contains({o.words(o.W.WORK_ITEM_PLURAL)}, ({_toks('relation')})[-1]) AND regexp_full_match(trim(value), '[0-9]+') THEN true
    WHEN regexp_matches(value, {o.quoted(o.W.MAGNITUDE)}) AND {_has(_BOTH, o.W.ACCUMULATING_PLURAL)} THEN true
    WHEN regexp_matches(value, {o.quoted(o.W.N_OF_M)}) THEN {_has(_toks('relation'), o.W.ACCUMULATING + o.W.COMPLETION_WORDS)} OR coalesce(list_contains({o.words(o.W.ACCUMULATING)}, ({_toks('subject')})[-1]), false)
    ELSE false END"""


@query(f"WITH {_TRIPLES} SELECT p_partkey, {_MEASURE} AS fired FROM tri")
def measurement_class(spark, sf_dir):
    return _triples(spark, sf_dir).select("p_partkey", durability.measurement().alias("fired"))


_TEXT = "(subject || ' ' || relation)"
_MOVING = f"""regexp_matches(trim(value), {o.quoted(o.W.VERSION)}) AND {_has(_toks(_TEXT), o.W.VERSION_NOUNS)} AND ({_has(_toks(_TEXT), o.W.MOVING)} OR regexp_matches({_TEXT}, {o.quoted(o.W.ON_MAIN)})) AND {_VETO} IS NULL"""


@query(f"WITH {_TRIPLES} SELECT p_partkey, {_MOVING} AS fired FROM tri")
def moving_version(spark, sf_dir):
    return _triples(spark, sf_dir).select("p_partkey", durability.moving_version().alias("fired"))


@query(f"WITH {_TRIPLES} SELECT p_partkey, {rules.status()} AS fired FROM tri")
def status_class(spark, sf_dir):
    return _triples(spark, sf_dir).select("p_partkey", durability.status().alias("fired"))


@query(f"WITH {_TRIPLES} SELECT p_partkey, subject, relation, value, {rules.classify()} AS class FROM tri")
def volatility_classify(spark, sf_dir):
    return _triples(spark, sf_dir).select("p_partkey", "subject", "relation", "value", durability.classify().alias("class"))


@query(f"SELECT doc_id, {rules.instruction('source', 'lang', 'text')} AS why FROM documents")
def instruction_shape(spark, sf_dir):
    d = model.table(spark, sf_dir, "documents")
    return d.select("doc_id", durability.instruction_shape("source", "lang", "text").alias("why"))


_GATED = f"""gated AS (SELECT *, 0.5::DOUBLE AS reliability, 'memory:session/s/turn/1' AS source, p_partkey % 11 = 0 AS confirmed,
    CASE WHEN p_partkey % 7 = 0 THEN {o.NOW} ELSE TIMESTAMP '2023-01-01' END AS valid_from FROM tri)"""


@query(f"WITH {_TRIPLES}, {_GATED} SELECT p_partkey, {rules.verdict()} AS reason FROM gated")
def gate_verdict(spark, sf_dir):
    t = _triples(spark, sf_dir).withColumns({"reliability": F.lit(0.5), "source": F.lit("memory:session/s/turn/1"), "confirmed": F.col("p_partkey") % 11 == 0})
    t = t.withColumn("valid_from", F.when(F.col("p_partkey") % 7 == 0, model.now()).otherwise(F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")))
    return t.select("p_partkey", durability.verdict(model.now()).alias("reason"))


_DERIVED = f"derived AS (SELECT *, (p_partkey % 4) / 4.0 AS reliability, 'memory:session/s/turn/1' AS source, p_partkey % 11 = 0 AS confirmed, TIMESTAMP '2023-01-01' AS valid_from FROM tri)"


@query(f"""WITH {_TRIPLES}, {_DERIVED}, j AS (SELECT split_part({rules.verdict()}, ':', 1) AS reason FROM derived)
    SELECT v.reason, count(j.reason) AS beliefs FROM (VALUES ('measurement'), ('moving_version'), ('status'), ('instruction')) v(reason) LEFT JOIN j ON j.reason = v.reason GROUP BY v.reason""")
def left_out_by_reason(spark, sf_dir):
    k = F.col("p_partkey")
    b = _triples(spark, sf_dir).withColumns(
        {"reliability": (k % 4) / 4.0, "source": F.lit("memory:session/s/turn/1"), "confirmed": k % 11 == 0, "valid_from": F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"), "valid_to": F.lit(None), "status": F.lit("committed")}
    )
    return rs.left_out(b, model.now())


@query(f"""{_BELIEF_HITS} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank)::INTEGER AS rank, '- ' || b.subject || ' ' || b.relation || ': ' || b.value || ' (recorded ' || strftime(b.recorded_at, '%Y-%m-%d') || ')' AS line
    FROM ranked JOIN belief b ON b.id = ranked.key WHERE rank <= 10 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 6""")
def context_top_k(spark, sf_dir):
    b = lg.timeline(model.assertions(spark, sf_dir)).withColumn("confirmed", F.lit(False))
    return rs.context(b, rc.search_beliefs(b, _belief_queries(spark, sf_dir), model.now()).select("qid", "rank", "id"), model.now())


# -- reports ------------------------------------------------------------------------------------------------------
@query(f"""{_GATE}, {o.TURN}, {o.BELIEF.removeprefix(o.ASSERTION + ', ')}, {o.passage_table('turn')} SELECT (SELECT count(*) FROM fold WHERE outcome = 'pending_review') AS reviews_open, (SELECT count(*) FROM turn) AS turns, (SELECT count(DISTINCT session) FROM turn) AS sessions, (SELECT count(*) FROM part) AS passages,
    (SELECT count(*) FROM belief) AS beliefs, (SELECT count(*) FROM belief WHERE valid_to IS NULL) AS current_beliefs""")
def store_stats(spark, sf_dir):
    t, a = model.turns(spark, sf_dir), model.assertions(spark, sf_dir)
    return rs.store_stats(t, rc.passage_table(t), lg.timeline(a), lg.reviews(a))


@query(f"""WITH {o.TURN}, {_CITED}, own AS (SELECT entrypoint, count(DISTINCT session) AS sessions, count(*) AS turns FROM turn GROUP BY entrypoint),
    b AS (SELECT entrypoint, count(*) AS beliefs FROM cited JOIN turn ON cs = session AND ct = turn.id GROUP BY entrypoint)
    SELECT own.entrypoint, sessions, turns, coalesce(beliefs, 0) AS beliefs FROM own LEFT JOIN b ON own.entrypoint IS NOT DISTINCT FROM b.entrypoint""")
def provenance_entrypoint(spark, sf_dir):
    return rs.provenance(model.turns(spark, sf_dir), rp.cited(lg.timeline(model.assertions(spark, sf_dir))).select("cited_session", "cited_turn"))


@query(f"WITH {o.TURN} SELECT regexp_replace(source, '/[^/]*$', '') AS dir, count(DISTINCT session) AS sessions, round(count(DISTINCT session) / (SELECT count(DISTINCT session) FROM turn), 4) AS share FROM turn GROUP BY 1 ORDER BY sessions DESC, dir LIMIT 5")
def top_projects(spark, sf_dir):
    return rs.top_projects(model.turns(spark, sf_dir))


@query(f"""WITH u AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'click') AS uses, max(ts) FILTER (WHERE event_type = 'click') AS last_used FROM events GROUP BY user_id)
    SELECT count(*) FILTER (WHERE last_used >= {o.NOW} - INTERVAL 7 DAY) AS used_7d, count(*) FILTER (WHERE last_used >= {o.NOW} - INTERVAL 30 DAY) AS used_30d, max(last_used) AS last_used, round(avg((uses > 0)::INT), 4) AS ever_used FROM u""")
def utilization(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    click = F.col("event_type") == "click"
    uses = e.groupBy(F.col("user_id").alias("id")).agg(F.count_if(click).alias("uses"), F.max(F.when(click, F.col("ts").cast("timestamp_ntz"))).alias("last_used"))
    return rs.utilization(uses, model.now())


@query(f"WITH {o.TURN} SELECT session, min(id) AS first_new FROM turn WHERE id > 50000 GROUP BY session ORDER BY first_new LIMIT 60")
def sessions_with_new_turns(spark, sf_dir):
    return rs.sessions_with_news(model.turns(spark, sf_dir), 50_000)


@query(f"WITH {o.TURN} SELECT count(*) FILTER (WHERE id > 50000) AS pending, max(id) AS last_id FROM turn")
def derive_pending(spark, sf_dir):
    return rs.pending(model.turns(spark, sf_dir), 50_000)


@query(f"WITH {o.TURN} SELECT id, source, seq FROM turn WHERE seq % 3 <> 0")
def incremental_antijoin(spark, sf_dir):
    t = model.turns(spark, sf_dir)
    return rs.missing_rows(t.where("seq % 3 = 0"), t).select("id", "source", "seq")


@query(f"WITH {o.TURN} SELECT source, count(*) AS turns FROM turn GROUP BY source")
def sync_tree_counts(spark, sf_dir):
    return model.turns(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("turns"))


@query(f"""WITH {o.TURN}, own AS (SELECT * FROM turn WHERE starts_with(source, '/home/u/p3/')), f AS (SELECT session, id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY role <> 'user', ts NULLS LAST, id) AS nth FROM own) WHERE nth = 1)
    SELECT session, max(ts) AS last_ts, any_value(f.id) AS first_id FROM own JOIN f USING (session) GROUP BY session ORDER BY last_ts DESC, session LIMIT 10""")
def digest_sessions(spark, sf_dir):
    return rs.digest_sessions(model.turns(spark, sf_dir), "/home/u/p3")


@query(f"WITH {o.TURN} SELECT session, id, used::BIGINT AS used FROM (SELECT session, id, sum(length(text) + 1) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS used FROM turn) WHERE used <= 600")
def budgeted_list(spark, sf_dir):
    return rs.budgeted(model.turns(spark, sf_dir), "session", "text", ["seq"], 600).select("session", "id", "used")


@query(f"""WITH s AS (SELECT page_id, {o.NOW} - to_hours(page_id * 7) AS taken FROM pages), b AS (SELECT *, CASE WHEN d <= 1 THEN 0 WHEN d <= 3 THEN 1 WHEN d <= 7 THEN 2 WHEN d <= 14 THEN 3 END AS band FROM (SELECT *, (epoch_us({o.NOW}) - epoch_us(taken)) / 86400000000 AS d FROM s))
    SELECT 'snapshot-' || strftime(taken, '%Y%m%d-%H%M%S') || '.db' AS name, (row_number() OVER (ORDER BY taken DESC) = 1 OR (band IS NOT NULL AND row_number() OVER (PARTITION BY band ORDER BY taken) = 1)) AS keep FROM b""")
def backup_retention(spark, sf_dir):
    p = model.table(spark, sf_dir, "pages")
    taken = model.now() - F.make_dt_interval(F.lit(0), (F.col("page_id") * 7).cast("int"))
    names = p.select(F.concat(F.lit("snapshot-"), F.date_format(taken, "yyyyMMdd-HHmmss"), F.lit(".db")).alias("name"))
    return rs.retention(rs.snapshot_times(names), model.now())


@query(f"SELECT event_id, CASE WHEN ts >= {o.NOW} - INTERVAL 10 DAY THEN event_type END AS prompt FROM events WHERE ts >= {o.NOW} - INTERVAL 20 DAY")
def relevance_trim(spark, sf_dir):
    log = model.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("prompt"))
    return rs.trim_log(log, model.now(), 10, 20).select("event_id", "prompt")


@query(f"""WITH {o.TURN}, s AS (SELECT DISTINCT source FROM turn) SELECT '*/p1/*' AS pattern, count(*) FILTER (WHERE source GLOB '*/p1/*') AS sources FROM s UNION ALL SELECT '*conv-1*', count(*) FILTER (WHERE source GLOB '*conv-1*') FROM s
    UNION ALL SELECT NULL, count(*) FILTER (WHERE source GLOB '*/p1/*' OR source GLOB '*conv-1*') FROM s""")
def exclude_preview(spark, sf_dir):
    return rs.exclude_preview(model.turns(spark, sf_dir).select("source").distinct(), ["*/p1/*", "*conv-1*"])


@query(f"WITH {o.TURN} SELECT DISTINCT source FROM turn WHERE source IN ('/home/u/p2/conv-2.jsonl') OR starts_with(source, '/home/u/p4/')")
def no_capture_sources(spark, sf_dir):
    listed = spark.createDataFrame([("/home/u/p2/conv-2.jsonl",), ("/home/u/p4.jsonl",)], "path string")
    return transcripts.listed_sources(model.turns(spark, sf_dir).select("source").distinct(), listed)


@query(f"WITH {o.TURN} SELECT source FROM turn WHERE seq <= 1 GROUP BY source HAVING bool_or(contains(text, 'est') OR contains(text, 'que'))")
def marked_sources(spark, sf_dir):
    heads = model.turns(spark, sf_dir).where("seq <= 1").select("source", F.col("text").alias("head"))
    return transcripts.marked_sources(heads, ["est", "que"])


# -- mining -------------------------------------------------------------------------------------------------------
@query(f"WITH {o.TURN}, s AS (SELECT id, {rules.sentences('text')} AS s FROM turn) SELECT id, (generate_subscripts(s, 1) - 1)::INTEGER AS at, unnest(s) AS sentence FROM s")
def sentence_split(spark, sf_dir):
    t = model.turns(spark, sf_dir)
    return t.select("id", F.posexplode(mn.sentences("text")).alias("at", "sentence"))


_DOC_TURN = "docturn AS (SELECT doc_id AS id, doc_id::VARCHAR AS session, text FROM documents)"


@query(f"WITH {_DOC_TURN}, {rules.regions('docturn')} SELECT session, nth::INTEGER AS nth, region FROM region")
def trigger_regions(spark, sf_dir):
    docs = model.document_turns(spark, sf_dir)
    return mn.regions(docs)


@query(f"""WITH {o.TURN}, w AS (SELECT id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '') AS have,
    list_filter(list_filter(regexp_split_to_array(regexp_replace(lower(split_part(text, '.', 1)), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> ''), lambda w: NOT list_contains({o.words(o.W.CONTENT_STOP)}, w)) AS want FROM turn)
    SELECT id, len(want) > 0 AND list_has_all(have, want) AS grounded FROM w""")
def grounded(spark, sf_dir):
    t = model.turns(spark, sf_dir).select("id", "text", F.substring_index("text", ".", 1).alias("value"))
    return t.select("id", mn.grounded("value", "text").alias("grounded"))


@query(f"""WITH {_TRIPLES}, cand AS (SELECT *, concat_ws(' ', subject, relation, value) AS region, concat_ws(' ', subject, relation) AS anchor, p_partkey % 13 <> 0 AS keep FROM tri),
    {rules.admission('cand')} SELECT reason, count(*) AS n FROM judged GROUP BY reason""")
def validate_reasons(spark, sf_dir):
    t = _triples(spark, sf_dir).withColumns({"region": F.concat_ws(" ", "subject", "relation", "value"), "anchor": F.concat_ws(" ", "subject", "relation"), "keep": F.col("p_partkey") % 13 != 0})
    return mn.admission(t).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_PART_TURN = """partturn AS (SELECT p_partkey AS id, p_brand AS session, 'Notes of the week, part ' || p_partkey || '. The ' || replace(p_name, ' ', '-') || ' tier is now ' || p_type
    || '. See vs. No. 7 for prices. Our ' || lower(p_brand) || ' shelf defaults to row-' || p_size || '. Ask Dr. Vega.' AS text FROM part)"""


@query(f"WITH {_PART_TURN}, {rules.derived('partturn')}")
def derive_facts(spark, sf_dir):
    """Facts from one note a part, a session a brand, so that regions, reasons, copies and caps all have work."""
    p = model.table(spark, sf_dir, "part")
    text = F.concat(
        F.lit("Notes of the week, part "), F.col("p_partkey").cast("string"), F.lit(". The "), F.translate("p_name", " ", "-"), F.lit(" tier is now "), "p_type",
        F.lit(". See vs. No. 7 for prices. Our "), F.lower("p_brand"), F.lit(" shelf defaults to row-"), F.col("p_size").cast("string"), F.lit(". Ask Dr. Vega."),
    )
    return mn.derive(mn.regions(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("session"), text.alias("text"))), mn.copula_extractor)


# -- experiments --------------------------------------------------------------------------------------------------
@query(f"""WITH {o.LOG} SELECT prompt_id, belief_id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY -p, rank) AS place FROM log WHERE p >= 0.4) WHERE place <= 6""")
def relevance_choose(spark, sf_dir):
    return ex.choose(model.relevance_log(spark, sf_dir), 0.4, 6, 20)


@query(f"""WITH {o.CELL} SELECT variant, count(*) FILTER (WHERE expect = 'recall') AS positives, count(*) FILTER (WHERE expect <> 'recall') AS negatives, count(*) FILTER (WHERE expect = 'recall' AND recall_called) AS tp,
    count(*) FILTER (WHERE expect <> 'recall' AND recall_called) AS fp, round(tp / positives, 6) AS tpr, round(fp / negatives, 6) AS fpr, round((tp / positives + 1 - fp / negatives) / 2, 6) AS balanced,
    round(avg(n_phrasings) FILTER (WHERE expect = 'recall' AND recall_called), 6) AS phrasings, round(avg(first_is_recall::INT), 6) AS first_rate FROM cell WHERE valid GROUP BY variant""")
def election_rates(spark, sf_dir):
    rates = ex.election_rates(model.cells(spark, sf_dir))
    return rates.select("variant", "positives", "negatives", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "balanced", "phrasings", "first_rate")])


@query(f"""WITH {o.CELL} SELECT class, count(*) FILTER (WHERE recall_called AND variant = 'view') AS view, count(*) FILTER (WHERE recall_called AND variant = 'click') AS click, count(*) FILTER (WHERE recall_called AND variant = 'signup') AS signup FROM cell WHERE valid AND variant IN ('view', 'click', 'signup') GROUP BY class""")
def election_pivot(spark, sf_dir):
    kinds = ["view", "click", "signup"]
    rows = ex.election_pivot(model.cells(spark, sf_dir).where(F.col("variant").isin(kinds)), kinds)
    return rows.select("class", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


@query(f"""WITH {o.CELL}, r AS (SELECT variant, scenario, repeat, (expect = 'recall') = recall_called AS ok FROM cell WHERE valid)
    SELECT a.variant, count(*) AS pairs, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS wins, count(*) FILTER (WHERE b.ok AND NOT a.ok) AS losses FROM r a JOIN r b USING (scenario, repeat) WHERE b.variant = 'view' AND a.variant <> 'view' GROUP BY a.variant""")
def paired_wins(spark, sf_dir):
    return ex.paired_test(model.cells(spark, sf_dir), "view").drop("p")


@query("""WITH RECURSIVE g AS (SELECT c_custkey % 12 AS wins, c_nationkey % 12 AS losses, min(c_custkey) AS k FROM customer GROUP BY 1, 2),
    f AS (SELECT k, wins, losses, 0 AS i, 1.0::DOUBLE AS c, pow(0.5, wins + losses) AS s FROM g UNION ALL SELECT k, wins, losses, i + 1, c * (wins + losses - i) / (i + 1), s + c * (wins + losses - i) / (i + 1) * pow(0.5, wins + losses) FROM f WHERE i < least(wins, losses))
    SELECT wins, losses, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * max(s)) END + 1e-12, 9) AS p FROM f GROUP BY wins, losses""")
def paired_sign_test(spark, sf_dir):
    c = model.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 12).alias("wins"), (F.col("c_nationkey") % 12).alias("losses"))
    c = c.select("wins", F.col("losses").cast("long").alias("losses")).distinct()
    return c.select("wins", F.col("losses").cast("int").alias("losses"), F.round(ex.sign_test("wins", "losses") + 1e-12, 9).alias("p"))


_Z = ex.Z


@query(f"""WITH c AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, k, n, round(greatest(0.0, (k / n + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n)), 9) AS low,
    round(least(1.0, (k / n + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n)), 9) AS high FROM c""")
def wilson(spark, sf_dir):
    c = model.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = ex.wilson(F.col("k"), F.col("n"))
    return c.select("l_suppkey", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"""WITH {o.LOG} SELECT CASE WHEN error THEN 'unanswered' WHEN p >= 0.5 AND rank <= 6 THEN 'kept' WHEN p < 0.5 AND rank <= 6 THEN 'dropped' WHEN p >= 0.5 THEN 'added' ELSE 'passed' END AS "group",
    count(*) AS n, count(DISTINCT prompt_id) AS prompts, round(avg(p), 6) AS mean_p FROM log GROUP BY 1""")
def health_report(spark, sf_dir):
    return ex.health(model.relevance_log(spark, sf_dir), 0.5)


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(value) FILTER (WHERE pos = least(n - 1, floor(n * 0.5))) AS q50, max(value) FILTER (WHERE pos = least(n - 1, floor(n * 0.95))) AS q95 FROM s GROUP BY event_type""")
def element_quantiles(spark, sf_dir):
    return ex.element_quantiles(model.table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", (0.5, 0.95))


@query("""SELECT user_id % 50 AS pair_id, count(*) FILTER (WHERE value > 50) AS yes, count(*) FILTER (WHERE NOT value > 50) AS no, CASE WHEN yes > no THEN 'relevant' WHEN yes < no THEN 'noise' ELSE 'split' END AS verdict FROM events GROUP BY 1""")
def verdict_majority(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    return ex.majority(e.select((F.col("user_id") % 50).alias("pair_id"), (F.col("value") > 50).alias("relevant")))


@query(f"""WITH {o.LOG}, {o.VERDICT} SELECT user_id AS key, count(*) AS n, round(avg((NOT relevant)::INT), 6) AS noise_share FROM log JOIN verdict USING (belief_id) GROUP BY user_id HAVING count(*) >= 2 AND round(avg((NOT relevant)::INT), 6) >= 0.3
    ORDER BY noise_share DESC, n DESC, key LIMIT 25""")
def offenders(spark, sf_dir):
    log = model.relevance_log(spark, sf_dir).withColumn("key", F.regexp_extract("prompt_id", r"^p(\d+)-", 1).cast("long"))
    return ex.offenders(log, model.verdicts(spark, sf_dir), 2, 0.3)


_GRID = f"""WITH {o.LOG}, {o.VERDICT}, pooled AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, pool ORDER BY p DESC, rank) AS place FROM log, (VALUES (10), (20)) v(pool) WHERE rank <= pool),
    grid AS (SELECT t AS threshold, k, pool, count(*) FILTER (WHERE relevant) AS relevant, count(*) FILTER (WHERE NOT relevant) AS noise, count(*) FILTER (WHERE relevant IS NULL) AS unlabeled
        FROM pooled LEFT JOIN verdict USING (belief_id), (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t), (SELECT unnest([1, 2, 3, 4, 6, 8, 10, 12]) AS k) WHERE p >= t - 1e-9 AND place <= k GROUP BY t, k, pool)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    return ex.replay_grid(model.relevance_log(spark, sf_dir), model.verdicts(spark, sf_dir), thresholds, [1, 2, 3, 4, 6, 8, 10, 12], [10, 20])


@query(f"{_GRID} SELECT * FROM grid")
def replay_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@query(f"{_GRID} SELECT * FROM grid WHERE relevant >= 0.99 * (SELECT max(relevant) FROM grid) ORDER BY noise, relevant DESC, threshold, k, pool LIMIT 1")
def grid_proposal(spark, sf_dir):
    return ex.propose(_grid(spark, sf_dir))


@query("""WITH c AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'stale' ELSE 'negative' END AS type, text, nullif(strpos(text, 'tion'), 0) AS good, nullif(strpos(text, 'que'), 0) AS bad FROM documents),
    s AS (SELECT *, good IS NOT NULL AS found, bad IS NOT NULL AND (good IS NULL OR bad < good) AS stale FROM c)
    SELECT type, count(*) AS n, round(avg((CASE type WHEN 'negative' THEN NOT found WHEN 'stale' THEN found AND NOT stale ELSE found END)::INT), 6) AS accuracy, round(avg(stale::INT), 6) AS stale_rate, median(length(text)) AS median_chars FROM s GROUP BY type""")
def eval_summary(spark, sf_dir):
    d = model.table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "fact").when(F.col("doc_id") % 3 == 1, "stale").otherwise("negative")
    rows = d.select(F.col("doc_id").alias("id"), kind.alias("type"), F.col("text").alias("context"), F.array(F.lit("tion")).alias("expect"), F.array(F.lit("que")).alias("reject"))
    return ex.eval_summary(ex.eval_scores(rows))


@query("SELECT DISTINCT variant, scenario, repeat FROM (SELECT event_type AS variant, user_id AS scenario FROM events), (VALUES (0), (1), (2)) v(repeat) WHERE (scenario + repeat) % 4 <> 0")
def resume_grid(spark, sf_dir):
    e = model.table(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), F.col("user_id").alias("scenario")).distinct()
    every = e.withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    done = every.where((F.col("scenario") + F.col("repeat")) % 4 == 0)
    return every.join(done, ["variant", "scenario", "repeat"], "left_anti")


# -- upkeep -------------------------------------------------------------------------------------------------------
from ..operators import upkeep as up  # noqa: E402
from ..sources import sinks  # noqa: E402


@query("SELECT event_type AS kind, user_id AS id, count(*) AS uses, max(ts) AS last_used FROM events GROUP BY event_type, user_id")
def usage_counts(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    return up.usage(e.select(F.col("event_type").alias("kind"), F.col("user_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts")))


@query("SELECT belief_id, confirmed_at, source FROM (SELECT user_id AS belief_id, ts AS confirmed_at, event_type AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS nth FROM events WHERE value > 50) WHERE nth = 1")
def first_confirmations(spark, sf_dir):
    e = model.table(spark, sf_dir, "events").where("value > 50")
    return up.confirmations(e.select(F.col("user_id").alias("belief_id"), F.col("ts").cast("timestamp_ntz").alias("confirmed_at"), F.col("event_type").alias("source")))


@query(f"WITH {o.TURN} SELECT id FROM turn WHERE id % 4 <> 0")
def passage_backfill(spark, sf_dir):
    t = model.turns(spark, sf_dir)
    return up.missing_passages(t, rc.passage_table(t.where("id % 4 = 0"))).select("id")


@query("""WITH n AS (SELECT p_partkey AS id, p_brand AS package, (p_size // 10) || '.' || (p_size % 10) AS version FROM part), d AS (SELECT DISTINCT p_brand AS package, '2.5' AS declared FROM part)
    SELECT id, package, version, declared FROM n JOIN d USING (package) WHERE [split_part(version, '.', 1)::INT, split_part(version, '.', 2)::INT] < [2, 5]""")
def older_versions(spark, sf_dir):
    p = model.table(spark, sf_dir, "part")
    named = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("package"), F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string")).alias("version"))
    return up.older_versions(named, p.select(F.col("p_brand").alias("package"), F.lit("2.5").alias("version")).distinct())


@query(f"WITH {o.BELIEF} SELECT id, value FROM belief WHERE contains(lower(subject), 'user 1') OR contains(lower(relation), 'user 1') OR contains(lower(value), 'user 1')")
def beliefs_holding(spark, sf_dir):
    return up.holding(lg.timeline(model.assertions(spark, sf_dir)), "USER 1", fold=True).select("id", "value")


@query("""SELECT 'documents.text' AS place, count(*) FILTER (WHERE contains(text, 'token')) AS rows FROM documents UNION ALL SELECT 'documents.source', count(*) FILTER (WHERE contains(source, 'token')) FROM documents
    UNION ALL SELECT 'pages.html', count(*) FILTER (WHERE contains(html, 'token')) FROM pages""")
def rows_holding(spark, sf_dir):
    tables = {n: model.table(spark, sf_dir, n) for n in ("documents", "pages")}
    return up.row_counts_holding(tables, {"documents": ["text", "source"], "pages": ["html"]}, "token")


@query(f"WITH {o.TURN}, old AS (SELECT DISTINCT unnest({o.analyze('text')}) AS term FROM turn), new AS (SELECT DISTINCT unnest({o.analyze('text')}) AS term FROM turn WHERE id % 5 <> 0) SELECT term FROM old WHERE term NOT IN (SELECT term FROM new)")
def deleted_terms(spark, sf_dir):
    t = model.turns(spark, sf_dir)
    return up.stale_terms(t.select(F.explode(tx.analyze("text")).alias("term")), t.where("id % 5 <> 0"))


@query(f"{_GATE} SELECT DISTINCT seq AS review_id FROM fold WHERE outcome = 'pending_review' AND (seq % 7 = 0 OR incumbent % 7 = 0)")
def reviews_touching(spark, sf_dir):
    a = model.assertions(spark, sf_dir)
    return up.touching_reviews(lg.reviews(a), a.where("seq % 7 = 0").select(F.col("seq").alias("id")))


_NAMING = "s AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'seen in conv-' || (event_id % 150) || ', noted' WHEN 1 THEN 'x/conv-' || (event_id % 150) || '.jsonl' ELSE event_type END AS source FROM events)"


@query(f"WITH {o.TURN}, {_NAMING} SELECT s.id, t.session FROM s JOIN (SELECT DISTINCT session FROM turn) t ON contains(s.source, t.session)")
def named_sessions(spark, sf_dir):
    e, name = model.table(spark, sf_dir, "events"), (F.col("event_id") % 150).cast("string")
    source = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("seen in conv-"), name, F.lit(", noted"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("x/conv-"), name, F.lit(".jsonl"))).otherwise(F.col("event_type"))
    return up.mentions(e.select(F.col("event_id").alias("id"), source.alias("source")), model.turns(spark, sf_dir))


@query(f"""WITH {o.LOG} SELECT prompt_id, rank, belief_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y%m%d') DESC) AS call, row_number() OVER (PARTITION BY user_id, rank ORDER BY strftime(ts, '%Y%m%d') DESC, belief_id) AS nth FROM log)
    WHERE call = 1 AND nth = 1""")
def latest_calls(spark, sf_dir):
    log = model.relevance_log(spark, sf_dir).withColumnsRenamed({"prompt_id": "id"})
    log = log.withColumns({"prompt_id": F.regexp_extract("id", r"^(p\d+)-", 1), "ts": F.regexp_extract("id", r"-(\d+)$", 1)})
    return up.latest_calls(log).select(F.col("id").alias("prompt_id"), "rank", "belief_id")


@query("""WITH l AS (SELECT doc_id // 2 * 2 AS pair_id, count(*) AS n FROM labels GROUP BY 1), e AS (SELECT DISTINCT doc_id AS pair_id FROM documents)
    SELECT coalesce(l.pair_id, e.pair_id) AS pair_id, CASE WHEN n IS NULL THEN 'missing' WHEN e.pair_id IS NULL THEN 'unexpected' ELSE 'repeated' END AS fault FROM l FULL JOIN e ON l.pair_id = e.pair_id WHERE n IS NULL OR e.pair_id IS NULL OR n > 1""")
def label_faults(spark, sf_dir):
    labels = model.table(spark, sf_dir, "labels").select((F.col("doc_id") - F.col("doc_id") % 2).alias("pair_id"))
    return up.label_faults(model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id")), labels)


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'out_of_copy' WHEN event_id % 7 = 0 THEN 'timeout' WHEN event_id % 5 <> 0 THEN 'rc=' || (event_id % 5) WHEN event_type = 'error' THEN 'is_error' END AS reason FROM events""")
def invalid_reasons(spark, sf_dir):
    i = F.col("event_id")
    e = model.table(spark, sf_dir, "events").select("event_id", (i % 11 == 0).alias("out_of_copy"), (i % 7 == 0).alias("timed_out"), (i % 5).alias("rc"), (F.col("event_type") == "error").alias("is_error"))
    return up.invalid_reasons(e).select("event_id", "reason")


@query("""WITH e AS (SELECT user_id AS run, event_id AS pos, CASE event_type WHEN 'view' THEN 'turn' WHEN 'error' THEN 'text' ELSE 'tool' END AS kind, CASE event_type WHEN 'click' THEN 'recall' ELSE event_type END AS tool FROM events)
    SELECT run, count(*) FILTER (WHERE kind = 'tool' AND tool = 'recall')::INTEGER AS recalls, arg_min(tool, pos) FILTER (WHERE kind = 'tool') AS first_tool, max(pos) FILTER (WHERE kind = 'text')::VARCHAR AS final_text, count(*) FILTER (WHERE kind = 'turn')::INTEGER AS turns FROM e GROUP BY run""")
def folded_runs(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "turn").when(F.col("event_type") == "error", "text").otherwise("tool")
    tool = F.when(F.col("event_type") == "click", "recall").otherwise(F.col("event_type"))
    rows = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), kind.alias("kind"), tool.alias("tool"), F.lit("").alias("query"), F.col("event_id").cast("string").alias("text"))
    return up.fold_events(rows).select("run", "recalls", "first_tool", "final_text", "turns")


@query("SELECT c_custkey, replace(replace(replace('Name=' || c_name || ';' || lower(c_name) || ';x', 'CUSTOMER#', '[withheld]'), 'Customer#', '[withheld]'), 'customer#', '[withheld]') AS masked FROM customer")
def masked_text(spark, sf_dir):
    c = model.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Name="), "c_name", F.lit(";"), F.lower("c_name"), F.lit(";x")).alias("t"))
    return c.select("c_custkey", up.masked("t", ["Customer#"]).alias("masked"))


@query(f"WITH {o.TURN} SELECT DISTINCT source AS path, unnest(['*' || regexp_extract(source, '([^/]+)/?$', 1) || '*', '*-' || regexp_extract(source, '([^/]+)/?$', 1) || '/*']) AS pattern FROM turn")
def pattern_suggestions(spark, sf_dir):
    return up.pattern_suggestions(model.turns(spark, sf_dir).select(F.col("source").alias("path")).distinct())


@query("SELECT page_id || chr(9) || replace(replace(replace(url, chr(9), ' '), chr(10), ' '), chr(13), ' ') || chr(9) || replace(replace(replace(html, chr(9), ' '), chr(10), ' '), chr(13), ' ') AS line FROM pages")
def tsv_lines(spark, sf_dir):
    return sinks.as_tsv(model.table(spark, sf_dir, "pages"), ["page_id", "url", "html"])


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '\p{Cf}', '', 'g'), '[\p{Cc}\p{Zl}\p{Zp}]', ' ', 'g'), '\s+', ' ', 'g')) AS line FROM pages")
def one_line_text(spark, sf_dir):
    return model.table(spark, sf_dir, "pages").select("page_id", tx.one_line("html").alias("line"))


@query(f"WITH {o.TURN} SELECT source, arg_min(entrypoint, seq) FILTER (WHERE seq % 2 = 0 AND entrypoint IS NOT NULL) AS entrypoint FROM turn GROUP BY source")
def entrypoint_backfill(spark, sf_dir):
    t = model.turns(spark, sf_dir)
    known = t.withColumn("entrypoint", F.when(F.col("seq") % 2 == 0, F.col("entrypoint")))
    return transcripts.entrypoints(transcripts.fill_entrypoints(known))


@query("""WITH t AS (SELECT event_id, 'a' || event_id || chr(9) || event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE chr(9) || user_id END AS value FROM events)
    SELECT split_part(value, chr(9), 1) AS subject, split_part(value, chr(9), 2) AS relation, nullif(split_part(value, chr(9), 3), '') AS value, len(string_split(value, chr(9))) < 3 AS error FROM t""")
def batch_assertions(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    tail = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("\t"), F.col("user_id").cast("string")))
    lines = e.select(F.concat(F.lit("a"), F.col("event_id").cast("string"), F.lit("\t"), "event_type", tail).alias("value"))
    return transcripts.assertion_lines(lines).select("subject", "relation", "value", "error")


@query("""SELECT bool_or(contains(text, 'AKIA') AND source <> 'src0') AS found, bool_and(n_chars > 0) AS complete FROM documents""")
def scan_roll_up(spark, sf_dir):
    d = model.table(spark, sf_dir, "documents")
    hits = F.col("text").contains("AKIA").cast("int")
    return up.scan_roll_up(d.select(hits.alias("hits"), F.when(F.col("source") == "src0", "list").alias("excluded_by"), (F.col("n_chars") > 0).alias("readable")))


@query(f"""WITH RECURSIVE {o.CELL}, r AS (SELECT variant, scenario, repeat, (expect = 'recall') = recall_called AS ok, expect, recall_called FROM cell WHERE valid),
    rate AS (SELECT variant, (count(*) FILTER (WHERE expect = 'recall' AND recall_called) / count(*) FILTER (WHERE expect = 'recall') + 1 - count(*) FILTER (WHERE expect <> 'recall' AND recall_called) / count(*) FILTER (WHERE expect <> 'recall')) / 2 AS bal FROM r GROUP BY variant),
    pair AS (SELECT a.variant, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS w, count(*) FILTER (WHERE b.ok AND NOT a.ok) AS l FROM r a JOIN r b USING (scenario, repeat) WHERE b.variant = 'view' AND a.variant <> 'view' GROUP BY a.variant),
    f AS (SELECT variant, w, l, 0 AS i, (w + l) * ln(0.5) AS c, exp((w + l) * ln(0.5)) AS s FROM pair UNION ALL SELECT variant, w, l, i + 1, c + ln((w + l - i) / (i + 1)), s + exp(c + ln((w + l - i) / (i + 1))) FROM f WHERE i < least(w, l)),
    p AS (SELECT variant, least(1.0, 2 * max(s)) AS p FROM f GROUP BY variant)
    SELECT variant, bal > (SELECT bal FROM rate WHERE variant = 'view') AND p < 0.7 AS ship FROM rate JOIN p USING (variant)""")
def election_decision(spark, sf_dir):
    cells = model.cells(spark, sf_dir)
    return ex.decisions(ex.election_rates(cells), ex.paired_test(cells, "view"), "view", alpha=0.7)


# -- capture ------------------------------------------------------------------------------------------------------
from ..operators import capture as cp  # noqa: E402


@query(f"""WITH {o.TURN}, s AS (SELECT source, arg_min(text, seq) AS head, count(*) AS size FROM turn GROUP BY source)
    SELECT coalesce(CASE WHEN source = '/home/u/p2/conv-2.jsonl' THEN 'no capture' WHEN source GLOB '*/p1/*' THEN 'pattern' WHEN contains(head, 'que') THEN 'marker' END, CASE WHEN size % 2 = 0 THEN 'unchanged' ELSE 'copied' END) AS reason, count(*) AS sources FROM s GROUP BY 1""")
def mirror_counts(spark, sf_dir):
    t = model.turns(spark, sf_dir).groupBy("source").agg(F.min_by("text", "seq").alias("head"), F.count(F.lit(1)).alias("size")).withColumn("mtime", F.lit(5))
    copied = t.where("size % 2 = 0").select("source", "mtime", "size")
    return cp.mirror_counts(cp.reasons(t, ["/home/u/p2/conv-2.jsonl"], ["*/p1/*"], ["que"]), copied)


@query("SELECT item_id AS path, len(list_filter(range(1, length(text) + 1), lambda i: text[i:i + 2] = 'ere'))::INTEGER AS hits FROM benchmark")
def occurrence_counts(spark, sf_dir):
    return cp.occurrences(model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("path"), "text"), "ere")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def upsert_latest(spark, sf_dir):
    e = model.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return cp.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query(f"WITH {o.TURN} SELECT DISTINCT session FROM turn WHERE session NOT IN (SELECT session FROM turn WHERE NOT contains(text, 'est'))")
def emptied_sessions(spark, sf_dir):
    t = model.turns(spark, sf_dir)
    return cp.emptied_sessions(t, t.where(~F.col("text").contains("est")))


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT count(*) AS sessions, sum(n)::BIGINT AS excerpts, sum(ceil(n / 12))::BIGINT AS calls FROM n")
def derive_plan(spark, sf_dir):
    return cp.plan_calls(model.table(spark, sf_dir, "documents").select(F.col("source").alias("session")), 12)


_STORE = """st AS (SELECT source, count(*) AS turns, count(DISTINCT session) AS sessions, count(*) FILTER (WHERE seq % 4 <> 3) AS passages, count(*) FILTER (WHERE contains(text, 'que')) AS beliefs, count(*) FILTER (WHERE contains(text, 'que') AND seq > 4) AS current_beliefs FROM turn GROUP BY source)"""


@query(f"""WITH {o.TURN}, {_STORE} SELECT source, 'turns without passages' AS verdict FROM st WHERE passages < turns UNION ALL SELECT source, 'no beliefs: nothing was derived' FROM st WHERE beliefs = 0
    UNION ALL SELECT source, 'no current beliefs' FROM st WHERE beliefs > 0 AND current_beliefs = 0 UNION ALL SELECT source, 'under two turns a session' FROM st WHERE turns / sessions < 2""")
def store_verdicts(spark, sf_dir):
    """Each source as a store of its own."""
    has = F.col("text").contains("que")
    stats = model.turns(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("turns"), F.countDistinct("session").alias("sessions"), F.count_if(F.col("seq") % 4 != 3).alias("passages"), F.count_if(has).alias("beliefs"), F.count_if(has & (F.col("seq") > 4)).alias("current_beliefs")
    )
    return cp.store_verdicts(stats, "source")


@query(f"WITH {_TRIPLES} SELECT p_partkey, {_VETO} AS veto, {_MEASURE} AS is_measurement, {_MOVING} AS is_moving_version, {rules.status()} AS is_status, {rules.instruction()} AS \"order\", {rules.classify()} AS class FROM tri")
def explain_gate(spark, sf_dir):
    return cp.explain(_triples(spark, sf_dir)).select("p_partkey", "veto", "is_measurement", "is_moving_version", "is_status", "order", "class")


@query("""WITH f AS (SELECT p_partkey, p_brand || ' ' || p_type || ': ' || p_name AS fact FROM part) SELECT p_partkey, CASE WHEN length(fact) <= 40 THEN fact ELSE left(fact, 26) || ' … ' || right(fact, 14) END AS fact FROM f""")
def fact_lines(spark, sf_dir):
    p = model.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("subject"), F.col("p_type").alias("relation"), F.col("p_name").alias("value"))
    return cp.facts(p, 40).select("p_partkey", "fact")


@query(f"""WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'nope' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250' ELSE '2024-03-09 00:00:00' END AS text FROM events)
    SELECT event_id, CASE WHEN date_trunc('second', try_cast(text AS TIMESTAMP)) <= {o.NOW} + INTERVAL 1 DAY THEN date_trunc('second', try_cast(text AS TIMESTAMP)) END AS at FROM t""")
def event_times(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, "nope").when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250"))).otherwise("2024-03-09 00:00:00")
    return e.select("event_id", cp.event_time(text, model.now()).alias("at"))


@query(f"""WITH {o.LOG}, a AS (SELECT prompt_id, belief_id, CASE WHEN belief_id % 97 = 0 THEN 1.5 ELSE p END AS p FROM log)
    SELECT prompt_id, belief_id FROM a WHERE prompt_id NOT IN (SELECT prompt_id FROM a WHERE p > 1)""")
def valid_scores(spark, sf_dir):
    log = model.relevance_log(spark, sf_dir).withColumn("p", F.when(F.col("belief_id") % 97 == 0, 1.5).otherwise(F.col("p")))
    return cp.valid_scores(log.select("prompt_id", "belief_id", "p")).select("prompt_id", "belief_id")


@query(f"""WITH {o.LOG}, p AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, pool ORDER BY p DESC, rank) AS place FROM log, (VALUES (5), (12)) v(pool) WHERE rank <= pool) SELECT DISTINCT prompt_id, belief_id FROM p WHERE place <= 4""")
def needed_pairs(spark, sf_dir):
    return cp.needed_pairs(model.relevance_log(spark, sf_dir), 4, [5, 12])


@query("SELECT event_id AS id, 1 AS n, 'a' || event_id AS anchor, true AS keep, event_type AS subject, 'is' AS relation, user_id::VARCHAR AS value FROM events")
def parsed_answers(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    item = F.concat(F.lit('{"n": 1, "anchor": "a'), "event_id", F.lit('", "keep": true, "subject": "'), "event_type", F.lit('", "relation": "is", "value": "'), "user_id", F.lit('"}'))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n["), item, F.lit("]\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit("Here: "), item, F.lit(" and {broken")))
    return cp.parsed_answers(e.select(F.col("event_id").alias("id"), text.alias("text")))


@query("SELECT page_id AS run, '/tmp/' || page_id AS path FROM pages WHERE page_id % 3 = 1")
def paths_out_of_copy(spark, sf_dir):
    p = model.table(spark, sf_dir, "pages")
    own = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("/tmp/"), "page_id")).otherwise(F.concat(F.lit("/work/copy/"), "page_id"))
    return cp.out_of_copy(p.select(F.col("page_id").alias("run"), F.array(own, F.lit("relative/x"), F.lit("/work/copy")).alias("args")), "/work/copy")


from . import catalog_more  # noqa: E402, F401
