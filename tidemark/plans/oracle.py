"""DuckDB SQL of the same queries, from shared table expressions. Only for checking results; nothing runs on it."""

from __future__ import annotations

from ..functions import words as W
from ..functions.text import ACCENTED, BREAKS, CHUNK_HIGH, CHUNK_LIMIT, CHUNK_LOW, FOLDED

NOW = "TIMESTAMP '2024-02-01 00:00:00'"

TURN = """turn AS (SELECT conv_id * 1000 + turn AS id, 'conv-' || conv_id AS session, turn AS seq, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts,
    role, left(trim(text), 20000) AS text, '/home/u/p' || (conv_id % 7) || '/conv-' || conv_id || '.jsonl' AS source,
    CASE conv_id % 3 WHEN 0 THEN 'cli' WHEN 1 THEN 'desktop' END AS entrypoint
    FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) >= 20)"""

ASSERTION = """assertion AS (SELECT event_id AS seq, 'User ' || user_id AS subject, event_type AS relation,
    'k' || (json_extract_string(props, '$.k')::INT % 5) AS value, ts AS valid_from,
    floor(least(greatest(value, 0.0), 100.0)) / 100 AS reliability,
    'memory:session/conv-' || (event_id % 400) || '/turn/' || ((event_id % 400) * 1000 + event_id % 9) AS source,
    lower('User ' || user_id) || '|' || event_type AS key FROM events)"""

BELIEF = (
    ASSERTION
    + """, marked AS (SELECT *, CASE WHEN lag(value) OVER w IS DISTINCT FROM value THEN 1 ELSE 0 END AS new FROM assertion WINDOW w AS (PARTITION BY key ORDER BY valid_from, seq)),
    island AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY valid_from, seq ROWS UNBOUNDED PRECEDING) AS nth FROM marked),
    run AS (SELECT key, nth, arg_min(seq, (valid_from, seq)) AS id, arg_min(subject, (valid_from, seq)) AS subject, arg_min(relation, (valid_from, seq)) AS relation,
        arg_min(value, (valid_from, seq)) AS value, min(valid_from) AS valid_from, arg_min(source, (valid_from, seq)) AS source, max(reliability) AS reliability, count(*) - 1 AS use_count
        FROM island GROUP BY key, nth),
    belief AS (SELECT *, lead(valid_from) OVER w AS valid_to, lead(id) OVER w AS superseded_by, 'committed' AS status, valid_from AS recorded_at FROM run WINDOW w AS (PARTITION BY key ORDER BY nth))"""
)

LOG = """log AS (SELECT * FROM (SELECT ts, 'p' || user_id || '-' || strftime(ts, '%Y%m%d') AS prompt_id, event_id AS belief_id,
    row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id) AS rank, value - floor(value) AS p, event_type = 'error' AS error, user_id FROM events) WHERE rank <= 20)"""

CELL = """cell AS (SELECT event_type AS variant, user_id AS scenario, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS repeat,
    CASE WHEN user_id % 2 = 0 THEN 'recall' ELSE 'none' END AS expect, 'class' || (user_id % 4) AS class, value > 40 AS recall_called, value > 80 AS first_is_recall,
    event_id % 4 AS n_phrasings, event_id % 17 <> 0 AS valid FROM events)"""

VERDICT = "verdict AS (SELECT doc_id AS belief_id, quality = 1 AS relevant FROM labels)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def distinct_in_order(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def query_terms(text: str) -> str:
    all_ = f"list_filter(list_transform(regexp_extract_all({text}, {quoted(W.TOKEN)}), lambda w: trim(lower(w), './-')), lambda w: length(w) BETWEEN 2 AND 128 AND NOT list_contains({words(W.STOPWORDS)}, w))"
    return f"({distinct_in_order(all_)})[1:24]"


def analyze(text: str) -> str:
    return f"regexp_extract_all(translate(lower({text}), '{ACCENTED}', '{FOLDED}'), '[\\p{{L}}\\p{{N}}]+')"


def passage_table(turn: str) -> str:
    """part(turn_id, ord, start, stop, text) from (id, text) of a table, by recursion over starts."""
    window = f"substr(text, start + 1 + {CHUNK_LOW}, {CHUNK_HIGH - CHUNK_LOW})"
    found = " ".join(f"WHEN strpos(reverse({window}), {mark_sql(mark)}) > 0 THEN {CHUNK_HIGH} - strpos(reverse({window}), {mark_sql(mark)}) + 1" for mark in BREAKS)
    size = f"CASE WHEN length(text) - start <= {CHUNK_LIMIT} THEN length(text) - start ELSE CASE {found} ELSE {CHUNK_HIGH} END END"
    return f"""span AS (SELECT id, text, 0 AS ord, 0::BIGINT AS start, (SELECT NULL::BIGINT) AS stop FROM {turn} WHERE length(text) > 0
        UNION ALL SELECT id, text, ord + 1, start + ({size}), NULL FROM span WHERE start + ({size}) < length(text)),
    part AS (SELECT id AS turn_id, ord, start, start + ({size}) AS stop, substr(text, start + 1, ({size})::BIGINT) AS text FROM span)"""


def mark_sql(mark: str) -> str:
    back = mark[::-1]
    return " || ".join("chr(10)" if c == "\n" else quoted(c) for c in back)


def bm25(docs: str, columns: dict[str, float], key: str, queries: str) -> str:
    """scored(qid, key, score)."""
    each = " UNION ALL ".join(f"SELECT {key} AS key, {w}::DOUBLE AS w, {analyze(c)} AS tokens FROM {docs}" for c, w in columns.items())
    return f"""col AS ({each}),
    len AS (SELECT key, sum(len(tokens)) AS dl FROM col GROUP BY key),
    single AS (SELECT term, key, sum(w) AS tf FROM (SELECT key, w, unnest(tokens) AS term FROM col) GROUP BY term, key),
    asked AS (SELECT DISTINCT qid, p FROM (SELECT qid, {analyze('k')} AS p FROM (SELECT qid, unnest({query_terms('text')}) AS k FROM {queries})) WHERE len(p) >= 1),
    word AS (SELECT qid, array_to_string(p, ' ') AS term FROM asked),
    phrase AS (SELECT DISTINCT p FROM asked WHERE len(p) > 1),
    phrased AS (SELECT array_to_string(p, ' ') AS term, key, sum(w * len(list_filter(range(1, len(tokens) + 1), lambda i: tokens[i:i + len(p) - 1] = p))) AS tf FROM phrase, col WHERE list_contains(tokens, p[1]) GROUP BY 1, 2),
    post AS (SELECT * FROM single UNION ALL SELECT * FROM phrased WHERE tf > 0),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
    scored AS (SELECT qid, key, sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM word JOIN post USING (term) JOIN freq USING (term) JOIN len USING (key), corpus GROUP BY qid, key)"""


def age(ts: str) -> str:
    return f"greatest(coalesce((epoch_us({NOW}) - epoch_us({ts})) / 86400000000, 365.0), 0.0)"


def activation(ts: str, uses: str, decay: float) -> str:
    return f"pow(1 + {age(ts)}, -{decay}) * (1 + 0.5 * ln(1 + greatest({uses}, 0)))"
