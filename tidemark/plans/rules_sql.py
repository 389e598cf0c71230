"""DuckDB SQL of the durability, order, mining and arrival rules. RE2 has no look-around, so sentences are cut by marks and
a status that is not resolved is told by taking the negated phrases out first, as the Spark expressions do too."""

from __future__ import annotations

from ..functions import durability as D
from ..functions import words as W
from ..operators import mining as M
from . import oracle as o


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def has(x: str, items: list[str]) -> str:
    return f"list_has_any({x}, {o.words(items)})"


def among(x: str, items: list[str]) -> str:
    return f"list_contains({o.words(items)}, coalesce({x}, ''))"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {o.quoted(pattern)})"


def veto(subject: str = "subject", relation: str = "relation") -> str:
    words = f"list_transform(regexp_extract_all(lower({subject}), '[a-z0-9]+(?:[_-][a-z0-9]+)*'), lambda w: regexp_split_to_array(w, '[_-]'))"
    return f"""coalesce((list_filter({toks(relation)}, lambda t: list_contains({o.words(W.QUALIFIERS)}, t)))[1],
        (list_filter(list_transform({words}, lambda p: CASE
        WHEN len(p) = 1 THEN CASE WHEN list_contains({o.words(W.QUALIFIERS)}, p[1]) THEN p[1] END
        WHEN list_contains({o.words(W.QUALIFIERS)}, p[-1]) THEN p[-1]
        WHEN {has('p', W.BOUNDS)} THEN (list_filter(p, lambda y: list_contains({o.words(W.BOUNDS)}, y)))[1]
        WHEN {has('p', W.QUALIFIERS)} AND {has('p', W.MEASURED_NOUNS)} THEN (list_filter(p, lambda y: list_contains({o.words(W.QUALIFIERS)}, y)))[1] END),
        lambda x: x IS NOT NULL))[1])"""


def measurement(subject: str = "subject", relation: str = "relation", value: str = "value") -> str:
    joined = f"array_to_string({toks(relation)}, ' ')"
    counted = f"({has(toks(relation), W.COUNT_WORDS)} OR contains({joined}, 'number of'))"
    both, last = f"list_concat({toks(relation)}, {toks(value)})", f"({toks(subject)})[-1]"
    return f"""CASE WHEN NOT {matches(f'trim({value})', W.QUANTITY)} THEN false WHEN {veto(subject, relation)} IS NOT NULL THEN false
        WHEN {matches(relation, W.REQUIREMENT)} THEN false WHEN {among(joined, W.EXACT_MEASURES)} THEN true
        WHEN {counted} AND {has(both, W.ACCUMULATING)} THEN true
        WHEN {counted} AND ({has(toks(relation), W.WORK_ITEMS)} OR {among(last, W.WORK_ITEMS)}) THEN true
        WHEN {among(f'({toks(relation)})[-1]', W.WORK_ITEM_PLURAL)} AND regexp_full_match(trim({value}), '[0-9]+') THEN true
        WHEN {matches(value, W.MAGNITUDE)} AND {has(both, W.ACCUMULATING_PLURAL)} THEN true
        WHEN {matches(value, W.N_OF_M)} THEN {has(toks(relation), W.ACCUMULATING + W.COMPLETION_WORDS)} OR {among(last, W.ACCUMULATING)}
        ELSE false END"""


def moving_version(subject: str = "subject", relation: str = "relation", value: str = "value") -> str:
    text = f"({subject} || ' ' || {relation})"
    return f"""({matches(f'trim({value})', W.VERSION)} AND {has(toks(text), W.VERSION_NOUNS)}
        AND ({has(toks(text), W.MOVING)} OR {matches(text, W.ON_MAIN)}) AND {veto(subject, relation)} IS NULL)"""


def status(subject: str = "subject", relation: str = "relation", value: str = "value") -> str:
    full, val, sub = toks(relation), toks(value), toks(subject)
    noun = f"array_to_string(({full})[2:], ' ')"
    pointer = f"""(len({full}) >= 2 AND {among(f'({full})[1]', W.POINTER_LEADS)} AND (({among(noun, W.POINTER_NOUNS)} AND {matches(value, W.POINTED_AT)})
        OR ({noun} = 'branch' AND {matches(f'trim({value})', W.BRANCH_NAME)} AND NOT {among(f'lower(trim({value}))', W.LONG_LIVED_BRANCHES)})))"""
    joined = f"regexp_replace(array_to_string({full}, ' '), '^((current|overall|latest)( |$))+', '')"
    rel = f"list_filter(string_split({joined}, ' '), lambda x: x <> '')"
    finding, exact = among(joined, W.FINDINGS), f"(len({rel}) = 1 AND {among(joined, W.STATUS_RELATIONS)})"
    compound = f"(len({rel}) > 1 AND ({rel})[-1] = 'status')"
    outlives = f"({matches(value, W.POINTER)} OR {matches(value, W.LIMITATION)} OR {matches(f'regexp_replace({value}, {o.quoted(W.NOT_RESOLVED)}, {chr(39) * 2}, {o.quoted("g")})', W.RESOLVED)})"
    every = f"len(list_filter({val}, lambda x: NOT list_contains({o.words(W.STATUS_VALUE_WORDS + W.STATUS_FILLER)}, x))) = 0"
    status_value = f"(len({val}) > 0 AND {every} AND {has(val, W.STATUS_VALUE_WORDS)})"
    instance = f"({matches(subject, W.INSTANCE_ID)} OR {among(f'({sub})[-1]', W.INSTANCE_NOUNS)})"
    tree = f"(({has(sub, W.CHECKOUT_NOUNS)} OR contains(lower({subject}), 'working tree')) AND NOT {matches(value, W.LIMITATION)} AND {matches(value, W.TREE_STATE)})"
    return f"""CASE WHEN {among(joined, W.PLURAL_FINDINGS)} THEN false WHEN NOT ({finding} OR {exact} OR {compound} OR {pointer}) THEN false
        WHEN {veto(subject, relation)} IS NOT NULL THEN false WHEN {pointer} THEN true WHEN {finding} THEN NOT {outlives} WHEN {status_value} THEN true
        WHEN {exact} THEN {instance} OR {tree} ELSE {matches(f"{subject} || ' ' || {relation}", W.INSTANCE_ID)} END"""


def classify() -> str:
    return f"CASE WHEN {measurement()} THEN 'measurement' WHEN {moving_version()} THEN 'moving_version' WHEN {status()} THEN 'status' END"


def visible(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '\\p{{Cf}}', '', 'g'), '\\s+', ' ', 'g'))"


def instruction(subject: str = "subject", relation: str = "relation", value: str = "value") -> str:
    whole = visible(f"concat_ws(' ', {subject}, {relation}, {value})")
    chain = " ".join(f"WHEN {matches(whole, p)} THEN {o.quoted(why)}" for why, p in D.ANYWHERE)
    roles = " OR ".join(matches(visible(f), D.ROLE_OPENS) for f in (subject, relation, value))
    orders = " OR ".join(matches(visible(f), D.ORDER_OPENS) for f in (relation, value))
    return f"CASE {chain} WHEN {roles} THEN 'a role or prompt marker' WHEN {orders} THEN 'opens with an order' END"


def verdict() -> str:
    """Columns reliability, source, confirmed, valid_from beside the triple."""
    person = "(reliability > 0.5 OR NOT starts_with(source, 'memory:session/') OR confirmed)"
    young = f"epoch_us({o.NOW}) - epoch_us(valid_from) < 7 * 86400000000"
    order = instruction()
    return f"CASE WHEN ({order}) IS NOT NULL THEN 'instruction: ' || ({order}) WHEN {person} THEN NULL WHEN {young} THEN NULL ELSE {classify()} END"


# -- mining -------------------------------------------------------------------------------------------------------
def sentences(text: str) -> str:
    marked = f"regexp_replace({text}, {o.quoted(M.BOUNDARY)}, '\\1' || chr(1) || '\\2\\3', 'g')"
    for kind in (M.ABBREVIATION, M.INITIALISM):
        marked = f"regexp_replace({marked}, {o.quoted(kind)} || chr(1), '\\1', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def regions(turn: str) -> str:
    """Table expressions up to region(session, nth, region) from ``turn`` (id, session, text)."""
    return f"""told AS (SELECT id, session, {sentences('text')} AS s FROM {turn}),
    each_s AS (SELECT id, session, s, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM told),
    near AS (SELECT session, id, pos, left(trim(regexp_replace(array_to_string(s[greatest(pos, 1):CASE WHEN pos = 0 THEN 2 ELSE pos + 2 END], ' '), '\\s+', ' ', 'g')), {M.MAX_REGION}) AS region
        FROM each_s WHERE {matches('sentence', M.TRIGGER)}),
    once AS (SELECT *, row_number() OVER (PARTITION BY session, lower(region) ORDER BY id, pos) AS copy FROM near WHERE length(region) >= {M.LEAST_REGION}),
    region AS (SELECT * FROM (SELECT session, row_number() OVER (PARTITION BY session ORDER BY id, pos) AS nth, region FROM once WHERE copy = 1) WHERE nth <= {M.MAX_REGIONS})"""


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '')"


def admission(candidates: str) -> str:
    """judged(region, ..., subject, relation, value, reason) from candidates (region, anchor, keep, subject, relation, value, ...)."""
    clean = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
    a, b = f"({_words('region')})[1:6]", f"({_words('anchor')})[1:6]"
    aligned = f"len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b})) >= greatest(2, least(len({a}), len({b})) - 2)"
    bare = f"list_filter({_words('subject')}, lambda w: NOT list_contains({o.words(W.DETERMINERS)}, w))"
    want = f"list_filter({_words('value')}, lambda w: NOT list_contains({o.words(W.CONTENT_STOP)}, w))"
    setting = has("regexp_extract_all(lower(relation), '[a-z0-9]+')", W.QUALIFIERS)
    return f"""cleaned AS (SELECT * REPLACE ({clean('subject')} AS subject, lower({clean('relation')}) AS relation, {clean('value')} AS value, coalesce(anchor, '') AS anchor) FROM {candidates}),
    judged AS (SELECT *, CASE WHEN NOT coalesce(keep, false) THEN 'model rejected' WHEN NOT ({aligned}) THEN 'misaligned'
        WHEN subject = '' OR relation = '' OR value = '' THEN 'incomplete triple'
        WHEN {among('lower(subject)', W.DEICTIC)} OR {among('lower(value)', W.DEICTIC)} THEN 'deictic'
        WHEN len({bare}) = 1 AND {among(f'({bare})[1]', W.GENERIC_NOUNS)} THEN 'vague subject'
        WHEN length(subject) > {M.MAX_SUBJECT} THEN 'subject too long' WHEN len(string_split(relation, ' ')) > {M.MAX_RELATION_WORDS} THEN 'relation too long'
        WHEN length(value) > {M.MAX_VALUE} THEN 'value too long' WHEN length(value) < 2 AND NOT (regexp_full_match(value, '[0-9]') AND {setting}) THEN 'value too short'
        WHEN {matches('value', M.TASK_SHAPE)} THEN 'task instruction' WHEN ({instruction()}) IS NOT NULL THEN 'instruction-shaped'
        WHEN NOT (len({want}) > 0 AND list_has_all({_words('region')}, {want})) THEN 'not grounded' ELSE {classify()} END AS reason FROM cleaned)"""


def derived(turn: str, per_session: int = 8) -> str:
    """SELECT of the admitted triples that ``copula_extractor`` finds in ``turn``."""
    part = lambda i: f"regexp_extract(region, {o.quoted(M.COPULA)}, {i})"
    return f"""{regions(turn)}, cand AS (SELECT session, nth, region, region AS anchor, {part(1)} <> '' AS keep, {part(1)} AS subject, {part(2)} AS relation, {part(3)} AS value FROM region),
    {admission('cand')}, kept AS (SELECT *, row_number() OVER (PARTITION BY session, lower(subject), lower(relation), lower(value) ORDER BY nth) AS copy FROM judged WHERE reason IS NULL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY nth, subject, relation, value) AS place FROM kept WHERE copy = 1)
    SELECT session, nth::INTEGER AS nth, subject, relation, value FROM placed WHERE place <= {per_session}"""


ARRIVAL = f"""WITH RECURSIVE {o.ASSERTION}, placed AS (SELECT seq, key, value, epoch_us(valid_from) AS t, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM assertion),
    fold AS (SELECT key, n, seq, [{{'t': t, 'i': 1::BIGINT, 'v': value}}] AS held, 'created' AS outcome FROM placed WHERE n = 1
    UNION ALL SELECT p.key, p.n, p.seq,
        CASE WHEN p.value = f.held[-1].v THEN list_append(f.held[:-2], {{'t': least(f.held[-1].t, p.t), 'i': f.held[-1].i, 'v': p.value}})
            WHEN p.t < f.held[-1].t THEN CASE WHEN (list_filter(f.held, lambda h: h.t <= p.t))[-1].v IS NOT DISTINCT FROM p.value THEN f.held
                ELSE list_transform(list_sort(list_append(f.held, {{'t': p.t, 'i': len(f.held) + 1, 'v': p.value}})), lambda x, i: {{'t': x.t, 'i': i, 'v': x.v}}) END
            ELSE list_append(f.held, {{'t': p.t, 'i': len(f.held) + 1, 'v': p.value}}) END,
        CASE WHEN p.value = f.held[-1].v THEN 'reinforced'
            WHEN p.t < f.held[-1].t THEN CASE WHEN (list_filter(f.held, lambda h: h.t <= p.t))[-1].v IS NOT DISTINCT FROM p.value THEN 'reinforced' ELSE 'historical' END
            ELSE 'superseded' END
        FROM fold f JOIN placed p ON p.key = f.key AND p.n = f.n + 1)
    SELECT key, seq, outcome FROM fold"""
