"""Which facts stay true: measurement, moving version and status tests over (subject, relation, value), and the gate."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .text import array_of, lit

MEASUREMENT, MOVING_VERSION, STATUS = "measurement", "moving_version", "status"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+', 0)"


def _any(tokens_sql: str, words: list[str]) -> str:
    return f"arrays_overlap({tokens_sql}, {array_of(words)})"


def _last(tokens_sql: str) -> str:
    return f"try_element_at({tokens_sql}, -1)"


def _in(value: str, words: list[str]) -> str:
    return f"array_contains({array_of(words)}, coalesce({value}, ''))"


def veto_sql(subject: str = "subject", relation: str = "relation") -> str:
    """The qualifier that makes a triple a rule or a setting, or NULL: any word of the relation; a whole word of the
    subject; of a joined identifier its last part, a bound in it, or a qualifier beside a measured noun."""
    of_word = f"""CASE
        WHEN size(p) = 1 THEN IF({_in('p[0]', W.QUALIFIERS)}, p[0], NULL)
        WHEN {_in(_last('p'), W.QUALIFIERS)} THEN {_last('p')}
        WHEN {_any('p', W.BOUNDS)} THEN filter(p, y -> {_in('y', W.BOUNDS)})[0]
        WHEN {_any('p', W.QUALIFIERS)} AND {_any('p', W.MEASURED_NOUNS)} THEN filter(p, y -> {_in('y', W.QUALIFIERS)})[0] END"""
    from_subject = f"""try_element_at(filter(transform(transform(regexp_extract_all(lower({subject}), '[a-z0-9]+(?:[_-][a-z0-9]+)*', 0), w -> split(w, '[_-]')),
        p -> {of_word}), x -> x IS NOT NULL), 1)"""
    return f"coalesce(try_element_at(filter({tokens(relation)}, t -> {_in('t', W.QUALIFIERS)}), 1), {from_subject})"


def veto(subject: str = "subject", relation: str = "relation") -> Column:
    return F.expr(veto_sql(subject, relation))


def measurement(subject: str = "subject", relation: str = "relation", value: str = "value", vetoed: str | None = None) -> Column:
    """``vetoed``, here and below: a column that has ``veto`` already."""
    rel, val, sub = tokens(relation), tokens(value), tokens(subject)
    joined = f"array_join({rel}, ' ')"
    words = f"concat({rel}, {val})"
    counted = f"({_any(rel, W.COUNT_WORDS)} OR {joined} LIKE '%number of%')"
    return F.expr(f"""CASE
        WHEN NOT trim({value}) RLIKE {lit(W.QUANTITY)} THEN false
        WHEN {vetoed or veto_sql(subject, relation)} IS NOT NULL THEN false
        WHEN {relation} RLIKE {lit(W.REQUIREMENT)} THEN false
        WHEN {_in(joined, W.EXACT_MEASURES)} THEN true
        WHEN {counted} AND {_any(words, W.ACCUMULATING)} THEN true
        WHEN {counted} AND ({_any(rel, W.WORK_ITEMS)} OR {_in(_last(sub), W.WORK_ITEMS)}) THEN true
        WHEN {_in(_last(rel), W.WORK_ITEM_PLURAL)} AND trim({value}) RLIKE '^[0-9]+$' THEN true
        WHEN {value} RLIKE {lit(W.MAGNITUDE)} AND {_any(words, W.ACCUMULATING_PLURAL)} THEN true
        WHEN {value} RLIKE {lit(W.N_OF_M)} THEN {_any(rel, W.ACCUMULATING + W.COMPLETION_WORDS)} OR {_in(_last(sub), W.ACCUMULATING)}
        ELSE false END""")


def moving_version(subject: str = "subject", relation: str = "relation", value: str = "value", vetoed: str | None = None) -> Column:
    text = f"concat({subject}, ' ', {relation})"
    return F.expr(f"""trim({value}) RLIKE {lit(W.VERSION)} AND {_any(tokens(text), W.VERSION_NOUNS)}
        AND ({_any(tokens(text), W.MOVING)} OR {text} RLIKE {lit(W.ON_MAIN)}) AND {vetoed or veto_sql(subject, relation)} IS NULL""")


def status(subject: str = "subject", relation: str = "relation", value: str = "value", vetoed: str | None = None) -> Column:
    full = tokens(relation)
    joined_full = f"array_join({full}, ' ')"
    noun = f"array_join(slice({full}, 2, size({full})), ' ')"
    pointer = f"""(size({full}) >= 2 AND {_in(f'{full}[0]', W.POINTER_LEADS)} AND (
        ({_in(noun, W.POINTER_NOUNS)} AND {value} RLIKE {lit(W.POINTED_AT)})
        OR ({noun} = 'branch' AND trim({value}) RLIKE {lit(W.BRANCH_NAME)} AND NOT {_in(f'lower(trim({value}))', W.LONG_LIVED_BRANCHES)})))"""
    joined = f"regexp_replace({joined_full}, '^((current|overall|latest)( |$))+', '')"
    rel = f"filter(split({joined}, ' '), x -> x <> '')"
    finding = _in(joined, W.FINDINGS)
    exact = f"(size({rel}) = 1 AND {_in(joined, W.STATUS_RELATIONS)})"
    compound = f"(size({rel}) > 1 AND {_last(rel)} = 'status')"
    outlives = f"({value} RLIKE {lit(W.POINTER)} OR {value} RLIKE {lit(W.LIMITATION)} OR regexp_replace({value}, {lit(W.NOT_RESOLVED)}, '') RLIKE {lit(W.RESOLVED)})"
    val = tokens(value)
    status_value = f"(size({val}) > 0 AND size(array_except({val}, {array_of(W.STATUS_VALUE_WORDS + W.STATUS_FILLER)})) = 0 AND {_any(val, W.STATUS_VALUE_WORDS)})"
    instance = f"({subject} RLIKE {lit(W.INSTANCE_ID)} OR {_in(_last(tokens(subject)), W.INSTANCE_NOUNS)})"
    checkout = f"({_any(tokens(subject), W.CHECKOUT_NOUNS)} OR lower({subject}) LIKE '%working tree%')"
    tree = f"({checkout} AND NOT {value} RLIKE {lit(W.LIMITATION)} AND {value} RLIKE {lit(W.TREE_STATE)})"
    return F.expr(f"""CASE
        WHEN {_in(joined, W.PLURAL_FINDINGS)} THEN false
        WHEN NOT ({finding} OR {exact} OR {compound} OR {pointer}) THEN false
        WHEN {vetoed or veto_sql(subject, relation)} IS NOT NULL THEN false
        WHEN {pointer} THEN true
        WHEN {finding} THEN NOT {outlives}
        WHEN {status_value} THEN true
        WHEN {exact} THEN {instance} OR {tree}
        ELSE concat({subject}, ' ', {relation}) RLIKE {lit(W.INSTANCE_ID)} END""")


def classify(subject: str = "subject", relation: str = "relation", value: str = "value") -> Column:
    """The volatile class, or null for a durable fact; the first test that fires decides."""
    return (
        F.when(measurement(subject, relation, value), MEASUREMENT)
        .when(moving_version(subject, relation, value), MOVING_VERSION)
        .when(status(subject, relation, value), STATUS)
    )


# The shapes of an order, with what each is called, in the order in which they are tried.
_V = W.ORDER_VERBS
ANYWHERE = (
    ("asks to drop earlier instructions",
     r"\b(?:ignore|disregard|forget|override|bypass)\b(?:\s+(?:all|any|every|the|your|my|of|these|those|previous|prior|above|earlier|"
     r"preceding|existing|former|original|other|system|safety|security)){0,8}\s+(?:instructions?|prompts?|rules|guidelines|guardrails|directions|directives|"
     r"context|constraints|policies|messages)\b"),
    ("an order addressed to the agent",
     r"\b(?:you|claude|(?:the\s+)?(?:assistant|agent|ai|model|llm))\s+(?:must|should|shall|needs? to|ha(?:ve|s) to|(?:are|is) required to|are to|may not|cannot|can't|"
     r"(?:are|is) not allowed to|will (?:now|always|never))\b"),
    ("a standing order", r"\bfrom now on\b|\byou are now\b|\bnew (?:system )?instructions?\b|\b(?:developer|god|jailbreak|dan) mode\b"),
    ("hides an action from the user",
     r"\bwithout (?:asking|telling|informing|notifying|alerting|confirming|consulting|checking with)\b|\b(?:do not|don't|never) (?:tell|inform|notify|alert|mention|reveal|"
     r"show|ask)\b|\b(?:silently|secretly|quietly|covertly) (?:" + _V + r")\b"),
    ("pipes a download into a shell",
     r"\b(?:curl|wget|iwr|irm|invoke-webrequest|invoke-restmethod)\b[^|;&]{0,300}\|\s*(?:sudo\s+)?(?:(?:ba|z|k|c|tc|da|fi)?sh|python[0-9.]*|perl|ruby|node|php|iex|invoke-expression)\b"
     r"|\bbase64\s+(?:-d|--decode|-D)\b[^|;&]{0,300}\|\s*(?:sudo\s+)?(?:ba|z|k|c|tc|da)?sh\b|\b(?:ba|z)?sh\s+-c\s+[\"']?\$\(\s*(?:curl|wget)\b"),
    ("deletes a home or root directory", r"\brm\s+-[a-z]*r[a-z]*\s+(?:--no-preserve-root\s+)?(?:~/?|/\*?|\$home/?|\*)(?:\s|$)"),
    ("a role or prompt marker",
     r"(?:^|[.!?]\s)(?:system|assistant|human|developer)\s*:|<\s*/?\s*(?:system|assistant|human|developer|instructions?|im_start|im_end|"
     r"function_calls|antml:[a-z_]+)\b[^>]{0,300}>|\[/?(?:inst|sys)\]|<<\s*/?\s*sys\s*>>|<\|[a-z_]+\|>"
     r"|\b(?:note|message|instructions?|reminder)\s+(?:to|for)\s+(?:the\s+)?(?:ai|assistant|agent|model|llm|claude|chatgpt|gpt)\b"),
)
ROLE_OPENS = r"^(?:system|assistant|human|developer)\s*:"
ORDER_OPENS = (
    r"^(?:please|kindly|make sure|be sure|remember to|ensure (?:that )?you|(?:important|urgent|attention|critical)\s*[:!]"
    r"|(?:always|never|do not|don't) (?:" + _V + r")\b)"
)


@functools.cache
def _fold():
    @F.pandas_udf("string")
    def folded(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t).casefold())

    return folded


def compatible(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with compatibility forms and cases of the columns folded, for ``instruction_shape``: no builtin does that. Rows
    that are all ASCII never leave the JVM."""
    plain = F.lit(True)
    for c in columns:
        plain = plain & ~F.coalesce(F.col(c), F.lit("")).rlike(r"[^\x00-\x7f]")
    odd = rows.where(~plain)
    return rows.where(plain).unionByName(odd.withColumns({c: _fold()(F.col(c)) for c in columns}))


def visible(text: str) -> str:
    """Lower case, invisible characters away, white space closed up. Compatibility forms: see ``compatible``."""
    return f"trim(regexp_replace(regexp_replace(lower({text}), '\\\\p{{Cf}}', ''), '\\\\s+', ' '))"


def instruction_shape(subject: str = "subject", relation: str = "relation", value: str = "value") -> Column:
    """Why a triple reads as an order to the agent, or null for a fact."""
    whole = visible(f"concat_ws(' ', {subject}, {relation}, {value})")
    chain = " ".join(f"WHEN {whole} RLIKE {lit(p)} THEN {lit(why)}" for why, p in ANYWHERE)
    roles = " OR ".join(f"{visible(f)} RLIKE {lit(ROLE_OPENS)}" for f in (subject, relation, value))
    orders = " OR ".join(f"{visible(f)} RLIKE {lit(ORDER_OPENS)}" for f in (relation, value))
    return F.expr(f"CASE {chain} WHEN {roles} THEN 'a role or prompt marker' WHEN {orders} THEN 'opens with an order' END")


def verdict(now: Column, window_days: float = 7.0) -> Column:
    """Why a current belief is left out of prompts, or null: an order always; then a volatile class, unless a person
    stated it (reliability above 0.5, a source that is no pointer, or a confirmation) or it is younger than the window.
    Columns: subject, relation, value, reliability, source, confirmed, valid_from."""
    person = (F.col("reliability") > 0.5) | ~F.col("source").startswith("memory:session/") | F.col("confirmed")
    young = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("valid_from").cast("timestamp"))) < window_days * 86_400_000_000
    order = instruction_shape()
    return F.when(order.isNotNull(), F.concat(F.lit("instruction: "), order)).when(person, None).when(young, None).otherwise(classify())
