"""Mining facts from turns: sentences, trigger regions with neighbours and caps, grounded admission of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.durability import classify, instruction_shape
from ..functions.text import array_of, lit

# Cue words of a fact, abbreviations that end no sentence, and the bounds of a region and a triple.
TRIGGER = (
    r"(?i)\b(is now|are now|now (?:uses|lives|runs|points)|switched to|moved to|renamed|decided|decision|chose|pinned|set to|defaults? to|default is|lives in|lives at"
    r"|always|never|must|instead of|replaced by|replaces|version)\b"
)
ABBREVIATION = r"""(?i)((?:^|[\s(\["'])(?:e\.g|i\.e|etc|vs|cf|al|approx|incl|excl|resp|no|fig|ca|mr|mrs|ms|dr|prof|sr|jr|st)\.)"""
INITIALISM = r"""((?:^|[\s(\["'])(?:[A-Za-z]\.)+)"""
BOUNDARY = r"""([.!?])(\s+)([A-Z`"'(\[0-9])"""
TASK_SHAPE = r"(?i)^(the (task|agent|work|change|implementation)\b.*\bmust be\b|implement\b|do not (switch|touch|push|force)\b|run the\b|report back\b)"
MAX_REGIONS, LEAST_REGION, MAX_REGION = 24, 30, 600
MAX_SUBJECT, MAX_RELATION_WORDS, MAX_VALUE = 80, 8, 200


def sentences(text: str) -> F.Column:
    """array<string>: a sentence ends at . ! or ? and white space before a capital, quote, bracket or digit, unless what
    ends there is an abbreviation or an initialism. Within a sentence the text stays as it is.

    Ends are marked with U+0001 in one pass, marks behind abbreviations go in two more, and the text is split once."""
    marked = F.regexp_replace(F.col(text), BOUNDARY, "$1\x01$2$3")
    for kind in (ABBREVIATION, INITIALISM):
        marked = F.regexp_replace(marked, kind + "\x01", "$1")
    return F.filter(F.transform(F.split(marked, "\x01", -1), lambda s: F.trim(s)), lambda s: s != "")


def regions(turns: DataFrame, cap: int = MAX_REGIONS, most_turns: int | None = None) -> DataFrame:
    """(session, nth, region): sentences with a cue word and their neighbours, each once a session, the first ``cap``; with
    ``most_turns`` only a session's first so many turns by id are looked through."""
    if most_turns is not None:
        place = F.row_number().over(Window.partitionBy("session").orderBy("id"))
        turns = turns.withColumn("place", place).where(F.col("place") <= most_turns).drop("place")
    own = turns.where(F.col("text").rlike(TRIGGER)).select("session", "id", sentences("text").alias("s"))
    each = own.select("session", "id", "s", F.posexplode("s").alias("at", "sentence")).where(F.col("sentence").rlike(TRIGGER))
    near = F.expr("array_join(slice(s, greatest(at, 1), IF(at = 0, 2, 3)), ' ')")
    found = each.select("session", "id", "at", F.substring(F.trim(F.regexp_replace(near, r"\s+", " ")), 1, MAX_REGION).alias("region"))
    found = found.where(F.length("region") >= LEAST_REGION)
    same = Window.partitionBy("session", F.lower("region")).orderBy("id", "at")
    order = Window.partitionBy("session").orderBy("id", "at")
    found = found.withColumn("copy", F.row_number().over(same)).where("copy = 1").withColumn("nth", F.row_number().over(order))
    return found.where(F.col("nth") <= cap).select("session", "nth", "region")


def _words(text: str) -> str:
    return f"filter(split(regexp_replace(lower({text}), '[^a-z0-9 ]', ' '), ' +'), w -> w <> '')"


def anchor_ok(region: str, anchor: str) -> F.Column:
    """Whether the echoed first words belong to the excerpt: at least max(2, shorter - 2) of six in common."""
    a, b = f"slice({_words(region)}, 1, 6)", f"slice({_words(anchor)}, 1, 6)"
    return F.expr(f"size({a}) > 0 AND size({b}) > 0 AND size(array_intersect({a}, {b})) >= greatest(2, least(size({a}), size({b})) - 2)")


def grounded(value: str, region: str) -> F.Column:
    """Whether every content word of the value occurs in the evidence; a value without any isn't grounded."""
    want = f"filter({_words(value)}, w -> NOT array_contains({array_of(W.CONTENT_STOP)}, w))"
    return F.expr(f"size({want}) > 0 AND size(array_except({want}, {_words(region)})) = 0")


def vague(subject: str) -> F.Column:
    own = f"filter({_words(subject)}, w -> NOT array_contains({array_of(W.DETERMINERS)}, w))"
    return F.expr(f"size({own}) = 1 AND array_contains({array_of(W.GENERIC_NOUNS)}, {own}[0])")


def admission(candidates: DataFrame) -> DataFrame:
    """Candidates (region, anchor, keep, subject, relation, value) with reason, null where admitted; the first failing
    check names the reason."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    rows = candidates.withColumns({"subject": clean("subject"), "relation": F.lower(clean("relation")), "value": clean("value"), "anchor": F.coalesce("anchor", F.lit(""))})
    setting = F.expr(f"arrays_overlap(regexp_extract_all(lower(relation), '[a-z0-9]+', 0), {array_of(W.QUALIFIERS)})")
    reason = (
        F.when(~F.coalesce("keep", F.lit(False)), "model rejected")
        .when(~anchor_ok("region", "anchor"), "misaligned")
        .when((F.col("subject") == "") | (F.col("relation") == "") | (F.col("value") == ""), "incomplete triple")
        .when(F.lower("subject").isin(W.DEICTIC) | F.lower("value").isin(W.DEICTIC), "deictic")
        .when(vague("subject"), "vague subject")
        .when(F.length("subject") > MAX_SUBJECT, "subject too long")
        .when(F.size(F.split("relation", " ")) > MAX_RELATION_WORDS, "relation too long")
        .when(F.length("value") > MAX_VALUE, "value too long")
        .when((F.length("value") < 2) & ~(F.col("value").rlike("^[0-9]$") & setting), "value too short")
        .when(F.col("value").rlike(TASK_SHAPE), "task instruction")
        .when(instruction_shape().isNotNull(), "instruction-shaped")
        .when(~grounded("value", "region"), "not grounded")
        .otherwise(classify())
    )
    return rows.withColumn("reason", reason)


def derive(regions_: DataFrame, extract, per_session: int = 8) -> DataFrame:
    """Admitted triples (session, subject, relation, value), each once a session, ``per_session`` at most; ``extract``
    maps (session, nth, region) to candidates, such as a model's answers or ``copula_extractor``."""
    found = admission(extract(regions_)).where("reason IS NULL")
    same = Window.partitionBy("session", F.lower("subject"), F.lower("relation"), F.lower("value")).orderBy("nth")
    found = found.withColumn("copy", F.row_number().over(same)).where("copy = 1")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("nth", "subject", "relation", "value")))
    return found.where(F.col("place") <= per_session).select("session", "nth", "subject", "relation", "value")


# Fixed value: the shape of a fact that ``copula_extractor`` takes.
COPULA = r"(?i)([A-Za-z0-9_-]+(?: [A-Za-z0-9_-]+)?) (is now|defaults to|lives in) ([A-Za-z0-9_./-]+)"


def copula_extractor(regions_: DataFrame) -> DataFrame:
    """A deterministic extractor for tests: "<subject> is now <value>" and "<subject> defaults to <value>"."""
    parts = [F.regexp_extract("region", COPULA, i) for i in (1, 2, 3)]
    return regions_.select("session", "nth", "region", F.col("region").alias("anchor"), (parts[0] != "").alias("keep"), parts[0].alias("subject"), parts[1].alias("relation"), parts[2].alias("value"))
