"""Column expressions over text: keys, query terms, analyzer tokens, passages, ages and one-line rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

#: Latin letters with marks and what the analyzer folds them to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"
CHUNK_LIMIT, CHUNK_LOW, CHUNK_HIGH = 2000, 1200, 1600
BREAKS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")


def lit(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_of(items: list[str]) -> str:
    return "array(" + ", ".join(lit(x) for x in items) + ")"


def normalize(text: str | Column) -> Column:
    """Lower case, quotes, punctuation and brackets off both ends, white space closed up."""
    edge = r"""[\s"'`.,;:!?()\[\]{}]+"""
    bare = F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), f"^{edge}|{edge}$", "")
    return F.regexp_replace(bare, r"\s+", " ")


def make_key(subject: str, relation: str) -> Column:
    return F.concat(normalize(subject), F.lit("|"), normalize(relation))


def _terms(text: str) -> str:
    return f"transform(regexp_extract_all({text}, {lit(W.TOKEN)}, 0), w -> trim(BOTH './-' FROM lower(w)))"


def query_terms(text: str) -> Column:
    """The first 24 distinct keywords of a query: 2 to 128 characters, no stopwords."""
    return F.expr(f"slice(array_distinct(filter({_terms(text)}, w -> length(w) BETWEEN 2 AND 128 AND NOT array_contains({array_of(W.STOPWORDS)}, w))), 1, 24)")


def subject_terms(text: str) -> Column:
    """All distinct keywords of a subject, without caps."""
    return F.expr(f"array_distinct(filter({_terms(text)}, w -> w <> '' AND NOT array_contains({array_of(W.STOPWORDS)}, w)))")


def analyze_sql(text: str) -> str:
    return f"regexp_extract_all(translate(lower({text}), '{ACCENTED}', '{FOLDED}'), '[\\\\p{{L}}\\\\p{{N}}]+', 0)"


def analyze(text: str) -> Column:
    """Index tokens: lower case, marks folded, split at whatever is neither letter nor digit. Not stemmed."""
    return F.expr(analyze_sql(text))


def est_tokens(text: str) -> Column:
    """Quarter of the characters, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("int"))


def passages(text: str) -> Column:
    """array<struct<ord,start,stop>>: spans that tile the text.

    While over 2,000 characters are left, a span ends after the last occurrence of the strongest break that lies
    within 1,200 to 1,600 characters of its start, or at 1,600. Empty text has no span.
    """
    window = f"reverse(substring({text}, a.at + 1 + {CHUNK_LOW}, {CHUNK_HIGH - CHUNK_LOW}))"
    found = " ".join(f"WHEN locate({lit(mark[::-1])}, w) > 0 THEN {CHUNK_HIGH} - locate({lit(mark[::-1])}, w) + 1" for mark in BREAKS)
    step = f"transform(array({window}), w -> CASE {found} ELSE {CHUNK_HIGH} END)[0]"  # the window is cut out once
    stop = f"CAST(a.at + IF(length({text}) - a.at > {CHUNK_LIMIT}, {step}, length({text}) - a.at) AS INT)"
    rounds = f"sequence(0, CAST(length({text}) / {CHUNK_LOW} AS INT))"
    long_ = F.expr(
        f"""aggregate({rounds}, CAST(struct(0, array()) AS struct<at:int,out:array<struct<ord:int,start:int,stop:int>>>),
        (a, i) -> IF(a.at >= length({text}), a, transform(array({stop}), z -> struct(z AS at, concat(a.out, array(struct(size(a.out) AS ord, a.at AS start, z AS stop))) AS out))[0]),
        a -> a.out)"""
    )
    short = F.array(F.struct(F.lit(0).alias("ord"), F.lit(0).alias("start"), F.length(text).cast("int").alias("stop")))
    return F.when((F.length(text) > 0) & (F.length(text) <= CHUNK_LIMIT), short).otherwise(long_)


def age_days(ts: Column, at: Column) -> Column:
    """Days from ts to at: 365 if unknown, 0 if in the future."""
    micros = F.unix_micros(at.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.greatest(F.coalesce(micros / 86_400_000_000, F.lit(365.0)), F.lit(0.0))


def age_hours(ts: Column, at: Column) -> Column:
    """Hours from ts to at; null if unknown, 0 if in the future."""
    micros = F.unix_micros(at.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.greatest(micros / 3_600_000_000, F.when(micros.isNotNull(), F.lit(0.0)))


def event_second(ts: str) -> Column:
    """An event time at second precision with Z, null if it doesn't begin as one."""
    found = F.regexp_extract(F.trim(ts), r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1)
    return F.when(found != "", F.concat(found, F.lit("Z")))


def value_terms(text: str) -> Column:
    """The distinct index terms of a value, sorted."""
    return F.array_sort(F.array_distinct(analyze(text)))


def ellipsis(ascii_only: bool = False) -> str:
    return "..." if ascii_only else "…"


def clip_head(text: str, limit: int, ascii_only: bool = False) -> Column:
    """White space closed up; over the limit the head stays, with a mark, limit characters in all."""
    flat, mark = F.trim(F.regexp_replace(text, r"\s+", " ")), ellipsis(ascii_only)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - len(mark))), F.lit(mark)))


def snippet(text: str, terms: str, size: int = 96) -> Column:
    """Of all windows of ``size`` index terms the first with the most matches of ``terms``, its terms joined by a space.
"""
    return F.expr(f"""transform(array({analyze_sql(text)}), t -> array_join(slice(t, 1 + array_position(
        transform(sequence(1, greatest(1, size(t) - {size} + 1)), i -> size(filter(slice(t, i, {size}), w -> array_contains({terms}, w)))),
        array_max(transform(sequence(1, greatest(1, size(t) - {size} + 1)), i -> size(filter(slice(t, i, {size}), w -> array_contains({terms}, w)))))) - 1, {size}), ' '))[0]""")


def activation(age: Column, uses: Column, decay: float, weight: float) -> Column:
    return F.pow(1 + age, F.lit(-decay)) * (1 + weight * F.log1p(F.greatest(uses, F.lit(0))))


def one_line(text: str) -> Column:
    """Control and line-separator characters to spaces, invisible ones away, white space closed up."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\p{Cf}", ""), r"[\p{Cc}\p{Zl}\p{Zp}]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def belief_line(subject: str, relation: str, value: str, recorded: str) -> Column:
    return F.concat(F.lit("- "), one_line(subject), F.lit(" "), one_line(relation), F.lit(": "), one_line(value), F.lit(" (recorded "), F.substring(F.col(recorded).cast("string"), 1, 10), F.lit(")"))


def clip_middle(text: str, limit: int) -> Column:
    """Texts over the limit keep two thirds of it from the head and a third from the tail."""
    head = limit * 2 // 3
    tail = limit - head
    return F.when(F.length(text) <= limit, F.col(text)).otherwise(F.concat(F.substring(text, 1, head), F.lit(" … "), F.expr(f"right({text}, {tail})")))


def project_dir(source: str) -> Column:
    """The folder of a transcript; a subagents folder counts for the session above it."""
    return F.regexp_replace(F.regexp_replace(source, r"/[^/]*$", ""), r"/[^/]+/subagents$", "")


MAX_DIR_NAME = 200


def project_dir_name(path: str) -> Column:
    """The folder name of a project's transcripts: a dash for each UTF-16 unit that is no ASCII letter or digit; of a name
    of over 200 the first 200, a dash, and the path's 31-hash over UTF-16 units in base 36."""
    plain = F.regexp_replace(F.regexp_replace(path, "[^\\x00-\\uffff]", "--"), "[^A-Za-z0-9]", "-")
    units = f"encode({path}, 'UTF-16BE')"
    unit = "CAST(conv(hex(substring(u, 2 * i + 1, 2)), 16, 10) AS BIGINT)"
    folded = f"""aggregate(sequence(0, length({path}) * 2 + 1), CAST(struct({units}, 0) AS struct<u:binary,h:bigint>),
        (a, i) -> IF(2 * i >= octet_length(a.u), a, struct(a.u AS u, (a.h * 31 + {unit.replace("(u,", "(a.u,")}) % 4294967296 AS h)), a -> a.h)"""
    tail = f"lower(conv(CAST(abs(IF({folded} >= 2147483648, {folded} - 4294967296, {folded})) AS STRING), 10, 36))"
    return F.when(F.length(plain) <= MAX_DIR_NAME, plain).otherwise(F.concat(F.substring(plain, 1, MAX_DIR_NAME), F.lit("-"), F.expr(tail)))


def pointer_session(source: str) -> Column:
    return F.nullif(F.regexp_extract(source, r"^memory:session/(.+)/turn/(\d+)$", 1), F.lit(""))


def pointer_turn(source: str) -> Column:
    return F.nullif(F.regexp_extract(source, r"^memory:session/(.+)/turn/(\d+)$", 2), F.lit("")).cast("long")


def glob_pattern(glob: str, home: str = "") -> str:
    """A glob over whole paths as a regular expression; * and ? cross slashes, [abc], [a-z] and [!abc] are classes, and a
    leading ~ is ``home`` where one is given."""
    if home and (glob == "~" or glob.startswith("~/")):
        glob = home + glob[1:]
    out, at = [], 0
    while at < len(glob):
        c, at = glob[at], at + 1
        end = glob.find("]", at + 1 + (glob[at : at + 1] == "!")) if c == "[" else -1
        if end > 0:
            inner = glob[at:end].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&", "\\&").replace("^", "\\^")
            out.append(f"[{'^' + inner[1:] if inner.startswith('!') else inner}]")
            at = end + 1
        else:
            out.append(".*" if c == "*" else "." if c == "?" else "\\" + c if c in "\\.^$+{}[]()|" else c)
    return "^(?s:" + "".join(out) + ")$"


def release(version: str) -> Column:
    """The numeric parts of a version, padded to eight, so that arrays compare as versions do."""
    return F.expr(f"slice(concat(transform(regexp_extract_all({version}, '\\\\d+', 0), x -> CAST(x AS INT)), array_repeat(0, 8)), 1, 8)")
