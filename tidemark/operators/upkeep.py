"""Smaller operators: usage, confirmations, manifests, residue, consistency of labels, invalid cells, event-log folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import analyze, normalize, release
from ..functions.words import NOT_TYPED


def usage(events: DataFrame) -> DataFrame:
    """(kind, id, uses, last_used) from append-only usage events (kind, id, ts); nothing is updated in place."""
    return events.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("uses"), F.max("ts").alias("last_used"))


def confirmations(restated: DataFrame) -> DataFrame:
    """(belief_id, confirmed_at, source): the first human restatement of each derived belief."""
    order = Window.partitionBy("belief_id").orderBy("confirmed_at", "source")
    return restated.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("belief_id", "confirmed_at", "source")


def missing_passages(turns: DataFrame, passages: DataFrame) -> DataFrame:
    """Turns that have no passage yet."""
    return turns.join(passages.select(F.col("turn_id").alias("id")).distinct(), "id", "left_anti")


def older_versions(named: DataFrame, declared: DataFrame) -> DataFrame:
    """(id, package, version, declared): versions named beside a package that its manifest has left behind; placeholder
    versions 0.0.0 declare nothing."""
    real = declared.where(~F.col("version").startswith("0.0.0")).select("package", F.col("version").alias("declared"))
    both = named.join(F.broadcast(real), "package")  # manifests of one project
    return both.where(release("version") < release("declared")).select("id", "package", "version", "declared")


def holding(beliefs: DataFrame, needle: str, fold: bool = False) -> DataFrame:
    """Beliefs of any status whose fields, or whose free-text source, hold a text."""
    pointer = F.col("source").rlike(r"^memory:session/.+/turn/\d+$")
    fields = [F.col(c) for c in ("subject", "relation", "value")] + [F.when(~pointer, F.col("source")).otherwise("")]
    show = (lambda c: F.lower(c)) if fold else (lambda c: c)
    hit = F.lit(False)
    for c in fields:
        hit = hit | show(c).contains(needle.lower() if fold else needle)
    return beliefs.where(hit)


def row_counts_holding(tables: dict[str, DataFrame], columns: dict[str, list[str]], needle: str) -> DataFrame:
    """(place, rows): in how many rows of each table.column a text occurs."""
    found = None
    for name, table in tables.items():
        counts = table.agg(*[F.count_if(F.col(c).contains(needle)).alias(c) for c in columns[name]])
        part = counts.select(F.inline(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("place"), F.col(c).alias("rows")) for c in columns[name]])))
        found = part if found is None else found.unionByName(part)
    return found


def stale_terms(indexed: DataFrame, live: DataFrame) -> DataFrame:
    """(term): terms that the index holds and no live text does."""
    now = live.select(F.explode(analyze("text")).alias("term")).distinct()
    return indexed.select("term").distinct().join(now, "term", "left_anti")


def touching_reviews(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    """Reviews whose candidate or incumbent is among ids (id): two semi-joins, no OR in a join."""
    a = reviews.join(ids.select(F.col("id").alias("candidate")), "candidate", "left_semi").select("review_id")
    b = reviews.join(ids.select(F.col("id").alias("incumbent")), "incumbent", "left_semi").select("review_id")
    return a.union(b).distinct()


#: Bits of the map of how names begin.
BITS = 1 << 15


def mentions(sources: DataFrame, sessions: DataFrame) -> DataFrame:
    """(id, session): sessions whose name a free-text source contains, wherever it stands in it.

    Containment as an equi-join of whole names: at each place of a source that may begin as a name does, a piece of each
    length that names have is looked up, so names that begin alike don't meet a source that has another of them. Beginnings
    are the shortest name's length, told by a map of 32,768 bits; a full map costs lookups, not results.
    """
    names = sessions.select("session").distinct().where("session <> ''")
    sizes = names.agg(F.min(F.length("session")).alias("least"), F.array_sort(F.collect_set(F.length("session"))).alias("lengths"))
    slot = lambda text: f"pmod(xxhash64({text}), {BITS})"
    bits = names.join(F.broadcast(sizes)).select(F.expr(slot("substring(session, 1, least)")).alias("h")).distinct()
    bits = bits.groupBy(F.expr("CAST(h div 64 AS INT)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(h % 64 AS INT)))").alias("bits"))
    bits = bits.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    bits = bits.select(F.expr(f"transform(sequence(0, {BITS // 64 - 1}), i -> coalesce(try_element_at(m, i), 0L))").alias("words"))
    known = f"transform(array({slot('substring(source, i, least)')}), h -> getbit(words[CAST(h div 64 AS INT)], CAST(h % 64 AS INT)) = 1)[0]"
    places = F.expr(f"filter(sequence(1, greatest(1, length(source) - least + 1)), i -> {known})")
    rows = sources.select("id", "source").join(F.broadcast(sizes.join(F.broadcast(bits)))).withColumn("at", F.explode(places))  # one row
    rows = rows.select("id", F.expr("substring(source, at, array_max(lengths))").alias("rest"), F.explode("lengths").alias("n")).where(F.length("rest") >= F.col("n"))
    return rows.select("id", F.expr("substring(rest, 1, n)").alias("session")).join(names, "session").select("id", "session").distinct()


def unindexed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Turns, passages or cursors without those of the given sources; nothing else follows from it."""
    return rows.join(sources.select("source").distinct(), "source", "left_anti")


def clean_store(turns: DataFrame, marked: DataFrame, beliefs: DataFrame) -> DataFrame:
    """One row (files, turns, beliefs): a store built anew without the marked sources, with the ledger copied into it."""
    kept = unindexed(turns, marked)
    sums = kept.agg(F.countDistinct("source").alias("files"), F.count(F.lit(1)).alias("turns"))
    return sums.join(F.broadcast(beliefs.agg(F.count(F.lit(1)).alias("beliefs"))))  # one row each


def merged_ledger(own: DataFrame, live: DataFrame) -> DataFrame:
    """A ledger with another's beliefs copied in, without their confirmations; an id that is there already stays."""
    return own.unionByName(live.join(own.select("id"), "id", "left_anti"))


def withheld_plan(plan: DataFrame, secret: str, mark: str = "[removed]") -> DataFrame:
    """A retraction plan (id, subject, relation, value, key, ...) as it may be shown: every form of a text masked in the
    fields, and the key made again from what is left, marks included."""
    guard = "\x02"
    fields = {c: masked(c, [secret], mark) for c in ("subject", "relation", "value")}
    out = plan.withColumns(fields)
    plain = lambda c: F.replace(F.col(c), F.lit(mark), F.lit(guard))
    key = F.replace(F.concat(normalize(plain("subject")), F.lit("|"), normalize(plain("relation"))), F.lit(guard), F.lit(mark))
    return out.withColumn("key", key)


def notice(stale: DataFrame, shown: DataFrame, name: str) -> DataFrame:
    """(beliefs): how many beliefs a store no longer shows; no row if there is none, or if ``shown`` (key) has the notice."""
    counts = stale.agg(F.count(F.lit(1)).alias("beliefs")).where("beliefs > 0")
    return counts.join(shown.where(F.col("key") == name).limit(1), F.lit(True), "left_anti")


def live_terms(terms: DataFrame, live: DataFrame) -> DataFrame:
    """(term, rows): in how many live texts each asked term occurs, 0 included."""
    counts = live.select("id", F.explode(F.array_distinct(analyze("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    return terms.select("term").distinct().join(counts, "term", "left").select("term", F.coalesce("rows", F.lit(0)).alias("rows"))


def grid_left(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Cells of an experiment's grid that no result covers yet."""
    return grid.join(done, ["variant", "scenario", "model", "repeat"], "left_anti")


def latest_calls(log: DataFrame) -> DataFrame:
    """One row for each prompt and rank: that of the prompt's latest call."""
    newest = Window.partitionBy("prompt_id").orderBy(F.desc("ts"))
    once = Window.partitionBy("prompt_id", "rank").orderBy(F.desc("ts"), "belief_id")
    last = log.withColumns({"call": F.rank().over(newest), "nth": F.row_number().over(once)})
    return last.where("call = 1 AND nth = 1").drop("call", "nth")


def label_faults(expected: DataFrame, labels: DataFrame) -> DataFrame:
    """(pair_id, fault): expected pairs without a label, labels that weren't expected, repeated labels."""
    counts = labels.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    both = expected.select("pair_id", F.lit(True).alias("asked")).distinct().join(counts, "pair_id", "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select("pair_id", fault.alias("fault")).where("fault IS NOT NULL")


def invalid_reasons(cells: DataFrame) -> DataFrame:
    """cells with reason, null if valid: out of copy, timeout, exit code, error flag, in that order."""
    reason = F.when(F.col("out_of_copy"), "out_of_copy").when(F.col("timed_out"), "timeout").when(F.col("rc") != 0, F.concat(F.lit("rc="), F.col("rc").cast("string"))).when(F.col("is_error"), "is_error")
    return cells.withColumn("reason", reason)


def grid_cells(variants: list[str], scenarios: DataFrame, models: list[str], repeats: int, seed: int) -> DataFrame:
    """All experiment cells in a seeded order."""
    axes = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(m).alias("model"), F.lit(r).alias("repeat")) for v in variants for m in models for r in range(repeats)])
    rows = scenarios.select("scenario", F.explode(axes).alias("a")).select("a.variant", "scenario", "a.model", "a.repeat")
    return rows.withColumn("place", F.xxhash64(F.lit(seed), "variant", "scenario", "model", "repeat"))


def fold_events(events: DataFrame) -> DataFrame:
    """One row a run of an event log (run, at, kind, tool, query, text): tools in order, the first, how often recall ran,
    its first queries, the last text, the number of turns."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "kind", "tool", "query", "text")))
    runs = events.groupBy("run").agg(ordered.alias("e"))
    tools = F.transform(F.filter("e", lambda x: x["kind"] == "tool"), lambda x: x["tool"])
    recalls = F.filter("e", lambda x: (x["kind"] == "tool") & (x["tool"] == "recall"))
    return runs.select(
        "run", tools.alias("tools"), F.get(tools, F.lit(0)).alias("first_tool"), F.size(recalls).alias("recalls"), F.get(recalls, F.lit(0))["query"].alias("first_query"),
        F.try_element_at(F.transform(F.filter("e", lambda x: x["kind"] == "text"), lambda x: x["text"]), F.lit(-1)).alias("final_text"), F.size(F.filter("e", lambda x: x["kind"] == "turn")).alias("turns"),
    )


def masked(text: str, secrets: list[str], mark: str = "[withheld]") -> F.Column:
    """A text with every form of each secret masked, the longest first."""
    forms = sorted({f for s in secrets for f in (s, s.lower(), s.upper(), s.replace('"', '\\"'))}, key=lambda f: (-len(f), f))
    out = F.col(text)
    for f in forms:
        out = F.replace(out, F.lit(f), F.lit(mark))
    return out


def pattern_suggestions(paths: DataFrame) -> DataFrame:
    """(path, pattern): a glob that would hide a path's own folder name, and one for folders that end in it."""
    name = F.regexp_extract("path", r"([^/]+)/?$", 1)
    return paths.select("path", F.explode(F.array(F.concat(F.lit("*"), name, F.lit("*")), F.concat(F.lit("*-"), name, F.lit("/*")))).alias("pattern"))


def typed(prompts: DataFrame, agent: str | None = None) -> DataFrame:
    """Prompts that a person typed: not the text of a notification, nor with ``agent`` (a boolean column) a subagent's."""
    own = ~F.col("text").rlike(NOT_TYPED)
    return prompts.where(own if agent is None else own & ~F.col(agent))


def scan_roll_up(locations: DataFrame) -> DataFrame:
    """One row: whether a text was found anywhere that isn't excluded, and whether every location could be read."""
    return locations.agg(F.bool_or((F.col("hits") > 0) & F.col("excluded_by").isNull()).alias("found"), F.bool_and("readable").alias("complete"))


def hiding_verdict(total: F.Column, hidden: F.Column, least: float = 0.5) -> F.Column:
    return F.when((total > 0) & (hidden / total >= least), "hides at least half of all transcripts")
