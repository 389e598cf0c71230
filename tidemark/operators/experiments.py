"""Retrieval evaluation, experiment scoring, relevance choice and the replay of threshold grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(k: F.Column, n: F.Column) -> tuple[F.Column, F.Column]:
    """Bounds of the 95 % score interval of k in n; null for n = 0."""
    p, z2 = k / n, Z * Z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def sign_test(wins: str, losses: str) -> F.Column:
    """Exact two-sided p of a sign test; 1 without any difference. Summed from logarithms, so that n may be large."""
    n, low = f"({wins} + {losses})", f"least({wins}, {losses})"
    tail = f"""aggregate(sequence(0, CAST({low} AS INT)), CAST(struct({n} * ln(0.5D), 0.0D) AS struct<l:double,s:double>),
        (a, i) -> struct(a.l + ln(({n} - i) / (i + 1)) AS l, a.s + exp(a.l) AS s), a -> a.s)"""
    return F.expr(f"CASE WHEN {n} = 0 THEN 1.0D ELSE least(1.0D, 2 * {tail}) END")


def election_by_model(cells: DataFrame) -> DataFrame:
    """Per variant and model over valid cells (expect boolean): counts, rates, balanced accuracy, phrasings of elected
    positives, first-tool rate over positives, mismatches. A rate of nothing is null."""
    positive, elected = F.col("expect"), F.col("recall_called")
    rows = cells.where("valid").groupBy("variant", "model").agg(
        F.count_if(positive).alias("n_pos"),
        F.count_if(~positive).alias("n_neg"),
        F.count_if(positive & elected).alias("tp"),
        F.count_if(~positive & elected).alias("fp"),
        F.avg(F.when(positive & elected, F.col("n_phrasings"))).alias("phrasings"),
        F.avg(F.when(positive, (F.col("first_tool") == "recall").cast("double"))).alias("first_rate"),
        F.count_if("recall_mismatch").alias("mismatch"),
        F.count_if("count_mismatch").alias("count_mismatch"),
    )
    rows = rows.withColumns({"tpr": F.try_divide("tp", "n_pos"), "fpr": F.try_divide("fp", "n_neg")})
    return rows.withColumn("balanced", (F.col("tpr") + 1 - F.col("fpr")) / 2)


def decide(cells: DataFrame, candidate: str, control: str, alpha: float = 0.05) -> DataFrame:
    """(model, pairs, wins, losses, n_pos, elected, elected_control, passes): a candidate passes with a model if it is right
    significantly more often where they differ, and elects no fewer of the matched positives. It ships if it passes with
    every model (``ships``)."""
    right = F.col("expect") == F.col("recall_called")
    own = cells.where("valid").select("variant", "model", "scenario", "repeat", "expect", "recall_called", right.alias("right"))
    key = ["model", "scenario", "repeat"]
    base = own.where(F.col("variant") == control).select(*key, F.col("right").alias("base"), F.col("recall_called").alias("base_called"))
    pairs = own.where(F.col("variant") == candidate).join(base, key)
    sums = pairs.groupBy("model").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("right") & ~F.col("base")).alias("wins"),
        F.count_if(F.col("base") & ~F.col("right")).alias("losses"),
        F.count_if("expect").alias("n_pos"),
        F.count_if(F.col("expect") & F.col("recall_called")).alias("elected"),
        F.count_if(F.col("expect") & F.col("base_called")).alias("elected_control"),
    )
    better = (F.col("wins") > F.col("losses")) & (sign_test("wins", "losses") < alpha)
    return sums.withColumn("passes", better & (F.col("n_pos") > 0) & (F.col("elected") >= F.col("elected_control")))


def ships(decided: DataFrame) -> DataFrame:
    """One row: whether every model passes; without a model nothing ships."""
    return decided.agg(F.coalesce(F.bool_and("passes"), F.lit(False)).alias("ship"))


def election_rates(cells: DataFrame) -> DataFrame:
    """Per variant over valid cells: true and false positive rate, balanced accuracy, phrasings of elected positives,
    share whose first tool was recall."""
    positive, elected = F.col("expect") == "recall", F.col("recall_called")
    rows = cells.where("valid").groupBy("variant").agg(
        F.count_if(positive).alias("positives"),
        F.count_if(~positive).alias("negatives"),
        F.count_if(positive & elected).alias("tp"),
        F.count_if(~positive & elected).alias("fp"),
        F.avg(F.when(positive & elected, F.col("n_phrasings"))).alias("phrasings"),
        F.avg(F.col("first_is_recall").cast("double")).alias("first_rate"),
    )
    rows = rows.withColumns({"tpr": F.try_divide("tp", "positives"), "fpr": F.try_divide("fp", "negatives")})
    return rows.withColumn("balanced", (F.col("tpr") + 1 - F.col("fpr")) / 2)


def election_pivot(cells: DataFrame, variants: list[str]) -> DataFrame:
    """Elections by class, a column for each variant."""
    return cells.where("valid").groupBy("class").pivot("variant", variants).agg(F.count_if("recall_called"))


def paired_test(cells: DataFrame, control: str) -> DataFrame:
    """(variant, pairs, wins, losses, p): variants against control on the same scenario and repeat. A win is being right
    where control is wrong."""
    right = (F.col("expect") == "recall") == F.col("recall_called")
    own = cells.where("valid").select("variant", "scenario", "repeat", right.alias("right"))
    base = own.where(F.col("variant") == control).select("scenario", "repeat", F.col("right").alias("base"))
    pairs = own.where(F.col("variant") != control).join(base, ["scenario", "repeat"])
    sums = pairs.groupBy("variant").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("right") & ~F.col("base")).alias("wins"), F.count_if(F.col("base") & ~F.col("right")).alias("losses"))
    return sums.withColumn("p", sign_test("wins", "losses"))


def decisions(rates: DataFrame, tests: DataFrame, control: str, alpha: float = 0.05) -> DataFrame:
    """(variant, ship): better balanced accuracy than control, with a significant sign test."""
    base = rates.where(F.col("variant") == control).select(F.col("balanced").alias("base"))
    both = rates.join(tests.select("variant", "p"), "variant").join(F.broadcast(base))  # one row
    return both.select("variant", ((F.col("balanced") > F.col("base")) & (F.col("p") < alpha)).alias("ship"))


def choose(log: DataFrame, threshold: float, k: int, pool: int) -> DataFrame:
    """(prompt_id, belief_id, place): of a prompt's first ``pool`` candidates those at or over the threshold, best
    first, k at most; a prompt whose scores are missing gets its first k as they come."""
    rows = log.where(F.col("rank") <= max(pool, k))
    broken = F.max(F.col("p").isNull()).over(Window.partitionBy("prompt_id"))
    rows = rows.withColumn("broken", broken).where(F.col("broken") | (F.col("p") >= threshold))
    order = Window.partitionBy("prompt_id").orderBy(F.when(F.col("broken"), F.lit(0.0)).otherwise(-F.col("p")), "rank")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("prompt_id", "belief_id", "place")


def health(log: DataFrame, threshold: float) -> DataFrame:
    """One row over the log: candidates by group (kept, dropped, added, passed, unanswered), p at two quantiles taken
    as elements of the sorted list, not interpolated."""
    chosen = F.col("p") >= threshold
    answered = F.col("p").isNotNull() & ~F.col("error")
    group = (
        F.when(~answered, "unanswered").when(chosen & F.col("today"), "kept").when(~chosen & F.col("today"), "dropped").when(chosen, "added").otherwise("passed")
    )
    return log.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("prompt_id").alias("prompts"), F.round(F.avg("p"), 6).alias("mean_p"))


def prompt_health(log: DataFrame, threshold: float, k: int) -> DataFrame:
    """One row over a log's prompts: answered, fallback rate, blocks that the filter emptied, prompts where the cap of
    ``k`` binds, candidates a prompt before and with the filter."""
    over = F.coalesce(F.col("p") >= threshold, F.lit(False))
    order = Window.partitionBy("prompt_id").orderBy(F.desc_nulls_last("p"), "rank")
    rows = log.withColumn("chosen", over & (F.row_number().over(order) <= k))
    each = rows.groupBy("prompt_id").agg(
        F.bool_and(F.col("p").isNotNull() & ~F.col("error")).alias("answered"), F.bool_or("today").alias("had"), F.bool_or("chosen").alias("has"),
        F.count_if(over).alias("over"), F.count_if("chosen").alias("with"), F.count_if("today").alias("alone"),
    )
    good = F.col("answered")
    return each.agg(
        F.count(F.lit(1)).alias("prompts"), F.count_if(good).alias("answered"), F.round(F.avg((~good).cast("double")), 4).alias("fallback_rate"),
        F.count_if(good & F.col("had") & ~F.col("has")).alias("emptied"), F.count_if(good & (F.col("over") > F.col("with"))).alias("capped"),
        F.round(F.sum(F.when(good, F.col("alone"))) / F.count_if(good), 2).alias("alone_per_prompt"), F.round(F.sum(F.when(good, F.col("with"))) / F.count_if(good), 2).alias("filtered_per_prompt"),
    )


def group_precision(log: DataFrame, verdicts: DataFrame, threshold: float) -> DataFrame:
    """(group, relevant, noise, precision) of judged candidates: kept, dropped, added, and the misses, passed."""
    chosen = F.col("p") >= threshold
    group = F.when(chosen & F.col("today"), "kept").when(~chosen & F.col("today"), "dropped").when(chosen, "added").otherwise("passed")
    sums = log.join(verdicts, "belief_id").groupBy(group.alias("group")).agg(F.count_if("relevant").alias("relevant"), F.count_if(~F.col("relevant")).alias("noise"))
    return sums.withColumn("precision", F.round(F.try_divide("relevant", F.col("relevant") + F.col("noise")), 4))


def injection_rates(scores: DataFrame) -> DataFrame:
    """One row over scored contexts: in what share anything was injected, all, positive and negative questions apart."""
    any_ = (F.col("chars") > 0).cast("double")
    negative = F.col("type") == "negative"
    return scores.agg(F.round(F.avg(any_), 6).alias("injected"), F.round(F.avg(F.when(~negative, any_)), 6).alias("positives"), F.round(F.avg(F.when(negative, any_)), 6).alias("negatives"))


def toward(now: F.Column, want: F.Column, step: float = 0.5) -> F.Column:
    """A damped move of a setting: half the way to the proposal."""
    return F.round(now + step * (want - now), 4)


def stratified(log: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` candidates of each group to be judged, in the order of a seeded hash: the same for the same log."""
    order = Window.partitionBy("group").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "prompt_id", "belief_id")), "prompt_id", "belief_id")
    return log.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def element_quantiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Of each group the sorted list's element at min(n - 1, int(share n))."""
    order, every = Window.partitionBy(by).orderBy(value), Window.partitionBy(by)
    placed = rows.withColumns({"at": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(every)})
    picks = [F.max(F.when(F.col("at") == F.least(F.col("n") - 1, F.floor(F.col("n") * s)), F.col(value))).alias(f"q{int(s * 100)}") for s in shares]
    return placed.groupBy(by).agg(*picks)


def majority(votes: DataFrame) -> DataFrame:
    """(pair_id, verdict, yes, no): relevant, noise, or split on a tie."""
    sums = votes.groupBy("pair_id").agg(F.count_if("relevant").alias("yes"), F.count_if(~F.col("relevant")).alias("no"))
    return sums.withColumn("verdict", F.when(F.col("yes") > F.col("no"), "relevant").when(F.col("yes") < F.col("no"), "noise").otherwise("split"))


def offenders(log: DataFrame, verdicts: DataFrame, least: int = 5, share: float = 0.8, limit: int = 25) -> DataFrame:
    """(key, n, noise_share): candidates judged often and mostly noise, the worst first."""
    rows = log.join(verdicts, "belief_id").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((~F.col("relevant")).cast("double")), 6).alias("noise_share"))
    return rows.where((F.col("n") >= least) & (F.col("noise_share") >= share)).orderBy(F.desc("noise_share"), F.desc("n"), "key").limit(limit)


def replay_grid(log: DataFrame, verdicts: DataFrame, thresholds: list[float], ks: list[int], pools: list[int]) -> DataFrame:
    """(threshold, k, pool, relevant, noise, unlabeled): what each setting would have injected over the whole log.

    A setting's picks are the first k by p among candidates in the pool over its threshold. Ranks by p are taken once
    for each pool; thresholds and ks then only count: a candidate in place r by p is picked if r <= k and p passes.
    """
    order = Window.partitionBy("prompt_id", "pool").orderBy(F.desc("p"), "rank")
    rows = log.where("p IS NOT NULL").withColumn("pool", F.explode(F.array(*[F.lit(p) for p in pools]))).where(F.col("rank") <= F.col("pool"))
    rows = rows.withColumn("place", F.row_number().over(order)).join(verdicts, "belief_id", "left")
    grid = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(k).alias("k")) for t in thresholds for k in ks])
    rows = rows.withColumn("g", F.explode(grid)).where((F.col("p") >= F.col("g.threshold") - 1e-9) & (F.col("place") <= F.col("g.k")))
    label = F.col("relevant")
    return rows.groupBy(F.col("g.threshold").alias("threshold"), F.col("g.k").alias("k"), "pool").agg(
        F.count_if(label).alias("relevant"), F.count_if(~label).alias("noise"), F.count_if(label.isNull()).alias("unlabeled")
    )


def propose(grid: DataFrame, keep: float = 0.99) -> DataFrame:
    """The setting with least noise among those that keep the given share of the most relevant picks."""
    most = grid.agg(F.max("relevant").alias("most"))
    good = grid.join(F.broadcast(most)).where(F.col("relevant") >= keep * F.col("most"))  # one row
    return good.orderBy("noise", F.desc("relevant"), "threshold", "k", "pool").limit(1).drop("most")


def contexts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """questions (id, ...) with context: the texts of a question's hits (qid, rank, text) in order of rank, or empty."""
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n")
    return questions.join(hits.groupBy(F.col("qid").alias("id")).agg(told.alias("context")), "id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def eval_scores(contexts: DataFrame) -> DataFrame:
    """(id, type, found, stale, ok) from (id, type, context, expect, reject): found if any expected text occurs; stale if
    an outdated one occurs before every expected one; a negative question is right if nothing expected is found."""
    def first(of: str) -> str:
        return f"array_min(filter(transform({of}, x -> instr(context, x)), p -> p > 0))"

    rows = contexts.withColumns({"good": F.expr(first("expect")), "bad": F.expr(first("reject"))})
    found = F.col("good").isNotNull()
    stale = F.col("bad").isNotNull() & (~found | (F.col("bad") < F.col("good")))
    ok = F.when(F.col("type") == "negative", ~found).when(F.col("type") == "stale", found & ~stale).otherwise(found)
    return rows.select("id", "type", found.alias("found"), stale.alias("stale"), ok.alias("ok"), F.length("context").alias("chars"))


def eval_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("accuracy"), F.round(F.avg(F.col("stale").cast("double")), 6).alias("stale_rate"), F.median("chars").alias("median_chars")
    )
