"""Ranked recall: passages, postings, BM25, activation, per-turn and per-text collapse, rank fusion, the subject rule.

Queries come as a table (qid, text), so a batch of prompts is one job. What is broadcast by default is left to the
optimiser; query terms are the small side by nature, postings stay partitioned by term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.porter import stemmed
from ..functions.text import activation, age_days, analyze, passages, query_terms, subject_terms

K1, B = 1.2, 0.75
TURN_DECAY, BELIEF_DECAY, USE_WEIGHT = 0.5, 0.1, 0.5
POOL_TURNS, POOL_BELIEFS = 200, 100
#: A term is common if more than so many queries ask it and more than so many documents hold it.
COMMON = 64


def index_terms(text: str, stem: bool = False) -> F.Column:
    """A text's index terms, stemmed if asked: through Arrow, where SQL has no stemmer."""
    return stemmed(analyze(text)) if stem else analyze(text)


def passage_table(turns: DataFrame) -> DataFrame:
    """(turn_id, ord, start, stop, text): spans that tile every turn's text."""
    spans = turns.select(F.col("id").alias("turn_id"), "text", F.explode(passages("text")).alias("s"))
    return spans.select("turn_id", "s.ord", "s.start", "s.stop", F.expr("substring(text, s.start + 1, s.stop - s.start)").alias("text"))


def weighted_tokens(docs: DataFrame, columns: dict[str, float], key: str, stem: bool) -> DataFrame:
    """(key, w, tokens): a row for each column of a document, in one pass over the documents."""
    each = F.explode(F.array(*[F.struct(F.lit(float(w)).alias("w"), index_terms(c, stem).alias("tokens")) for c, w in columns.items()]))
    return docs.select(F.col(key).alias("key"), each.alias("c")).select("key", "c.w", "c.tokens")


def postings(docs: DataFrame, columns: dict[str, float], key: str, stem: bool = False) -> tuple[DataFrame, DataFrame]:
    """((term, key, tf), (key, dl)): weighted term frequencies and lengths over all columns."""
    every = weighted_tokens(docs, columns, key, stem)
    lengths = every.groupBy("key").agg(F.sum(F.size("tokens")).alias("dl"))
    terms = every.select("key", "w", F.explode("tokens").alias("term")).groupBy("term", "key").agg(F.sum("w").alias("tf"))
    return terms, lengths


def query_keywords(queries: DataFrame, stem: bool = False) -> DataFrame:
    """(qid, term): single-piece keywords of each query, as the index sees them."""
    words = queries.select("qid", F.explode(query_terms("text")).alias("keyword"))
    pieces = words.select("qid", index_terms("keyword", stem).alias("p"))
    return pieces.where(F.size("p") == 1).select("qid", F.col("p")[0].alias("term")).distinct()


def phrase_keywords(queries: DataFrame, stem: bool = False) -> DataFrame:
    """(qid, phrase): keywords that fall into several pieces and match only as a phrase."""
    words = queries.select("qid", F.explode(query_terms("text")).alias("keyword"))
    return words.select("qid", index_terms("keyword", stem).alias("phrase")).where(F.size("phrase") > 1).distinct()


def phrase_postings(docs: DataFrame, phrases: DataFrame, columns: dict[str, float], key: str, stem: bool = False) -> DataFrame:
    """(term, key, tf): documents with a phrase of ``phrases``, joined on its first piece, counted by position."""
    wanted = phrases.select("phrase").distinct().withColumn("first", F.col("phrase")[0])
    hit = weighted_tokens(docs, columns, key, stem).withColumn("first", F.explode(F.array_distinct("tokens"))).join(wanted, "first")
    times = F.expr("size(filter(sequence(1, size(tokens)), i -> slice(tokens, i, size(phrase)) = phrase))")
    found = hit.select(F.array_join("phrase", " ").alias("term"), "key", (times * F.col("w")).alias("tf")).where("tf > 0")
    return found.groupBy("term", "key").agg(F.sum("tf").alias("tf"))


def asked_postings(docs: DataFrame, columns: dict[str, float], key: str, queries: DataFrame, stem: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, keywords) for all keywords of the queries: words, and compounds as phrases."""
    terms, lengths = postings(docs, columns, key, stem)
    phrases = phrase_keywords(queries, stem)
    terms = terms.unionByName(phrase_postings(docs, phrases, columns, key, stem))
    return terms, lengths, query_keywords(queries, stem).unionByName(phrases.select("qid", F.array_join("phrase", " ").alias("term")).distinct())


def term_parts(terms: DataFrame, lengths: DataFrame, keywords: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(term, key, part): what each asked term adds to a document's score, idf x saturated frequency; a keyword in half of the
    documents or more counts 1e-6. ``only`` (key): documents to list; the statistics are of all."""
    corpus = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    terms = terms.join(keywords.select("term").distinct(), "term", "left_semi")  # goes below the count by document
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if only is not None:
        terms = terms.join(only.select("key"), "key", "left_semi")
    hits = terms.join(df, "term").join(lengths, "key").join(F.broadcast(corpus))  # one row
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.select("term", "key", part.alias("part"))


def bm25(terms: DataFrame, lengths: DataFrame, keywords: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(qid, key, score): every document that a query meets, with the sum of its ``term_parts``."""
    return keywords.join(term_parts(terms, lengths, keywords, only), "term").groupBy("qid", "key").agg(F.sum("part").alias("score"))


def placed(score: F.Column, key: F.Column, *more: F.Column) -> F.Column:
    """A struct that sorts as ``top`` ranks: by the score to nine places, the greatest first, then by key."""
    return F.struct(score.isNull().alias("unknown"), (-F.round(score, 9)).alias("at"), key.alias("key"), score.alias("score"), *more)


def best_pool(terms: DataFrame, lengths: DataFrame, keywords: DataFrame, k: int, about: DataFrame) -> DataFrame:
    """(qid, pool): the k best documents of each query among ``about`` (key and more), an array as ``placed`` sorts, with
    about's columns; what ``top`` makes of ``bm25``, without a row for each query and document that share a common term.

    A term is common if many queries ask it and many documents hold it. Every part is positive, so a document that a query
    meets by common terms alone is among its k best only if it is among the k best by these; they are ranked once for
    each set of common terms, and of documents alike in all of them the first k do. Those that it meets by other terms are
    scored in full.
    """
    parts = term_parts(terms, lengths, keywords, about).localCheckpoint(False)  # asked four times; goes with the result
    asked = keywords.groupBy("term").agg(F.count(F.lit(1)).alias("asked"))
    listed = parts.groupBy("term").agg(F.count(F.lit(1)).alias("listed"))
    common = asked.join(listed, "term").where(F.least("asked", "listed") > COMMON).select("term", F.lit(True).alias("common"))
    words = keywords.join(common, "term", "left")
    sets = words.groupBy("qid").agg(F.array_sort(F.collect_set(F.when(F.col("common"), F.col("term")))).alias("terms"))
    alike = parts.join(common, "term", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", "part"))).alias("profile"))
    info = F.struct(*[F.col(c) for c in about.columns if c != "key"]).alias("about")

    own = words.where("common IS NULL").join(parts, "term").groupBy("qid", "key").agg(F.sum("part").alias("own"))
    rest = F.expr("coalesce(aggregate(filter(profile, x -> array_contains(terms, x.term)), 0D, (a, x) -> a + x.part), 0D)")
    met = own.join(alike, "key", "left").join(sets.withColumnRenamed("qid", "q"), F.col("qid").eqNullSafe(F.col("q")))
    met = top(met.select("qid", "key", (F.col("own") + rest).alias("score")), k).join(about, "key").groupBy(F.col("qid").alias("q"))
    met = met.agg(F.collect_list(placed(F.col("score"), F.col("key"), info)).alias("met"))

    first = Window.partitionBy("profile").orderBy("key")
    few = alike.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).select("key", F.inline("profile"))
    every = sets.select("terms").where(F.size("terms") > 0).distinct().withColumn("term", F.explode("terms"))
    every = top(every.join(few, "term").groupBy("terms", "key").agg(F.sum("part").alias("score")), k, by="terms").join(about, "key")
    every = every.groupBy("terms").agg(F.collect_list(placed(F.col("score"), F.col("key"), info)).alias("every"))

    rows = sets.join(met, F.col("qid").eqNullSafe(F.col("q")), "left").join(every, "terms", "left")
    both = f"""slice(array_sort(concat(coalesce(met, array()), filter(coalesce(every, array()), x -> NOT coalesce(array_contains(met.key, x.key), false)))), 1, {k})"""
    return rows.select("qid", F.expr(both).alias("pool"))


def top(scored: DataFrame, k: int, by: str = "qid", key: str = "key", score: str = "score") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), F.asc(key))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


@dataclass(frozen=True)
class Index:
    """Passages (with key), postings (term, key, tf) and lengths (key, dl) of a store's turns."""

    parts: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stem: bool = False

    def asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        phrases = phrase_keywords(queries, self.stem)
        both = self.terms.select("term", "key", "tf").unionByName(phrase_postings(self.parts, phrases, {"text": 1.0}, "key", self.stem))
        return both, self.lengths, query_keywords(queries, self.stem).unionByName(phrases.select("qid", F.array_join("phrase", " ").alias("term")).distinct())


def build_index(turns: DataFrame, stem: bool = False) -> Index:
    parts = passage_table(turns).withColumn("key", F.col("turn_id") * 1000 + F.col("ord"))
    return Index(parts, *postings(parts, {"text": 1.0}, "key", stem), stem)


def store_index(index: Index, folder: str, buckets: int = 64) -> None:
    """Write an index: postings by a bucket of their term and sorted by it, so that a lookup prunes files and row groups."""
    index.parts.write.mode("overwrite").parquet(f"{folder}/passages")
    index.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
    placed = index.terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings-{buckets}-{int(index.stem)}")


def stored_index(spark: SparkSession, folder: str, queries: DataFrame | None = None, buckets: int = 64, stem: bool = False) -> Index:
    """An index as written. With ``queries`` only the buckets of their keywords are read: the join on bucket prunes folders."""
    terms = spark.read.parquet(f"{folder}/postings-{buckets}-{int(stem)}")
    if queries is not None:
        wanted = query_keywords(queries, stem).select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")).distinct()
        terms = terms.join(F.broadcast(wanted), "bucket", "left_semi")  # ``buckets`` rows at most
    return Index(spark.read.parquet(f"{folder}/passages"), terms, spark.read.parquet(f"{folder}/lengths"), stem)


def search_turns(
    turns: DataFrame, queries: DataFrame, now: F.Column, k: int = 5, uses: DataFrame | None = None, collapse: bool = True, stem: bool = False, index: Index | None = None, texts: bool = True
) -> DataFrame:
    """(qid, rank, id, score, text): the k best turns of each query; no text without ``texts``.

    Of the 200 best passages each is weighted by its turn's activation; a turn scores as its best passage and shows its
    three best in text order; byte-identical turns take one slot, before the cut to k. Texts come last, to what is shown.
    """
    index = index or build_index(turns, stem)
    parts = index.parts
    about = turns.select(F.col("id").alias("turn_id"), "ts", F.min("id").over(Window.partitionBy(F.trim("text"))).alias("twin"))
    if uses is None:
        about = about.withColumn("uses", F.lit(0))
    else:
        about = about.join(uses.select(F.col("id").alias("turn_id"), "uses"), "turn_id", "left").fillna(0, ["uses"])
    weight = activation(age_days(F.col("ts"), now), F.col("uses"), TURN_DECAY, USE_WEIGHT)
    about = parts.select("key", "turn_id", "ord").join(about, "turn_id").select("key", "turn_id", "ord", "twin", weight.alias("weight"))
    pool = best_pool(*index.asked(queries), POOL_TURNS, about).select("qid", F.inline("pool")).select("qid", "key", "score", "about.*")
    hits = pool.withColumn("score", F.col("score") * F.col("weight")).repartition("qid")  # once, for all that follows
    best = Window.partitionBy("qid", "turn_id").orderBy(F.desc(F.round("score", 9)), "ord")
    hits = hits.withColumn("nth", F.row_number().over(best)).where("nth <= 3")
    found = hits.groupBy("qid", "turn_id").agg(F.max("score").alias("score"), F.collect_list("key").alias("keys"), F.first("twin").alias("twin"))
    if collapse:
        same = Window.partitionBy("qid", "twin").orderBy(F.desc(F.round("score", 9)), "turn_id")
        found = found.withColumn("copy", F.row_number().over(same)).where("copy = 1")
    ranked = top(found, k, key="turn_id").select("qid", F.col("place").alias("rank"), F.col("turn_id").alias("id"), "score", "keys")
    if not texts:
        return ranked.drop("keys")
    shown = ranked.withColumn("key", F.explode("keys")).join(parts.select("key", "ord", "text"), "key").groupBy("qid", "rank", "id", "score")
    shown = shown.agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("parts"))
    return shown.select("qid", "rank", "id", "score", joined_passages("parts").alias("text"))


def joined_passages(parts: str) -> F.Column:
    """Passages in text order, with a mark where one is left out between them."""
    return F.expr(f"""aggregate({parts}, CAST(struct(-1, '') AS struct<ord:int,text:string>),
        (a, x) -> struct(x.ord AS ord, IF(a.ord < 0, x.text, concat(a.text, IF(x.ord = a.ord + 1, '', ' … '), x.text)) AS text), a -> a.text)""")


def search_beliefs(
    beliefs: DataFrame, queries: DataFrame, now: F.Column, k: int = 10, passage_share: DataFrame | None = None, stem: bool = False, shown: DataFrame | None = None
) -> DataFrame:
    """(qid, rank, id, score): current committed beliefs. Statistics cover all beliefs, current or not; the filter and
    the subject rule come after scoring, the rule after the cut to 100, and so does ``shown`` (id), if given: others go."""
    text = beliefs.withColumn("key", F.col("id"))
    terms, lengths, keywords = asked_postings(text, {"subject": 3.0, "relation": 1.0, "value": 1.0}, "key", queries, stem)
    weight = activation(age_days(F.col("recorded_at"), now), F.col("use_count"), BELIEF_DECAY, USE_WEIGHT)
    current = beliefs.where("valid_to IS NULL AND status = 'committed'").select(F.col("id").alias("key"), "reliability", weight.alias("weight"), subject_terms("subject").alias("named"))
    if shown is None:
        current = current.withColumn("shown", F.lit(True))
    else:
        current = current.join(shown.select(F.col("id").alias("key"), F.lit(True).alias("shown")).distinct(), "key", "left")
    rows = best_pool(terms, lengths, keywords, POOL_BELIEFS, current if passage_share is not None else current.drop("named"))
    if passage_share is not None:
        rows = subject_ruled(rows, queries, passage_share)
    score = lambda x: x["score"] * x["about"]["reliability"] * x["about"]["weight"]
    weighed = F.transform(F.filter("pool", lambda x: x["about"]["shown"]), lambda x: placed(score(x), x["key"]))
    ranked = rows.select("qid", F.posexplode(F.slice(F.array_sort(weighed), 1, k)).alias("nth", "hit"))
    return ranked.select("qid", (F.col("nth") + 1).alias("rank"), F.col("hit.key").alias("id"), "hit.score")


def passage_shares(parts: DataFrame, stem: bool = False) -> DataFrame:
    """(term, share, n_passages): in what share of the passages a term occurs. With ``stem`` the vocabulary is of stems,
    which subject terms, themselves as written, are looked up in."""
    total = parts.agg(F.count(F.lit(1)).alias("n_passages"))
    own = parts.select("turn_id", "ord", F.explode(F.array_distinct(index_terms("text", stem))).alias("term"))
    return own.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("term", (F.col("n") / F.col("n_passages")).alias("share"), "n_passages")


def subject_rule(pairs: DataFrame, queries: DataFrame, shares: DataFrame, rare: float = 0.10, least: int = 1000) -> DataFrame:
    """(qid, key, shared, kept): two shared terms pass, none fails, one passes if rare or the index is small."""
    asked = queries.select("qid", subject_terms("text").alias("asked"))
    both = pairs.join(asked, "qid").withColumn("common", F.array_intersect(subject_terms("subject"), "asked"))
    both = both.withColumn("shared", F.size("common")).withColumn("term", F.element_at(F.when(F.col("shared") == 1, F.col("common")).otherwise(F.array(F.lit(None).cast("string"))), 1))
    small = shares.agg(F.coalesce(F.max("n_passages"), F.lit(0)).alias("all_passages"))
    rated = both.join(shares.select("term", "share"), "term", "left").join(F.broadcast(small))
    lone = (F.coalesce("share", F.lit(0.0)) <= rare) | (F.col("all_passages") < least)
    return rated.select("qid", "key", "shared", ((F.col("shared") >= 2) | ((F.col("shared") == 1) & lone)).alias("kept"))


def subject_ruled(pools: DataFrame, queries: DataFrame, shares: DataFrame, rare: float = 0.10, least: int = 1000) -> DataFrame:
    """(qid, pool) with the members that ``subject_rule`` keeps, told by their ``about.named``: within each row, since pairs
    would be a hundred times the queries. Only terms over ``rare`` are looked up: a passage's terms by 1/rare at most."""
    often = shares.agg(F.collect_list(F.when(F.col("share") > rare, F.col("term"))).alias("often"), F.coalesce(F.max("n_passages"), F.lit(0)).alias("all_passages"))
    asked = queries.select(F.col("qid").alias("q"), subject_terms("text").alias("asked")).where("asked IS NOT NULL").join(F.broadcast(often))  # one row
    lone = F.when(F.col("all_passages") < least, F.array().cast("array<string>")).otherwise(F.array_intersect("asked", "often"))
    asked = asked.select("q", F.struct("asked", lone.alias("often")).alias("a")).groupBy("q").agg(F.collect_list("a").alias("asks"))
    kept = """filter(pool, x -> exists(asks, a -> size(array_intersect(x.about.named, a.asked)) >= 2
        OR (size(array_intersect(x.about.named, a.asked)) = 1 AND size(array_intersect(x.about.named, a.often)) = 0)))"""
    return pools.join(asked, F.col("qid").eqNullSafe(F.col("q"))).select("qid", F.expr(kept).alias("pool"))


def fuse(lists: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of (qid, list, rank, id, score): (qid, rank, id, fused, score), the id's own best score kept."""
    sums = lists.groupBy("qid", "id").agg(F.sum(1 / (60 + F.col("rank"))).alias("fused"), F.max("score").alias("score"), F.min("rank").alias("best"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("fused", 12)), "best", "id")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "fused", "score")


def fuse_texts(lists: DataFrame, k: int) -> DataFrame:
    """As ``fuse``, of lists with text: of hits whose trimmed text is the same only the best stays, before the cut to k."""
    every = fuse(lists, 1 << 30).withColumnRenamed("rank", "at").join(lists.groupBy("qid", "id").agg(F.min(F.trim("text")).alias("text")), ["qid", "id"])
    same = Window.partitionBy("qid", "text").orderBy("at")
    once = every.withColumn("copy", F.row_number().over(same)).where("copy = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at")))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "id", "fused", "score")


def subject_pairs(subjects: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, key, subject): queries and subjects (key, subject) that share a term, by equality of terms."""
    asked = queries.select("qid", F.explode(subject_terms("text")).alias("term"))
    named = subjects.select("key", "subject", F.explode(subject_terms("subject")).alias("term"))
    return named.join(asked, "term").select("qid", "key", "subject").distinct()


def everything(beliefs: DataFrame, turns: DataFrame) -> DataFrame:
    """One result (kind, qid, rank, id, score, text): belief hits, then turn hits, each with ranks of its own."""
    rows = beliefs.withColumn("kind", F.lit("belief")).unionByName(turns.withColumn("kind", F.lit("turn")), allowMissingColumns=True)
    return rows.select("kind", *[c for c in rows.columns if c != "kind"])


def read_window(turns: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """Turns of an anchor's session whose seq lies within the window; the window is over seq, not rows."""
    a = anchors.select(F.col("session"), F.col("seq").alias("anchor"))
    near = turns.join(a, "session").where(F.col("seq").between(F.col("anchor") - window, F.col("anchor") + window))
    return near.select("session", "anchor", "id", "seq", "role")


def first_prompts(turns: DataFrame) -> DataFrame:
    """(session, id): the first user turn, else the first turn; unknown times last."""
    order = Window.partitionBy("session").orderBy(F.col("role") != "user", F.col("ts").asc_nulls_last(), "id")
    return turns.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("session", "id")


def identical_turns(turns: DataFrame) -> DataFrame:
    """(id, copies): the first turn of each trimmed text and how many share it."""
    return turns.groupBy(F.trim("text").alias("t")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "copies")
