"""One object over a store's tables: recall, reading, beliefs, remembering, reviews, removal, reports.

Every method returns a DataFrame or a new Memory; nothing runs until the caller asks for rows, and nothing is changed in
place. Bounds on arguments are clamped, not refused, as callers are often programs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import belief_line, make_key, normalize
from .operators import gate, ledger, recall, repair, reports, upkeep
from .sources import transcripts
from .sources.model import NOW

POLICIES = ("auto", "gate", "await")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, int(value)))


@dataclass(frozen=True)
class Memory:
    """``turns``: id, session, seq, ts, role, text, source, entrypoint. ``assertions``: seq, subject, relation, value,
    valid_from, reliability, source. ``now`` as text."""

    spark: SparkSession
    turns: DataFrame
    assertions: DataFrame
    policy: str = "auto"
    now: str = NOW
    #: belief_id of beliefs that a person confirmed; belief_id, retracted_at, reason of retracted ones; package, version, path.
    confirmations: DataFrame | None = None
    retractions: DataFrame | None = None
    declared: DataFrame | None = None
    stem: bool = True

    def _now(self) -> F.Column:
        return F.lit(self.now).cast("timestamp_ntz")

    def _asked(self, queries: list[str]) -> DataFrame:
        """At most 16 phrasings, case-insensitive repeats once, in order."""
        once = list({q.lower(): q for q in reversed(queries)}.values())[::-1][:16]
        return self.spark.createDataFrame(list(enumerate(once)), "qid long, text string")

    # -- evidence -------------------------------------------------------------------------------------------------
    def recall(self, queries: list[str], k: int = 5) -> DataFrame:
        """Turns for one question in several phrasings, fused by reciprocal ranks: (rank, id, score, text)."""
        k = clamp(k, 1, 50)
        hits = recall.search_turns(self.turns, self._asked(queries), self._now(), max(k, 20), stem=self.stem)
        lists = hits.select(F.lit(0).alias("qid"), F.col("qid").alias("list"), "rank", "id", "score", "text")
        fused = recall.fuse_texts(lists, k).select("rank", "id", "score")
        texts = hits.groupBy("id").agg(F.max_by("text", "score").alias("text"))
        return fused.join(texts, "id").where(F.col("rank") <= k).select("rank", "id", "score", "text").orderBy("rank")

    def recall_beliefs(self, queries: list[str], k: int = 10, subject_rule: bool = False) -> DataFrame:
        shares = recall.passage_shares(recall.passage_table(self.turns), self.stem) if subject_rule else None
        return recall.search_beliefs(self.timeline(), self._asked(queries), self._now(), clamp(k, 1, 100), shares, self.stem)

    def recall_all(self, queries: list[str], k: int = 5) -> DataFrame:
        """Beliefs, then turns, in one result with kind."""
        beliefs = recall.search_beliefs(self.timeline(), self._asked(queries), self._now(), clamp(k, 1, 50), None, self.stem)
        lists = beliefs.select(F.lit(0).alias("qid"), F.col("qid").alias("list"), "rank", "id", "score")
        return recall.everything(recall.fuse(lists, clamp(k, 1, 50)), self.recall(queries, k).withColumn("qid", F.lit(0)))

    def read_session(self, session: str, anchor: int | None = None, window: int = 5) -> DataFrame:
        own = self.turns.where(F.col("session") == session)
        if anchor is not None:
            window = clamp(window, 0, 50)
            own = own.where(F.col("seq").between(anchor - window, anchor + window))
        return own.select("id", "seq", "ts", "role", "text").orderBy("seq")

    # -- beliefs --------------------------------------------------------------------------------------------------
    def accepted(self) -> DataFrame:
        """Assertions that the policy lets into the timeline."""
        if self.policy == "auto":
            return self.assertions
        outcomes = (ledger.gated_outcomes if self.policy == "gate" else ledger.awaited_outcomes)(self.assertions)
        return self.assertions.join(outcomes.where("outcome <> 'pending_review'").select("seq"), "seq", "left_semi")

    def timeline(self) -> DataFrame:
        """The beliefs with confirmed; those that were retracted end where they began."""
        rows = ledger.timeline(self.accepted())
        if self.retractions is not None:
            gone = self.retractions.select(F.col("belief_id").alias("id"), F.lit(True).alias("gone")).distinct()
            rows = rows.join(gone, "id", "left")
            ended = F.coalesce("gone", F.lit(False))
            rows = rows.withColumns({"status": F.when(ended, "retracted").otherwise(F.col("status")), "valid_to": F.when(ended, F.col("valid_from")).otherwise(F.col("valid_to"))}).drop("gone")
        if self.confirmations is None:
            return rows.withColumn("confirmed", F.lit(False))
        return ledger.with_confirmations(rows, self.confirmations)

    def beliefs(self, subject: str | None = None, at: str | None = None) -> DataFrame:
        """Current beliefs, or those at a time; of one subject if given, compared as keys are."""
        rows = self.timeline()
        rows = ledger.as_of(rows, F.lit(at).cast("timestamp_ntz")) if at else ledger.current(rows)
        if subject is not None:
            rows = rows.where(normalize("subject") == normalize(F.lit(subject)))
        return rows.orderBy("subject", "relation")

    def history(self, subject: str, relation: str) -> DataFrame:
        key = make_key("s", "r")
        wanted = self.spark.createDataFrame([(subject, relation)], "s string, r string").select(key.alias("key"))
        rows = self.timeline().join(F.broadcast(wanted), "key", "left_semi")  # one row
        if self.retractions is not None:
            rows = ledger.history(rows, self.retractions)
        return rows.orderBy("valid_from", "id")

    def retract(self, reasons: dict[int, str]) -> tuple[Memory, DataFrame]:
        """With current beliefs retracted by id, and the plan; nothing is reopened."""
        named = self.spark.createDataFrame(list(reasons.items()), "id long, reason string")
        plan = ledger.belief_retraction(self.timeline(), named)
        new = plan.select(F.col("id").alias("belief_id"), self._now().alias("retracted_at"), "reason")
        return replace(self, retractions=new if self.retractions is None else self.retractions.unionByName(new)), plan

    def unindex(self, sources: list[str]) -> Memory:
        """Without the turns of some sources; beliefs stay."""
        return replace(self, turns=upkeep.unindexed(self.turns, self.spark.createDataFrame([(s,) for s in sources], "source string")))

    def stale(self) -> DataFrame:
        """Current beliefs that no prompt gets, with the reason and every test."""
        return self.explain().where("reason IS NOT NULL")

    def explain(self) -> DataFrame:
        none = self.spark.createDataFrame([], "package string, version string, path string")
        return gate.explain(ledger.current(self.timeline()), none if self.declared is None else self.declared, self._now())

    def remember(self, facts: DataFrame) -> Memory:
        """With more assertions; seq, valid_from, reliability and source may be missing."""
        last = self.assertions.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
        own = facts if "seq" in facts.columns else facts.withColumn("seq", F.monotonically_increasing_id() + 1).join(F.broadcast(last)).withColumn("seq", F.col("seq") + F.col("last")).drop("last")
        for name, value in (("valid_from", self._now()), ("reliability", F.lit(0.9)), ("source", F.lit("user"))):
            own = own if name in own.columns else own.withColumn(name, value)
        return replace(self, assertions=self.assertions.unionByName(own.select(*self.assertions.columns)))

    def pending_reviews(self) -> DataFrame:
        return ledger.reviews(self.assertions)

    def decide(self, decisions: DataFrame) -> DataFrame:
        return ledger.decide(self.pending_reviews(), self.assertions, decisions)

    def review_items(self) -> DataFrame:
        """Open reviews with both sides, for a person to decide on."""
        return ledger.review_items(self.pending_reviews(), self.assertions)

    def decide_inbox(self, path: str) -> DataFrame:
        """What the decisions in an inbox of JSON lines come to; decisions on no open review are passed over."""
        return self.decide(transcripts.read_decisions(self.spark, path))

    # -- removal --------------------------------------------------------------------------------------------------
    def prune(self, doomed: F.Column) -> tuple[Memory, DataFrame]:
        """Without the doomed turns, and the plan: sessions touched, emptied sessions' beliefs retracted and repaired."""
        kept = self.turns.where(~F.coalesce(doomed, F.lit(False)))
        beliefs = self.timeline()
        gone = repair.orphaned(beliefs, kept).join(repair.orphaned(beliefs, self.turns).select("id"), "id", "left_anti").select("id")
        return replace(self, turns=kept), repair.repairs(beliefs, gone)

    def redact(self, secret: str) -> DataFrame:
        return repair.redact_plan(self.timeline(), secret)

    def redacted_reviews(self, secret: str) -> DataFrame:
        """Reviews that a redaction closes."""
        return ledger.close_reviews(self.pending_reviews(), self.redact(secret).select("id"))

    # -- prompts and reports --------------------------------------------------------------------------------------
    def context(self, prompts: DataFrame, k: int = 6) -> DataFrame:
        """Lines of current, durable beliefs for each prompt (qid, text) that a person typed: the hundred best that pass the
        subject rule, then the gate, then the first ``k``."""
        asked = upkeep.typed(prompts)
        k, beliefs = clamp(k, 1, 20), self.timeline()
        open_ = self.explain().where("reason IS NULL").select("id")
        hits = recall.search_beliefs(beliefs, asked, self._now(), k, recall.passage_shares(recall.passage_table(self.turns), self.stem), self.stem, open_)
        return reports.first_lines(hits, ledger.current(beliefs), k)

    def project_digest(self, folder: str, names: list[str], budget: int = 2000) -> DataFrame:
        """One row, text: the digest of a folder, and below it the beliefs about the project that the gate lets in."""
        open_ = self.explain().where("reason IS NULL").select("id")
        about = gate.project_beliefs(self.timeline(), names).join(open_, "id", "left_semi")
        line = belief_line("subject", "relation", "value", "recorded_at")
        kept = reports.budgeted(about.select(F.lit(0).alias("g"), "valid_from", "id", line.alias("line")), "g", "line", [F.desc("valid_from"), F.desc("id")], budget)
        told = kept.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("valid_from", "id", "line")), asc=False), lambda x: x["line"]), "\n").alias("beliefs"))
        return self.digest(folder, budget).join(F.broadcast(told)).select(F.trim(F.concat_ws("\n", "text", "beliefs")).alias("text"))  # one row each

    def digest(self, folder: str, budget: int = 2000) -> DataFrame:
        """One row, text: the folder's latest sessions with their first prompts, within a budget of characters."""
        first = reports.digest_sessions(self.turns, folder).join(self.turns.select(F.col("id").alias("first_id"), "text"), "first_id")
        line = F.concat(F.lit("- "), F.date_format("last_ts", "yyyy-MM-dd"), F.lit(" "), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 120))
        kept = reports.budgeted(first.select(F.lit(0).alias("g"), "last_ts", "session", line.alias("line")), "g", "line", [F.desc("last_ts"), "session"], budget)  # ten sessions at most
        ordered = F.sort_array(F.collect_list(F.struct("last_ts", "line")), asc=False)
        return kept.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))

    def stats(self) -> DataFrame:
        return reports.store_stats(self.turns, recall.passage_table(self.turns), self.timeline(), self.pending_reviews())

    def call(self, name: str, **given) -> DataFrame:
        """One of the calls that an agent's harness may make by name: recall, read, remember, beliefs. An unknown one is a
        KeyError; remember takes subject, relation and value, and shows what is then believed."""

        def remembered(subject: str, relation: str, value: str) -> DataFrame:
            facts = self.spark.createDataFrame([(subject, relation, value)], "subject string, relation string, value string")
            return self.remember(facts).beliefs(subject)

        calls = {"recall": self.recall_all, "read": self.read_session, "remember": remembered, "beliefs": self.beliefs}
        return calls[name](**given)
