"""Answers to requests over an index: routing by task, second-stage ranking, evidence in budgets.

A plan's searches run as batches over the index; only what a request's limits let through comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.passages import Budget, Counter, pack_evidence
from ..operators import agent, rerank
from ..operators.ranking import priority_merge, reciprocal_rank_fusion, reserved_slot_merge, role_quotas
from ..operators.retrieval import candidate_filter
from .index import Index

KEYS = ("request_id", "evidence_id", "source_type", "record_id")
CYCLE = ("applicable_law", "analogous_case", "applicable_law", "supplementary_obligations")


class Retriever:
    """retrieve(plan, top_k) and pack(items, expanded) of the bounded loop over an index."""

    def __init__(self, index: Index, score: Callable[[str, list[str]], list[float]] | None = None, *, least: float = 0.0, budget: Budget = Budget(), counter: Counter = Counter()):
        self.index, self.score, self.least, self.budget, self.counter = index, score, least, budget, counter

    def _found(self, plan: agent.Plan, queries: list[str], sources: list[str], doc_ids: list[str], limit: int) -> DataFrame:
        """The diverse best documents of some sources: laws of the documents asked for, and cases that a law of them is applied in."""
        keep = candidate_filter(source_type=F.col("source_type"), jurisdiction=F.col("jurisdiction"), country=F.col("country"), date=F.col("decided_date"), source_types=sources, jurisdictions=plan.jurisdictions, countries=plan.countries)
        if not doc_ids:
            return self.index.search([("r", q) for q in queries], keep, limit)
        units = self.index.table("units").where(F.col("doc_id").isin(*doc_ids)).select(F.col("unit_id").alias("target_unit_id"))
        linked = self.index.table("case_law").join(units, "target_unit_id", "left_semi").select(F.col("case_id").alias("record_id")).distinct()
        own = self.index.table("vectors").where(F.col("doc_id").isin(*doc_ids)).select("record_id").unionByName(linked)
        return self.index.search([("r", q) for q in queries], keep, limit, among=own)

    def exact(self, plan: agent.Plan) -> DataFrame:
        """Units that the plan cites (Q2)."""
        cited = self.index.spark.createDataFrame([("r", d, c, i) for i, (d, c) in enumerate(plan.citations)], "request_id string, doc_id string, wanted string, position int")
        return self.index.exact(cited).select("request_id", F.concat(F.lit("law_unit:"), "unit_id").alias("evidence_id"), F.lit("law").alias("source_type"), F.col("unit_id").alias("record_id"), (F.col("position") + 1).alias("rank"))

    def retrieve(self, plan: agent.Plan, top_k: int) -> list[dict]:
        """Items of a plan in their final order, with title, citation, text and passages.

        An exact task that found its citation searches no further; a case search that its documents bind to nothing is made
        again without them; laws that the found cases apply are appended; a risk's roles have searches and shares of their own.
        """
        exact = self.exact(plan).persist()
        hit = exact.head(1)
        if plan.task == "risk":
            ranked = self._risk(plan, top_k, exact)
        else:
            parts = [exact.select(*KEYS, "rank")]
            if searches := agent.searches(plan, top_k, bool(hit)):
                limit = searches[0]["limit"]
                found = self._found(plan, plan.queries, plan.source_types, plan.doc_ids, limit)
                if plan.task == "case_search" and plan.doc_ids and not found.where("source_type = 'case'").head(1):
                    found = self._found(plan, plan.queries, plan.source_types, [], limit)
                parts.append(found.select(*KEYS, "rank"))
            cases = parts[-1] if len(parts) == 1 else self._union(parts[1:])
            related = self.index.related(cases.where("source_type = 'case'").select("request_id", F.col("record_id").alias("case_id")), 2 * top_k)
            parts.append(related.select("request_id", F.concat(F.lit("law_unit:"), "unit_id").alias("evidence_id"), F.lit("law").alias("source_type"), F.col("unit_id").alias("record_id"), "rank"))
            merged = priority_merge([p.select("request_id", "evidence_id", "rank") for p in parts], ["request_id"], "evidence_id", "rank", 10_000)
            every = self._union(parts).dropDuplicates(["request_id", "evidence_id"]).drop("rank").join(merged.select("request_id", "evidence_id", F.col("position").alias("rank")), ["request_id", "evidence_id"])
            ranked = self._second(every, plan, top_k)
        whole = self.index.evidence(ranked, False).orderBy("rank").collect()  # at most top_k items
        cited = {r["evidence_id"] for r in exact.collect()}
        exact.unpersist()
        return [{"evidence_id": r["evidence_id"], "source_type": r["source_type"], "title": r["title"], "citation": r["citation"], "text": r["text"], "exact": r["evidence_id"] in cited, "passages": [p.asDict() for p in r["all_passages"] or []], "matched": []} for r in whole]

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _texts(self, ranked: DataFrame, query: str) -> DataFrame:
        shown = self.index.evidence(ranked, True)
        none = F.lit(None).cast("string")
        return shown.withColumn("rerank_text", rerank.rerank_text(F.col("title"), F.col("citation"), none, none, F.col("text"))).withColumn("query", F.lit(query)).select(*KEYS, "rank", "query", "rerank_text")

    def _second(self, ranked: DataFrame, plan: agent.Plan, top_k: int) -> DataFrame:
        if self.score is None:
            return ranked.where(F.col("rank") <= top_k)
        query = " ".join(plan.queries)
        asked = self.index.spark.range(1).select(rerank.rerank_query(F.lit(query), F.lit(plan.task)).alias("q")).first()["q"]
        best = rerank.rerank(self._texts(ranked, asked), ["request_id"], "rank", "evidence_id", self.score, query="query", text="rerank_text", top_n=max(2 * top_k, 10), least=self.least, most=10_000)
        fused = reciprocal_rank_fusion(ranked.select("request_id", "evidence_id", "rank"), best.select("request_id", "evidence_id", "rank"), ["request_id"], "evidence_id", "rank")
        out = ranked.drop("rank").join(fused.select("request_id", "evidence_id", "rank"), ["request_id", "evidence_id"])
        if plan.task == "case_search":
            kept = reserved_slot_merge(out.select("request_id", "source_type", "evidence_id", "rank"), ["request_id"], "source_type", "case", "rank", "evidence_id", top_k, "law" in plan.source_types)
            return ranked.drop("rank").join(kept.select("request_id", "evidence_id", F.col("position").alias("rank")), ["request_id", "evidence_id"])
        return out.where(F.col("rank") <= top_k)

    def _risk(self, plan: agent.Plan, top_k: int, exact: DataFrame) -> DataFrame:
        quotas, rankings, every = role_quotas(top_k, agent.ROLES, CYCLE), {}, [exact.select(*KEYS, "rank")]
        for search in agent.searches(plan, top_k):
            role = search["role"]
            found = self._found(plan, search["queries"], [search["source"]], search["doc_ids"], search["limit"]).select(*KEYS, "rank")
            every.append(found)
            ranking = found.select("request_id", "evidence_id", "rank")
            if self.score is not None:
                asked = self.index.spark.range(1).select(rerank.role_query(F.lit(" ".join(plan.queries)), role, F.array(*map(F.lit, search["queries"]))).alias("q")).first()["q"]
                best = rerank.rerank(self._texts(found, asked), ["request_id"], "rank", "evidence_id", self.score, query="query", text="rerank_text", top_n=rerank.role_rerank_limit(quotas[role], search["limit"]), least=self.least, most=10_000)
                ranking = reciprocal_rank_fusion(ranking, best.select("request_id", "evidence_id", "rank"), ["request_id"], "evidence_id", "rank").select("request_id", "evidence_id", "rank")
            if role == "applicable_law":
                ranking = rerank.promote_exact(ranking, exact.select("request_id", "evidence_id", F.col("rank").alias("exact_rank")), ["request_id"], "evidence_id", "rank", quotas[role])
            rankings[role] = ranking
        whole = self._union(every)
        chosen = rerank.risk_selection(rankings, whole.select("request_id", "evidence_id", "rank"), ["request_id"], "evidence_id", "rank", quotas, top_k)
        return whole.drop("rank").dropDuplicates(["request_id", "evidence_id"]).join(chosen.select("request_id", "evidence_id", F.col("position").alias("rank")), ["request_id", "evidence_id"])

    def pack(self, items: list[dict], expanded: set[str]) -> list[dict]:
        """Items within the budget, those that were asked for again at length first (Q8)."""
        shown = {i["evidence_id"]: i for i in items}
        packed = pack_evidence([{**i, "expanded": i["evidence_id"] in expanded} for i in items], self.budget, self.counter)
        return [{**p, "title": shown[p["evidence_id"]]["title"], "citation": shown[p["evidence_id"]]["citation"]} for p in packed]
