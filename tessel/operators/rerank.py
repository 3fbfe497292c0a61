"""Second-stage ranking: texts and queries for a reranker, its scores, and the roles of a risk assessment."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines

#: The source type of each role's evidence.
ROLE_SOURCES = {"applicable_law": "law_unit", "analogous_case": "case", "supplementary_obligations": "law_unit"}
#: Wordings that the reranker is asked with.
CASE_SEARCH = "Retrieval task: case search. Rank factually matching case summaries before supporting legal provisions.\nUser query: "
RISK = "Retrieval task: legal risk assessment. Relevant evidence may cover the directly applicable law, analogous cases, and supplementary obligations.\nUser query: "
OBJECTIVES = {
    "applicable_law": "Rank provisions that directly govern the main alleged risk. Prefer the rule whose elements match the conduct over adjacent recitals, enforcement powers, or remedies.",
    "analogous_case": "Rank case summaries by material factual similarity: jurisdiction, actor or industry, conduct, data use, procedural posture, and outcome. Prefer a close factual analogue over a case that merely cites the same legal provision.",
    "supplementary_obligations": "Rank additional duties independently raised by the facts and needed for a complete assessment. Exclude duplicates of the primary governing rule and generic provisions without a concrete connection to the scenario.",
}
#: Keys of the evidence that a model is shown.
MODEL_KEYS = ("evidence_id", "source_type", "title", "citation", "jurisdiction", "country", "text", "source_url", "content_mode", "is_truncated", "original_tokens", "included_tokens", "omission_reason", "matched_passage_ids", "metadata")


def rerank_text(title: Column, citation: Column, jurisdiction: Column, country: Column, text: Column) -> Column:
    """What of an item the reranker reads: a line of its names, then its text."""
    return F.concat(lines(title, citation, jurisdiction, country, separator=" | "), F.lit("\n"), F.coalesce(text, F.lit("")))


def rerank_query(query: Column, task: Column) -> Column:
    """The request as the reranker is asked it."""
    return F.when(task == "case_search", F.concat(F.lit(CASE_SEARCH), query)).when(task == "risk", F.concat(F.lit(RISK), query)).otherwise(query)


def role_query(query: Column, role: str, queries: Column) -> Column:
    """The same for one role of a risk assessment, with that role's own queries as a list."""
    listed = F.array_join(F.transform(queries, lambda q: F.concat(F.lit("- "), q)), "\n")
    return F.concat(F.lit(f"Retrieval task: legal risk assessment.\nEvidence role: {role}.\nRanking objective: {OBJECTIVES[role]}\nRole-specific retrieval queries:\n"), listed, F.lit("\nOriginal user scenario: "), query)


def shown_to_model(evidence: DataFrame) -> Column:
    """An item as JSON with the keys that a model is shown; columns that evidence lacks are null."""
    have = set(evidence.columns)
    return F.to_json(F.struct(*(F.col(k) if k in have else F.lit(None).cast("string").alias(k) for k in MODEL_KEYS)), {"ignoreNullFields": "false"})


def review_text(source_type: Column, title: Column, citation: Column, ecli: Column, case_number: Column, case_id: Column, jurisdiction: Column, text: Column) -> Column:
    """An item as a reviewer reads it: a line for each name that it has, a blank line, its text (P16). Of a case the ECLI comes before its number and its id."""
    cited = F.when(source_type == "case", F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (ecli, case_number, case_id)))).otherwise(citation)
    named = lambda label, value: F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.concat(F.lit(f"{label}："), value))
    return F.concat(lines(named("标题", title), named("引用", cited), named("法域", jurisdiction)), F.lit("\n\n"), F.coalesce(text, F.lit("")))


def rerank_limit(task: str, top_k: int, candidates: int) -> int:
    """How many items the reranker returns (O2)."""
    return min(candidates, max(2 * top_k, 10)) if task != "exact_law" else top_k


def role_rerank_limit(quota: int, candidates: int) -> int:
    return min(candidates, max(3 * quota, 8))


def rerank(candidates: DataFrame, request: Sequence[str], rank: str, key: str, score: Callable[[str, list[str]], list[float]] | None, *, query: str, text: str, top_n: int, least: float = 0.0, most: int = 200) -> DataFrame:
    """The best top_n candidates of each request by a reranker's score, with `score` and a new rank; those under `least` go.

    score(query, texts) gives a number for each text, else it is an error. Without a scorer the first top_n stay as they are. A request's
    candidates are a ranking that its recall limit bounds; more than `most` of them is an error, as one call must hold them.
    """
    if top_n < 1:
        return candidates.where("false")
    order = Window.partitionBy(*request).orderBy(rank, key)
    if score is None:
        return candidates.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= top_n)
    grouped = candidates.groupBy(*request).agg(F.min(query).alias("_query"), F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")))).alias("_items"))
    held = F.when(F.size("_items") <= most, F.col("_items")).otherwise(F.raise_error(F.lit(f"a request has more than {most} candidates")))
    asked = grouped.select(*request, "_query", F.transform(held, lambda x: x["t"]).alias("_texts"), F.transform(held, lambda x: x["k"]).alias("_keys"))
    kinds = dict(candidates.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for q, texts in zip(b.column("_query").to_pylist(), b.column("_texts").to_pylist(), strict=True):
                got = [float(x or 0.0) for x in score(q or "", texts)] if texts else []
                if len(got) != len(texts):
                    raise ValueError("the reranker gave scores for another number of texts")
                scores.append(got)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*request, "_keys")), pa.array(scores, pa.list_(pa.float64()))], names=[*request, "_keys", "_scores"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in request)
    found = asked.mapInArrow(run, f"{schema}, _keys array<{kinds[key]}>, _scores array<double>")
    each = found.select(*request, F.explode(F.arrays_zip("_keys", "_scores")).alias("x")).select(*request, F.col("x._keys").alias(key), F.col("x._scores").alias("score")).where(F.col("score") >= least)
    ranked = candidates.drop("score").join(each, [*request, key])
    best = Window.partitionBy(*request).orderBy(F.col("score").desc(), F.col(rank), F.col(key))
    return ranked.withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= top_n)


def role_candidates(evidence: DataFrame, role: str, source_type: str = "source_type", roles: str = "roles") -> DataFrame:
    """Evidence that can serve a role: of the role's source type, and found for that role or for none in particular."""
    untagged = F.coalesce(F.size(roles), F.lit(0)) < 1
    return evidence.where((F.col(source_type) == ROLE_SOURCES[role]) & (untagged | F.array_contains(roles, role)))


def promote_exact(ranking: DataFrame, exact: DataFrame, request: Sequence[str], key: str, rank: str, quota: int) -> DataFrame:
    """A ranking led by its request's first min(quota, 2) exact hits, exact(request, key, exact_rank); every item once."""
    first = Window.partitionBy(*request).orderBy("exact_rank", key)
    lead = exact.withColumn("_lead", F.row_number().over(first)).where(F.col("_lead") <= min(quota, 2)).select(*request, key, "_lead")
    both = ranking.select(*request, key, rank).join(lead, [*request, key], "full_outer")
    order = Window.partitionBy(*request).orderBy(F.col("_lead").asc_nulls_last(), F.col(rank), F.col(key))
    return both.select(*request, key, F.row_number().over(order).alias(rank))


def with_role(evidence: DataFrame, role: str | None, roles: str = "roles") -> DataFrame:
    """Evidence tagged with the role it was found for, after those that it has (Q21)."""
    have = F.coalesce(F.col(roles), F.array().cast("array<string>")) if roles in evidence.columns else F.array().cast("array<string>")
    return evidence.withColumn(roles, F.array_distinct(F.concat(have, F.array(F.lit(role)))) if role else have)


def risk_selection(rankings: Mapping[str, DataFrame], fallback: DataFrame, request: Sequence[str], key: str, rank: str, quotas: Mapping[str, int], limit: int) -> DataFrame:
    """The roles' rankings merged by their quotas, then what they left, then the fallback list, each item once, cut at the limit."""
    from .ranking import quota_interleave

    every: DataFrame | None = None
    for role in quotas:
        part = rankings[role].select(*request, F.lit(role).alias("role"), key, rank)
        every = part if every is None else every.unionByName(part)
    merged = quota_interleave(every, list(request), "role", key, rank, dict(quotas), limit)
    rest = fallback.select(*request, key, rank).join(merged.select(*request, key), [*request, key], "left_anti").groupBy(*request, key).agg(F.min(rank).alias(rank))
    both = merged.select(*request, key, "role", F.lit(0).alias("_late"), F.col("position").alias("_at")).unionByName(rest.select(*request, key, F.lit(None).cast("string").alias("role"), F.lit(1).alias("_late"), F.col(rank).cast("int").alias("_at")))
    order = Window.partitionBy(*request).orderBy("_late", "_at", key)
    return both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select(*request, key, "role", "position")
