"""Plans, grades and the bounded loop around retrieval; models are callables that a user brings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

#: Fixed values of plans and grades.
TASKS = ("exact_law", "case_search", "compare", "risk")
ROLES = ("applicable_law", "analogous_case", "supplementary_obligations")
STATUSES = ("sufficient", "context_gap", "retrieval_gap")
MOST_QUERIES, MOST_CITATIONS, MOST_ROLE_QUERIES = 8, 12, 4


def unique(values: Iterable | str | None, limit: int | None = None) -> list[str]:
    """Stripped texts, each once, in order; a bare text counts as one and anything that is no list as none."""
    values = [values] if isinstance(values, str) else values if isinstance(values, (list, tuple)) else []
    return list(dict.fromkeys(s for v in values if (s := str(v).strip())))[:limit]


@dataclass(frozen=True)
class Plan:
    task: str
    queries: list[str]
    source_types: list[str]
    jurisdictions: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    doc_ids: list[str] = field(default_factory=list)
    citations: list[tuple[str, str]] = field(default_factory=list)
    risk_queries: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: Mapping) -> Plan:
        """A checked plan: a known task and a query are needed; unknown sources go, none means both, a case search takes cases."""
        task, queries = raw.get("task"), unique(raw.get("queries"), MOST_QUERIES)
        if task not in TASKS:
            raise ValueError(f"unknown task {task!r}")
        if not queries:
            raise ValueError("a plan needs a query")
        filters = raw.get("filters") or {}
        sources = [s for s in unique(filters.get("source_types")) if s in ("law", "case")] or ["law", "case"]
        if task == "case_search" and "case" not in sources:
            sources.append("case")
        cited = [(str(c.get("doc_id") or "").strip(), str(c.get("local_citation") or "").strip()) for c in raw.get("exact_citations") or [] if isinstance(c, Mapping)]
        risk = raw.get("risk_queries") or {}
        return cls(task, queries, sources, unique(filters.get("jurisdictions")), unique(filters.get("countries")), unique(filters.get("doc_ids")), list(dict.fromkeys(c for c in cited if all(c)))[:MOST_CITATIONS], {r: unique(risk.get(r), MOST_ROLE_QUERIES) for r in ROLES})

    def merged(self, new: Plan) -> Plan:
        """The new plan with this one's queries and citations before its own."""
        risk = {r: unique([*self.risk_queries.get(r, []), *new.risk_queries.get(r, [])], 8) for r in ROLES}
        return Plan(new.task, unique([*self.queries, *new.queries], MOST_QUERIES), new.source_types, new.jurisdictions, new.countries, new.doc_ids, list(dict.fromkeys([*self.citations, *new.citations]))[:MOST_CITATIONS], risk)


def recall_limit(top_k: int) -> int:
    return max(4 * top_k, 20)


def risk_limit(top_k: int) -> int:
    return max(3 * top_k, 12)


def searches(plan: Plan, top_k: int, exact_found: bool = False) -> list[dict]:
    """The searches that a plan asks for (L5): risk has one for each role, an exact hit of an exact task has none."""
    if plan.task == "risk":
        sources = {"applicable_law": "law", "analogous_case": "case", "supplementary_obligations": "law"}
        return [{"role": r, "queries": plan.risk_queries.get(r) or plan.queries, "source": sources[r], "doc_ids": plan.doc_ids if sources[r] == "law" else [], "limit": risk_limit(top_k)} for r in ROLES]
    if plan.task == "exact_law" and exact_found:
        return []
    return [{"role": None, "queries": plan.queries, "source": s, "doc_ids": plan.doc_ids, "limit": recall_limit(top_k)} for s in plan.source_types]


def checked_grade(raw: Mapping, plan: Plan, evidence: Mapping[str, str], expandable: Sequence[str]) -> dict:
    """A grade whose ids are all of the evidence (id -> source type); a context gap without ids is a retrieval gap (L2)."""
    status = raw.get("status") if raw.get("status") in STATUSES else "sufficient" if raw.get("sufficient") is True else "retrieval_gap"
    asked = [i for i in unique(raw.get("requested_evidence_ids")) if i in evidence and i in expandable]
    if status == "context_gap" and not asked:
        status = "retrieval_gap"
    out = {"status": status, "gaps": unique(raw.get("gaps")), "requested_evidence_ids": asked if status == "context_gap" else []}
    if plan.task == "risk":
        cover, used = {}, set()
        for role in ROLES:
            item = (raw.get("coverage") or {}).get(role) or {}
            kind = "case" if role == "analogous_case" else "law_unit"
            ids = [i for i in unique(item.get("evidence_ids")) if evidence.get(i) == kind and i not in used]
            used.update(i for i in ids if kind == "law_unit")
            cover[role] = {"satisfied": bool(item.get("satisfied")) and bool(ids), "evidence_ids": ids, "gap": str(item.get("gap") or "")}
        out["coverage"] = cover
        if status == "sufficient" and not all(c["satisfied"] for c in cover.values()):
            out["status"] = "retrieval_gap"
    out["sufficient"] = out["status"] == "sufficient"
    return out


def checked_answer(raw: Mapping, evidence: Iterable[str]) -> dict:
    """An answer whose findings keep known ids only; a finding without any goes (L3)."""
    known, findings = set(evidence), []
    for f in raw.get("findings") or []:
        ids = [i for i in unique(f.get("evidence_ids")) if i in known] if isinstance(f, Mapping) else []
        if ids:
            findings.append({"statement": str(f.get("statement") or ""), "evidence_ids": ids})
    return {"answer": str(raw.get("answer") or ""), "findings": findings, "limitations": unique(raw.get("limitations"))}


@dataclass
class Loop:
    """plan -> retrieve -> pack -> grade, then expand, plan again, answer or end; at most `most` further rounds (L4).

    retrieve(plan, top_k) -> items, pack(items, expanded) -> packed evidence; both work on DataFrames behind these names
    or on lists. The models are plan(request, before, gaps), grade(request, plan, packed) and answer(request, plan, packed).
    """

    plan: Callable[[str, Plan | None, list[str]], Mapping]
    retrieve: Callable[[Plan, int], list[dict]]
    pack: Callable[[list[dict], set[str]], list[dict]]
    grade: Callable[[str, Plan, list[dict]], Mapping]
    answer: Callable[[str, Plan, list[dict]], Mapping]
    most: int = 1

    def __post_init__(self) -> None:
        if not 0 <= self.most <= 3:
            raise ValueError("a loop has 0 to 3 further rounds")

    def run(self, request: str, top_k: int = 10, reference_only: bool = False) -> dict:
        if not request.strip() or not 1 <= top_k <= 50:
            raise ValueError("a request needs a text and 1 to 50 results")
        plan, round_, expanded = Plan.of(self.plan(request, None, [])), 0, set()
        items = self.retrieve(plan, top_k)
        while True:
            packed = self.pack(items, expanded)
            kinds = {p["evidence_id"]: p["evidence_id"].split(":", 1)[0] for p in packed}
            grade = checked_grade(self.grade(request, plan, packed), plan, kinds, [p["evidence_id"] for p in packed if p.get("is_truncated")])
            if grade["sufficient"] or round_ >= self.most:
                break
            round_ += 1
            if grade["status"] == "context_gap":
                expanded |= set(grade["requested_evidence_ids"])
            else:
                plan = plan.merged(Plan.of(self.plan(request, plan, grade["gaps"])))
                items = self.retrieve(plan, top_k)
        if reference_only:
            return {"reference_only": True, "evidence": packed}
        return {**checked_answer(self.answer(request, plan, packed), kinds), "task": plan.task, "plan": plan, "evidence": packed, "evidence_grade": grade}
