import json

import pytest
from pyspark.sql import functions as F

from tessel.functions.json_repair import first_valid, parse_object
from tessel.operators import agent, benchmark


def test_json_repair():
    assert parse_object('```json\n{"a": [1, 2,],}\n```') == {"a": [1, 2]}
    assert parse_object('Answer: {"a": 1} and so on') == {"a": 1}
    for broken in ('{"queries": ["x", {"filters": {"a": 1}}', "none", "[1]"):
        with pytest.raises(ValueError):
            parse_object(broken)

    def needs_task(m):
        return m["task"]

    assert first_valid({"plan": [{"x": 1}, {"task": "risk"}]}, needs_task) == "risk"
    with pytest.raises(KeyError):
        first_valid({"plan": []}, needs_task)


def test_plans():
    plan = agent.Plan.of({"task": "case_search", "queries": " q ", "filters": {"source_types": ["web", "law"]}, "exact_citations": [{"doc_id": "d", "local_citation": "Article 1"}, {"doc_id": "d"}]})
    assert plan.queries == ["q"] and plan.source_types == ["law", "case"] and plan.citations == [("d", "Article 1")]
    assert agent.Plan.of({"task": "risk", "queries": list("abcdefghijk")}).queries == list("abcdefgh")
    for bad in ({"task": "x", "queries": ["q"]}, {"task": "risk", "queries": [" "]}):
        with pytest.raises(ValueError):
            agent.Plan.of(bad)
    merged = plan.merged(agent.Plan.of({"task": "compare", "queries": ["r", "q"]}))
    assert merged.queries == ["q", "r"] and merged.task == "compare"
    found = agent.searches(agent.Plan.of({"task": "risk", "queries": ["q"], "filters": {"doc_ids": ["d"]}}), 3)
    assert [(s["source"], s["doc_ids"], s["limit"]) for s in found] == [("law", ["d"], 12), ("case", [], 12), ("law", ["d"], 12)]


def _loop(grades, **more):
    seen = []
    loop = agent.Loop(
        plan=lambda request, before, gaps: {"task": "compare", "queries": [f"q{len(seen)}"]},
        retrieve=lambda plan, k: seen.append(list(plan.queries)) or [{"evidence_id": "case:1"}],
        pack=lambda items, expanded: [{**i, "is_truncated": i["evidence_id"] not in expanded, "expanded": sorted(expanded)} for i in items],
        grade=lambda request, plan, packed: grades.pop(0),
        answer=lambda request, plan, packed: {"answer": "a", "findings": [{"statement": "s", "evidence_ids": ["case:1", "case:9"]}, {"statement": "t", "evidence_ids": ["x"]}]},
        **more,
    )
    return loop, seen


def test_loop_expands_plans_again_and_ends():
    loop, seen = _loop([{"status": "context_gap", "requested_evidence_ids": ["case:1"]}, {"status": "sufficient"}])
    out = loop.run("request")
    assert out["evidence"][0]["expanded"] == ["case:1"] and len(seen) == 1 and out["findings"] == [{"statement": "s", "evidence_ids": ["case:1"]}]
    loop, seen = _loop([{"status": "context_gap", "requested_evidence_ids": ["case:7"]}, {"status": "retrieval_gap"}])
    assert loop.run("request", reference_only=True)["reference_only"] and seen == [["q0"], ["q0", "q1"]]
    with pytest.raises(ValueError):
        _loop([], most=4)
    with pytest.raises(ValueError):
        loop.run(" ")


def test_risk_grades_need_grounded_disjoint_roles():
    plan = agent.Plan.of({"task": "risk", "queries": ["q"]})
    cover = {r: {"satisfied": True, "evidence_ids": i} for r, i in zip(agent.ROLES, (["law_unit:1"], ["case:1"], ["law_unit:1"]), strict=True)}
    kinds = {"law_unit:1": "law_unit", "case:1": "case"}
    assert agent.checked_grade({"status": "sufficient", "coverage": cover}, plan, kinds, [])["status"] == "retrieval_gap"
    kinds["law_unit:2"] = "law_unit"
    cover["supplementary_obligations"]["evidence_ids"] = ["law_unit:2"]
    assert agent.checked_grade({"status": "sufficient", "coverage": cover}, plan, kinds, [])["sufficient"]


GOOD = {"id": "s1", "split": "dev", "task": "risk", "query": "q", "language": "en", "difficulty": "easy", "retrieval_k": 5, "relevance": [{"evidence_id": "case:1", "grade": 3, "required": True}], "coverage_groups": [{"name": "g", "evidence_ids": ["case:1"], "min_hits": 1}], "annotation": {"status": "gold", "reviewer": "r", "reviewed_at": "2025-01-02"}}


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({}, None),
        ({"split": "train"}, "split is unknown"),
        ({"retrieval_k": 51}, "retrieval_k is not 1 to 50"),
        ({"relevance": [{"evidence_id": "case:1", "grade": 4, "required": True}]}, "a grade is not 1 to 3"),
        ({"relevance": [{"evidence_id": "case:1", "grade": 1, "required": False}]}, "a coverage group of one is not required"),
        ({"coverage_groups": [{"name": "g", "evidence_ids": ["case:2", "case:1"], "min_hits": 1}]}, "a coverage group is unjudged"),
        ({"annotation": {"status": "gold", "reviewer": "r", "reviewed_at": "soon"}}, "gold needs a date"),
    ],
)
def test_sample_checks(spark, tmp_path, change, problem):
    path = tmp_path / "b.jsonl"
    path.write_text(json.dumps(GOOD | change) + "\n")
    if problem is None:
        samples = benchmark.load(spark, str(path))
        assert samples.count() == 1 and {r["n"] for r in benchmark.counts(samples).collect()} == {1}
        index = spark.createDataFrame([("case:1", "long text")], "evidence_id string, text string")
        assert benchmark.unknown_ids(samples, index).count() == 0 and benchmark.unknown_ids(samples, index.where(F.lit(False))).count() == 1
        rows = benchmark.annotation_rows(samples, index, 4)
        assert len(rows.columns) == 7 and rows.first()["text"] == "long"
    else:
        with pytest.raises(Exception, match=f"b.jsonl:1: {problem}"):
            benchmark.load(spark, str(path)).collect()


def test_results_prefer_success(spark, tmp_path):
    lines = [{"id": "a", "evidence": [{"evidence_id": "x"}, {"evidence_id": " "}]}, {"id": "a", "error": {"type": "T", "message": "m"}}, {"id": "b", "error": {"type": "T"}}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {r["id"]: (r["ranking"], r["failed"]) for r in benchmark.results(spark, str(tmp_path / "r.jsonl")).collect()}
    assert got == {"a": (["x"], False), "b": ([], True)}
