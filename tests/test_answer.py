import json

import pytest

from tessel.operators.agent import Loop, Plan
from tessel.plans.answer import Retriever
from tessel.plans.index import Index, build, hash_embedder
from tessel.sources.documents import source_documents
from tests.test_extract import UK


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("answers")
    rows = {
        "laws": [{"doc_id": d, "title": d.upper(), "jurisdiction": "EU"} for d in ("gdpr", "ai")],
        "legal_units": [{"unit_id": f"{d}{i}", "source_doc_id": d, "local_citation": f"Article {i}", "canonical_citation": f"{d} Article {i}", "text": t, "is_current": True, "jurisdiction": "EU"} for d, i, t in (("gdpr", 1, "consent for cookies"), ("gdpr", 2, "security of processing"), ("ai", 1, "prohibited practices"), ("ai", 2, "consent for biometric data"))],
        "gdprhub_cases": [{"case_id": f"c{i}", "title": f"Case {i}", "country": "Spain", "jurisdiction": "ES", "facts_text": t, "decision_text": "fined"} for i, t in ((1, "cookies without consent"), (2, "a data breach"), (3, "biometric data"))],
        "case_law_relations": [{"case_id": "c1", "target_unit_id": "gdpr1", "citation": "x", "resolution_status": "resolved"}, {"case_id": "c2", "target_unit_id": "gdpr2", "citation": "x", "resolution_status": "resolved"}],
        "law_relations": [],
    }
    for name, own in rows.items():
        (at / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in own))
    build(spark, str(at), f"{at}/index", hash_embedder(64), "hash", 64)
    return Index(spark, f"{at}/index", hash_embedder(64), "hash")


def _plan(task, **more):
    return Plan.of({"task": task, "queries": ["cookies consent"], **more})


def test_routing(index):
    ids = lambda plan, k=3, **r: [i["evidence_id"] for i in Retriever(index, **r).retrieve(plan, k)]
    exact = _plan("exact_law", exact_citations=[{"doc_id": "ai", "local_citation": "ARTICLE 2"}])
    found = Retriever(index).retrieve(exact, 3)
    assert [(i["evidence_id"], i["exact"], i["citation"]) for i in found] == [("law_unit:ai2", True, "ai Article 2")]
    compare = ids(_plan("compare"), 4)
    assert {"law_unit:gdpr1", "case:c1"} <= set(compare) and len(compare) == 4
    assert set(ids(_plan("compare", filters={"source_types": ["law"], "doc_ids": ["ai"]}), 4)) == {"law_unit:ai1", "law_unit:ai2"}
    assert ids(_plan("case_search", filters={"source_types": ["case"], "doc_ids": ["gdpr"]}), 2, score=lambda q, t: [float("ookie" in x) for x in t])[0] == "case:c1"
    assert "case:c3" in ids(_plan("case_search", filters={"source_types": ["case"], "doc_ids": ["nowhere"]}), 5)
    risk = ids(_plan("risk", risk_queries={"analogous_case": ["biometric"]}, exact_citations=[{"doc_id": "gdpr", "local_citation": "Article 2"}]), 4, score=lambda q, t: [float(len(x)) for x in t])
    assert risk[0] == "law_unit:gdpr2" and any(x.startswith("case:") for x in risk) and len(set(risk)) == 4


def test_the_whole_loop(index):
    own = Retriever(index)
    out = Loop(lambda request, before, gaps: {"task": "compare", "queries": [request]}, own.retrieve, own.pack, lambda request, plan, packed: {"status": "sufficient"}, lambda request, plan, packed: {"answer": "a", "findings": [{"statement": "s", "evidence_ids": [packed[0]["evidence_id"], "no"]}]}).run("cookies", 3)
    assert len(out["evidence"]) == 3 and out["findings"][0]["evidence_ids"] == [out["evidence"][0]["evidence_id"]] and all(p["text"] and p["title"] for p in out["evidence"])


def test_source_documents(spark, tmp_path):
    (tmp_path / "uk.xml").write_text(UK)
    (tmp_path / "a.txt").write_text("Article 1\nx")
    source = lambda doc, file: {"doc_id": doc, "jurisdiction": "J", "law_family": "uk_dpa", "source_type": "s", "title": doc.upper(), "version_date": "", "effective_date": "2020", "url": "u", "language": "en", "target_path": str(tmp_path / file)}
    rows = {r["doc_id"]: r for r in source_documents(spark, [source("uk", "uk.xml"), source("uk", "uk.xml"), source("a", "a.txt"), source("b", "none.txt"), source("us_ccpa_cpra_1798_100", "a.txt"), source("us_ca_ccpa_cpra_civ_1798_100_199", "a.txt")]).collect()}
    assert set(rows) == {"uk", "a", "us_ca_ccpa_cpra_civ_1798_100_199"} and rows["a"]["raw_text"] == "Article 1\nx" and rows["a"]["version_date"] is None
    assert rows["uk"]["section_titles"]["20"] == "Meaning of “court”" and rows["a"]["section_titles"] is None
    with pytest.raises(FileNotFoundError):
        source_documents(spark, [source("b", "none.txt")], require=True)
    with pytest.raises(Exception, match="conflicting rows for a"):
        source_documents(spark, [source("a", "a.txt"), {**source("a", "a.txt"), "title": "Z"}]).collect()
    assert source_documents(spark, [source("b", "none.txt")]).count() == 0
