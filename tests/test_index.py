import json

import pytest
from pyspark.sql import functions as F

from tessel.functions.passages import Budget, pack
from tessel.plans.index import Index, build, hash_embedder

LONG = "Processing is lawful only if consent was given for the purpose. " * 12


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    law = lambda i, title: {"doc_id": i, "title": title, "jurisdiction": "EU" if i == "gdpr" else "CN", "language": "en", "raw_text": "secret"}
    unit = lambda i, doc, parent, kind, cited, text, now=True: {"unit_id": i, "source_doc_id": doc, "parent_id": parent, "unit_type": kind, "canonical_citation": f"{doc} {cited}", "local_citation": cited, "text": text, "jurisdiction": "EU" if doc == "gdpr" else "CN", "law_name": doc, "is_current": now}
    rows = {
        "laws": [law("gdpr", "GDPR"), law("pipl", "PIPL")],
        "legal_units": [unit("u6", "gdpr", None, "article", "Article 6", LONG), unit("u6x", "gdpr", "u6", "paragraph", "Article 6(1)", "old", False), unit("p13", "pipl", None, "article", "第十三条", "handling personal information")],
        "gdprhub_cases": [{"case_id": "c1", "title": "AEPD (Spain) - N1", "country": "Spain", "jurisdiction": "ES", "case_number": "N1", "facts_text": "a cookie banner " * 20, "decision_text": "consent was missing " * 20, "industry": [{"industry": "retail"}], "categories": ["Spain"]}, {"case_id": "c2", "title": "empty", "facts_text": " "}],
        "case_law_relations": [{"case_id": "c1", "target_unit_id": "u6", "citation": "Article 6", "resolution_status": "resolved"}, {"case_id": "c1", "target_unit_id": None, "citation": "?", "resolution_status": "unresolved"}],
        "law_relations": [],
    }
    for name, own in rows.items():
        (at / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in own))
    meta = build(spark, str(at), f"{at}/index", hash_embedder(), "hash", 32, threshold=40, target=20, most=30, overlap=5)
    assert {k: meta[k] for k in ("laws", "units", "cases", "case_law", "vectors")} == {"laws": 2, "units": 2, "cases": 1, "case_law": 1, "vectors": 3} and meta["passages"] > 0
    return Index(spark, f"{at}/index", hash_embedder(), "hash")


def test_text_of_laws_is_left_out(index):
    assert "raw_text" not in index.table("laws").columns
    with pytest.raises(ValueError):
        Index(index.spark, index.table("laws").inputFiles()[0].split("/v-")[0], hash_embedder(), "other")


def test_exact(spark, index):
    asked = spark.createDataFrame([("r", "gdpr", "ARTICLE  6", 0), ("r", "gdpr", "Article 6", 1), ("r", "gdpr", "Article 61", 2)], "request_id string, doc_id string, wanted string, position int")
    assert [(r["unit_id"], r["position"]) for r in index.exact(asked).collect()] == [("u6", 0)]


def test_search_and_evidence(spark, index):
    got = index.search([("r", "cookie banner consent"), ("r", " "), ("s", "lawful processing")], limit=2)
    rows = {(r["request_id"], r["evidence_id"]): r for r in got.collect()}
    assert rows["r", "case:c1"]["rank"] == 1 and rows["s", "law_unit:u6"]["passages"] and len([k for k in rows if k[0] == "r"]) == 2
    spanish = index.search([("r", "consent")], (F.col("source_type") == "case") & (F.col("country") == "Spain"))
    assert [r["evidence_id"] for r in spanish.collect()] == ["case:c1"]
    assert index.search([("r", " ")]).count() == 0
    shown = {r["evidence_id"]: r for r in index.evidence(got.where("request_id = 's'"), True).collect()}
    assert shown["law_unit:u6"]["text"].endswith("…") or len(shown["law_unit:u6"]["text"]) <= 1000
    full = index.evidence(got, False)
    items = full.select("request_id", F.col("rank").alias("position"), "evidence_id", "source_type", "text", F.lit(False).alias("exact"), F.lit(False).alias("expanded"), F.col("passages").alias("matched"), F.col("all_passages").alias("passages"))
    packed = pack(items, Budget(total=150, reserve=20)).collect()
    assert {r["request_id"] for r in packed} == {"r", "s"} and all(sum(p["included_tokens"] for p in packed if p["request_id"] == q) <= 150 for q in "rs")


def test_related_and_catalogue(spark, index):
    assert [r["unit_id"] for r in index.related(spark.createDataFrame([("r", "c1")], "request_id string, case_id string"), 5).collect()] == ["u6"]
    assert [(r["title"], r["examples"]) for r in index.catalogue().collect()] == [("PIPL", {"article": "第十三条"}), ("GDPR", {"article": "Article 6"})]
    assert [tuple(r) for r in index.extent().collect()] == [(["Spain"], ["ES"], None, None)]
    with pytest.raises(ValueError, match="of 32 numbers"):
        Index(index.spark, index.table("laws").inputFiles()[0].split("/v-")[0], hash_embedder(16), "hash")
