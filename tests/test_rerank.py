import pytest
from pyspark.sql import functions as F

from tessel.operators import benchmark, evaluation, integrity, rerank as R


def _candidates(spark, n=6):
    return spark.createDataFrame([(r, f"e{i}", i + 1, "law_unit" if i % 2 else "case", ["applicable_law"] if i == 1 else [] if i == 3 else ["x"], "q", "t" * (n - i)) for r in ("a", "b") for i in range(n)], "request_id string, evidence_id string, rank int, source_type string, roles array<string>, query string, text string")


def test_rerank(spark):
    df = _candidates(spark)
    of = lambda out: [(r["evidence_id"], r["rank"]) for r in out.where("request_id = 'a'").orderBy("rank").collect()]
    best = R.rerank(df, ["request_id"], "rank", "evidence_id", lambda q, texts: [-float(len(t)) + 10 for t in texts], query="query", text="text", top_n=3)
    assert of(best) == [("e5", 1), ("e4", 2), ("e3", 3)] and [r["score"] for r in best.where("request_id = 'b'").orderBy("rank").collect()] == [9.0, 8.0, 7.0]
    assert of(R.rerank(df, ["request_id"], "rank", "evidence_id", lambda q, t: [1.0] * len(t), query="query", text="text", top_n=2)) == [("e0", 1), ("e1", 2)]
    assert of(R.rerank(df, ["request_id"], "rank", "evidence_id", lambda q, t: [float(len(x)) for x in t], query="query", text="text", top_n=9, least=5)) == [("e0", 1), ("e1", 2)]
    assert of(R.rerank(df, ["request_id"], "rank", "evidence_id", None, query="query", text="text", top_n=2)) == [("e0", 1), ("e1", 2)]
    assert R.rerank(df, ["request_id"], "rank", "evidence_id", None, query="query", text="text", top_n=0).count() == 0
    for bad in (dict(score=lambda q, t: [1.0], most=200), dict(score=lambda q, t: [1.0] * len(t), most=3)):
        with pytest.raises(Exception, match="another number|more than 3"):
            R.rerank(df, ["request_id"], "rank", "evidence_id", bad["score"], query="query", text="text", top_n=3, most=bad["most"]).collect()
    assert (R.rerank_limit("risk", 3, 100), R.rerank_limit("compare", 9, 12), R.rerank_limit("exact_law", 4, 100), R.role_rerank_limit(2, 100), R.role_rerank_limit(4, 9)) == (10, 12, 4, 8, 9)


def test_roles_and_promotion(spark):
    df = _candidates(spark)
    assert [r["evidence_id"] for r in R.role_candidates(df, "applicable_law").where("request_id = 'a'").orderBy("rank").collect()] == ["e1", "e3"]
    assert [r["evidence_id"] for r in R.role_candidates(df, "analogous_case").collect()] == []
    exact = spark.createDataFrame([("a", "z", 1), ("a", "e2", 0), ("a", "y", 5)], "request_id string, evidence_id string, exact_rank int")
    got = R.promote_exact(df.where("request_id = 'a'"), exact, ["request_id"], "evidence_id", "rank", 4).orderBy("rank").collect()
    assert [r["evidence_id"] for r in got] == ["e2", "z", "e0", "e1", "e3", "e4", "e5"]
    assert R.promote_exact(df.where("request_id = 'a'"), exact, ["request_id"], "evidence_id", "rank", 1).orderBy("rank").first()["evidence_id"] == "e2"
    assert R.with_role(df, "new").first()["roles"] == ["x", "new"] and R.with_role(df.drop("roles"), None).first()["roles"] == []


def test_risk_selection_takes_the_fallback_last(spark):
    ranked = lambda ids: spark.createDataFrame([("a", x, i + 1) for i, x in enumerate(ids)], "request_id string, evidence_id string, rank int")
    got = R.risk_selection({"applicable_law": ranked(["l1", "l2", "l3"]), "analogous_case": ranked(["c1"]), "supplementary_obligations": ranked(["l1", "s1"])}, ranked(["f1", "c1", "f2"]), ["request_id"], "evidence_id", "rank", {"applicable_law": 2, "analogous_case": 1, "supplementary_obligations": 1}, 7)
    assert [(r["evidence_id"], r["role"]) for r in got.orderBy("position").collect()] == [("l1", "applicable_law"), ("c1", "analogous_case"), ("s1", "supplementary_obligations"), ("l2", "applicable_law"), ("l3", "applicable_law"), ("f1", None), ("f2", None)]


def test_texts(spark):
    row = spark.createDataFrame([("T", None, "EU", "", "body", "q", ["a", "b"], "case", " ", "N 1", "c:1")], "title string, citation string, jurisdiction string, country string, text string, query string, queries array<string>, source_type string, ecli string, number string, id string")
    out = row.select(
        R.rerank_text(*(F.col(c) for c in ("title", "citation", "jurisdiction", "country", "text"))).alias("a"), R.rerank_query(F.col("query"), F.lit("case_search")).alias("b"), R.rerank_query(F.col("query"), F.lit("compare")).alias("c"),
        R.role_query(F.col("query"), "analogous_case", F.col("queries")).alias("d"), R.shown_to_model(row).alias("e"), R.review_text(*(F.col(c) for c in ("source_type", "title", "citation", "ecli", "number", "id", "jurisdiction", "text"))).alias("f"),
    ).first()
    assert out["a"] == "T | EU\nbody" and out["b"].endswith("provisions.\nUser query: q") and out["c"] == "q" and out["d"].endswith("- a\n- b\nOriginal user scenario: q")
    assert list(__import__("json").loads(out["e"])) == list(R.MODEL_KEYS) and out["f"] == "标题：T\n引用：N 1\n法域：EU\n\nbody"


def test_empty_rankings_count(spark):
    truth = spark.createDataFrame([(s, "x", 3, True) for s in ("a", "b", "c")], "sample_id string, item_id string, grade int, required boolean")
    ranks = spark.createDataFrame([("a", "x", 1)], "sample_id string, item_id string, rank int")
    answered = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    got = {r["sample_id"]: (r["recall"], r["mrr"], r["precision"], r["required_recall"], r["ndcg"]) for r in evaluation.metrics(truth, ranks, [5], answered=answered).collect()}
    assert got == {"a": (1, 1, 1, 1, 1), "b": (0, 0, 0, 0, 0)}
    results = spark.createDataFrame([("a", False), ("b", True), ("z", False)], "sample_id string, failed boolean")
    assert sorted((r["sample_id"], r["why"]) for r in evaluation.unscored(truth.select("sample_id"), results).collect()) == [("b", "failed"), ("c", "missing"), ("z", "extra")]


def test_runs_resume_and_csv(spark, tmp_path):
    samples = spark.createDataFrame([("s1", "q", "risk", "dev"), ("s2", "q", "risk", "test"), ("s3", "q", "compare", "dev")], "id string, query string, task string, split string")
    assert [r["id"] for r in benchmark.selected(samples, "risk", None, 1).collect()] == ["s1"] and benchmark.selected(samples, None, "dev").count() == 2
    at = f"{tmp_path}/runs"
    fails = {"s2"}

    def ask(sample):
        if sample["id"] in fails:
            raise ValueError("no")
        return {"evidence": [{"evidence_id": f"e-{sample['id']}"}]}

    assert benchmark.run_samples(spark, samples, ask, at) == 3
    fails.clear()
    assert benchmark.run_samples(spark, samples, ask, at) == 1 and benchmark.run_samples(spark, samples, ask, at) == 0
    assert sorted((r["id"], r["ranking"], r["failed"]) for r in benchmark.results(spark, f"{at}/*.jsonl").collect()) == [(s, [f"e-{s}"], False) for s in ("s1", "s2", "s3")]
    assert benchmark.run_samples(spark, samples, ask, at, resume=False) == 3
    rows = spark.createDataFrame([("s1", "é,\n", "e1", None)], "sample_id string, query string, evidence_id string, text string")
    assert benchmark.write_annotation_csv(spark, rows, f"{tmp_path}/a.csv") == 1
    assert (tmp_path / "a.csv").read_bytes() == "﻿sample_id,query,evidence_id,text\ns1,\"é,\n\",e1,\n".encode()


def test_law_report(spark):
    docs = spark.createDataFrame([("a", "current", "one two"), ("b", "2020", " "), ("china_pipl_2021", "2021", "x")], "doc_id string, version_date string, raw_text string")
    units = spark.createDataFrame([("a:1", "a", None, "article", "one"), ("a:2", "a", "a:9", "point", "two three"), ("p:1", "china_pipl_2021", None, "article", "x")], "unit_id string, source_doc_id string, parent_id string, unit_type string, text string")
    got = {r["doc_id"]: r for r in integrity.law_report(docs, units).collect()}
    assert got["a"]["issues"] == ["missing_parent_unit", "normalized_or_composed_unit_text", "version_not_date_pinned"] and got["a"]["exact_anchor_ratio"] == 0.5 and got["a"]["type_counts"] == {"article": 1, "point": 1}
    assert got["b"]["issues"] == ["empty_source_text", "no_legal_units"] and got["china_pipl_2021"]["issues"] == ["primary_structure_count_mismatch"] and got["b"]["status"] == "warning"
