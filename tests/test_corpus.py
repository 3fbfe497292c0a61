import json

import pytest

from tessel.__main__ import parser, run
from tessel.plans import corpus


@pytest.fixture()
def base(spark, tmp_path):
    rows = {
        "laws": [{"doc_id": "d1", "title": "One"}],
        "legal_units": [{"unit_id": "u1", "source_doc_id": "d1", "local_citation": "Article 1", "text": "é", "is_current": True}],
        "gdprhub_cases": [{"case_id": "c1", "title": "A - 1", "facts_text": "facts"}],
        "case_law_relations": [{"case_id": "c1", "target_unit_id": "u1", "citation": "x", "resolution_status": "resolved"}, {"case_id": "c1", "citation": "y", "resolution_status": "unresolved"}],
        "law_relations": [],
    }
    folder = tmp_path / "base"
    folder.mkdir()
    for name, own in rows.items():
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in own))
    return folder


def test_publish_validate_and_tamper(spark, base, tmp_path):
    new = {
        "laws": spark.createDataFrame([("d2", "Two")], "doc_id string, title string"),
        "legal_units": spark.createDataFrame([("u2", "d2", "Section 1", "t", True)], "unit_id string, source_doc_id string, local_citation string, text string, is_current boolean"),
    }
    out = tmp_path / "out"
    report = corpus.publish(spark, str(base), new, str(out))
    assert report["valid"], report
    assert report["counts"] == {"laws": 2, "legal_units": 2, "gdprhub_cases": 1, "case_law_relations": 2, "law_relations": 0}
    assert (out / "legal_units.jsonl").read_text().count("\n") == 2 and "é" in (out / "legal_units.jsonl").read_text()
    with pytest.raises(ValueError, match="must not be"):
        corpus.publish(spark, str(base), new, str(base))
    with pytest.raises(ValueError, match="already in the base: d1"):
        corpus.publish(spark, str(base), {"laws": spark.createDataFrame([("d1", "x")], "doc_id string, title string")}, str(tmp_path / "other"))
    with pytest.raises(ValueError, match="not empty"):
        corpus.publish(spark, str(base), new, str(out))
    (out / ".laws.jsonl.crc").unlink(missing_ok=True)
    with (out / "laws.jsonl").open("a") as f:
        f.write('{"doc_id": "d2"}\n')
    broken = run(spark, parser().parse_args(["validate", str(out)]))
    assert not broken["valid"] and broken["errors"] == ["laws: doc_id repeated or missing: d2", "laws.jsonl: bytes differ", "laws.jsonl: sha256 differs"]


def test_large_tables_are_published_in_parts(spark, base, tmp_path):
    units = spark.createDataFrame([(f"u{i:04d}", "d1", f"Section {i}", "t", True) for i in range(2, 400)], "unit_id string, source_doc_id string, local_citation string, text string, is_current boolean")
    out = tmp_path / "parts"
    report = corpus.publish(spark, str(base), {"laws": spark.createDataFrame([], "doc_id string"), "legal_units": units}, str(out), file_bytes=4000)
    assert report["valid"] and report["counts"]["legal_units"] == 399, report
    files = sorted(f.name for f in (out / "legal_units.jsonl").iterdir() if f.name.endswith(".jsonl") and not f.name.startswith("."))
    ids = [json.loads(line)["unit_id"] for f in files for line in (out / "legal_units.jsonl" / f).read_text().splitlines()]
    assert len(files) > 1 and ids == sorted(ids)
    (out / "legal_units.jsonl" / files[1]).unlink()
    (out / "legal_units.jsonl" / f".{files[1]}.crc").unlink(missing_ok=True)
    assert f"legal_units.jsonl/{files[1]}: missing" in run(spark, parser().parse_args(["validate", str(out)]))["errors"]


def test_command_line(spark, base, tmp_path):
    go = lambda *args: run(spark, parser().parse_args(list(args)))
    assert go("build", str(base), str(tmp_path / "index"))["vectors"] == 2
    assert go("query", str(tmp_path / "index"), "facts", "--top", "1")[0]["evidence_id"] == "case:c1"
    assert [r["doc_id"] for r in go("catalogue", str(tmp_path / "index"))] == ["d1"]
    with pytest.raises(SystemExit):
        parser().parse_args(["query", "i", "t", "--top", "0"])
    with pytest.raises(SystemExit):
        parser().parse_args(["serve", "i", "--port", "0"])
    assert go("smoke", str(tmp_path / "index"))["ok"]


def test_command_line_from_catalogues(spark, base, tmp_path):
    go = lambda *args: run(spark, parser().parse_args(list(args)))
    (tmp_path / "law.txt").write_text("HAVE ADOPTED\nArticle 1\nx\nArticle 2\ny")
    entry = "".join(f'{k} = "{v}"\n' for k, v in {"doc_id": "d", "title": "T", "jurisdiction": "EU", "law_family": "eu_gdpr", "source_type": "s", "version_date": "2020", "effective_date": "", "language": "en", "url": "u", "preferred_format": "txt", "target_path": str(tmp_path / "law.txt")}.items())
    (tmp_path / "c.toml").write_text(f"[[sources]]\n{entry}")
    assert go("describe", str(tmp_path / "c.toml"))["source_count"] == 1
    assert go("documents", str(tmp_path / "c.toml"), "--out", str(tmp_path / "docs"))["rows"] == 1
    assert go("units", str(tmp_path / "c.toml"), "--out", str(tmp_path / "units"))["rows"] == 2
    with pytest.raises(SystemExit):
        parser().parse_args(["units", "c.toml"])
    sample = {"id": "s1", "split": "dev", "task": "compare", "query": "q", "language": "en", "difficulty": "easy", "retrieval_k": 5, "relevance": [{"evidence_id": "case:c1", "grade": 3, "required": True, "rationale": "w"}], "coverage_groups": [], "expected_limitations": [], "tags": [], "annotation": {"status": "draft", "method": "m"}}
    (tmp_path / "b.jsonl").write_text(json.dumps(sample) + "\n")
    assert go("export", str(tmp_path / "b.jsonl"), str(base), str(tmp_path / "a.csv")) == {"rows": 1} and "facts" in (tmp_path / "a.csv").read_text()
