"""What must hold however large the tables are: work and memory that do not grow with the square of the input, and results that no size changes."""

import pyarrow as pa
import pytest

from tessel.operators import parse

COLUMNS = ("doc_id", "title", "jurisdiction", "law_family", "version_date", "effective_date", "raw_text")


class _Unread(list):
    """Lines that may be looked up, but not gone through."""

    def __iter__(self):
        raise AssertionError("all lines of the law were read for one article")


def test_between_does_not_go_through_all_lines():
    lines = _Unread(parse.Line(str(i), 10 * i, 10 * i + 5) for i in range(1000))
    assert [x.text for x in parse.between(lines, 20, 41)] == ["2", "3", "4"]
    assert parse.between(lines, 0, -1) == [] and len(parse.between(lines, 0, 10**6)) == 1000


class _Plan:
    """Stands for a table, and gives back what would run on it."""

    columns = COLUMNS

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("n", [1, 5000])
def test_units_of_a_law_go_on_in_small_batches(n):
    text = "\n".join(f"{i}\nTitle here\nBody." for i in range(1, n + 1))
    batch = pa.RecordBatch.from_pylist([dict.fromkeys(COLUMNS, "x") | {"law_family": "uk_dpa", "raw_text": text}] * 2)
    made = list(parse.parse_units(_Plan())(iter([batch])))
    assert sum(b.num_rows for b in made) == 2 * n
    assert max(b.num_rows for b in made) <= parse.ROWS_MOST


def _equals_sql(spark, name, folder):
    """A query against its SQL over the tables of a folder."""
    import duckdb

    from tessel.plans.catalogue import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got, want = QUERIES[name](spark, str(folder)), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    shown = lambda v: repr(float(v)) if isinstance(v, (int, float)) else str(v)
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_law_relations_of_a_brand_of_ten_thousand_parts(spark, tmp_path):
    spark.range(10_050).selectExpr("id AS p_partkey", "'bolt' AS p_name", "'Brand#1' AS p_brand", "'LARGE' AS p_type", "1 AS p_size").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "part.parquet")
    _equals_sql(spark, "law_relations", tmp_path)


def test_digests_of_large_files_are_streams(spark, tmp_path):
    import hashlib

    from tessel.sources.jsonl import manifest

    for name, size in (("small", 10), ("large", 5000)):
        (tmp_path / f"{name}.jsonl").write_bytes(b"x" * size)
    cells = manifest(spark, f"{tmp_path}/*.jsonl", whole_bytes=100)
    assert {r["path"]: (r["bytes"], r["sha256"]) for r in cells.collect()} == {f"{n}.jsonl": (size, hashlib.sha256(b"x" * size).hexdigest()) for n, size in (("small", 10), ("large", 5000))}


def test_no_task_holds_more_of_a_table_than_it_can_take_the_digest_of():
    from tessel.plans import corpus
    from tessel.sources import jsonl

    assert corpus.FILE_BYTES <= jsonl.WHOLE_BYTES <= 32 << 20


def test_publish_refuses_units_that_the_base_has(spark, tmp_path):
    from tessel.plans import corpus

    (tmp_path / "base").mkdir()
    for name in corpus.TABLES:
        (tmp_path / "base" / f"{name}.jsonl").write_text('{"unit_id": "u1"}\n' if name == "legal_units" else "")
    new = {"laws": spark.createDataFrame([("d2",)], "doc_id string"), "legal_units": spark.createDataFrame([("u1",)], "unit_id string")}
    with pytest.raises(ValueError, match="already in the base: u1"):
        corpus.publish(spark, str(tmp_path / "base"), new, str(tmp_path / "out"))


def test_corpus_publish_shows_all_tables(spark):
    from tessel.plans.catalogue import QUERIES

    assert {r["table"] for r in QUERIES["corpus_publish"](spark, "/root/testdata/sf0.001").select("table").distinct().collect()} == {"laws", "legal_units", "gdprhub_cases", "case_law_relations", "law_relations", "counts"}


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_dealt_out_before_dear_work(spark):
    from tessel.plans.retrieval_queries import spread

    assert spread(spark.range(100).coalesce(1), 10).rdd.getNumPartitions() == 10 and spread(spark.range(0), 10).count() == 0


def test_keyword_rules_make_their_text_once(spark):
    from pyspark.sql import functions as F

    from tessel.functions.text import keyword_rules

    rules = {"a": ["bank", "law firm"], "b": ["shop", "sim card", "bank"]}
    assert str(keyword_rules(F.col("t"), rules)._jc.toString()).count("lower(") == 1
    rows = spark.createDataFrame([("A Bank, and a law firm",), ("banks shop_",), ("SHOP",), (None,)], "t string").select(keyword_rules(F.col("t"), rules).alias("r")).collect()
    assert [[(x["label"], x["terms"]) for x in r["r"]] for r in rows] == [[("a", ["bank", "law firm"]), ("b", ["bank"])], [], [("b", ["shop"])], []]


def test_plain_pages_are_read_like_the_parser_reads_them(monkeypatch):
    from tessel.operators import cases

    head = '<div>Menu</div><div class="mw-parser-output"><table class="wikitable"><tr><th>Parties</th><td><a href="h">A &amp; B</a><br/>C</td></tr></table>'
    pages = [head + end for end in ("<script>no()</script><h2>Facts</h2><p>One &lt; two</div>", "<h2>x<style>y</style></h2>&amp", "<script>a<b</script>x", "<!-- c --><p>x", "<p CLASS=x>", "<title>a&amp;b</title>")]
    quick = [cases._read_plain(cases._Page(), p) for p in pages]
    got = [cases.read_page(p) for p in pages]
    monkeypatch.setattr(cases, "_read_plain", lambda *_: False)
    assert quick == [True, True, False, False, False, False] and got == [cases.read_page(p) for p in pages]


def test_cases_are_not_joined_with_themselves(spark):
    from tessel.operators import cases

    pages = spark.createDataFrame([("c", "T - 1", "<p>x", ["Spain"])], "case_id string, title string, raw_html string, categories array<string>")
    assert "Join" not in _plan(cases.structured(pages))


def test_evidence_is_packed_without_a_table_for_each_request(spark):
    from tessel.functions.passages import pack

    rows = spark.createDataFrame([("r", 1, "b", "case", "two", False, False), ("r", 0, "a", "case", "one", False, False)], "request_id string, position int, evidence_id string, source_type string, text string, exact boolean, expanded boolean")
    assert "FlatMapGroups" not in _plan(pack(rows)) and [r["evidence_id"] for r in pack(rows).orderBy("position").collect()] == ["a", "b"]


def test_of_results_in_several_files_the_later_stands(spark, tmp_path):
    from tessel.operators import benchmark

    (tmp_path / "1.jsonl").write_text('{"id": "x"}\n{"id": "s", "evidence": [{"evidence_id": "old"}]}\n')
    (tmp_path / "2.jsonl").write_text('{"id": "s", "evidence": [{"evidence_id": "new"}]}\n')
    assert {r["id"]: r["ranking"] for r in benchmark.results(spark, f"{tmp_path}/*.jsonl").collect()} == {"x": [], "s": ["new"]}


def test_annotation_rows_do_not_go_through_the_driver(spark, tmp_path, monkeypatch):
    from tessel.operators import benchmark

    rows = spark.createDataFrame([("b", "e1", 'say "x",\ny', 1), ("a", "e2", None, 2)], "sample_id string, evidence_id string, text string, grade int")
    monkeypatch.setattr(type(rows), "toLocalIterator", lambda self, *a: pytest.fail("rows went through the driver"))
    assert benchmark.write_annotation_csv(spark, rows, f"{tmp_path}/a.csv") == 2
    assert (tmp_path / "a.csv").read_bytes() == b'\xef\xbb\xbfsample_id,evidence_id,text,grade\na,e2,,2\nb,e1,"say ""x"",\ny",1\n'


def test_metrics_are_the_same_over_any_number_of_tasks(spark):
    from tessel.operators.evaluation import metrics

    truth = spark.createDataFrame([(s, i, i % 3 + 1, i == 1) for s in range(5) for i in range(4)], "sample_id int, item_id int, grade int, required boolean")
    ranks = spark.createDataFrame([(s, (s + i) % 6, i) for s in range(5) for i in range(1, 4)], "sample_id int, item_id int, rank int")
    assert sorted(metrics(truth, ranks, (1, 3), partitions=3).collect()) == sorted(metrics(truth, ranks, (1, 3)).collect())


def test_citations_are_made_distinct_once(spark):
    from tessel.plans.catalogue import QUERIES

    assert _plan(QUERIES["citation_expand"](spark, "/root/testdata/sf0.001")).count("Aggregate [") == 2
