import corpus_pipeline
from tests.llm.test_dedup import _near_brute
from tests.llm.test_texts import _overlap_brute
from tessel.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input; the fitted first stage by what its operator reports for all rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, key = docs.columns, lambda r: r["doc_id"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(docs.collect(), key=key)
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = sorted(docs.collect(), key=key)
        rows = [(r["doc_id"], r["text"]) for r in before]
        kept = {r["doc_id"] for r in after}
        if i < 4:
            assert docs.columns == columns and set(after) <= set(before)
        if name == "quality":
            assert kept == {r["doc_id"] for r in queries.op2_importance(spark, SF).where("kept").collect()}
        elif name == "exact_dedup":
            last = {}
            for doc, text in rows:
                last[text] = doc
            assert kept == set(last.values())
        elif name == "near_dedup":
            assert kept == {d for d, _, c, _ in _near_brute(rows, 5, 80) if d == c}
        elif name == "decontaminate":
            assert kept == {r[0] for r in _overlap_brute(rows, items) if not r[5]}
        else:
            assert kept == {d for d, _ in rows} and all(r["exact"] and r["n_pieces"] == len(r["piece_ids"]) for r in after)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_decisions_are_about_rows(spark, documents):
    """Ids that repeat or are null: a row that goes does not stay because another with its id does."""
    text = lambda x, n=30: " ".join(f"{x}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("a")), (2, text("a")), (None, text("c")), (None, text("c")), (None, text("d")), (3, text("c") + " more"), (4, None), (4, ""), (5, text("e")), (5, text("e", 31)), (6, text("e"))]
    docs = documents(rows, "row_number int, kept_ int, kept string")
    shown = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    exact = _stage("exact_dedup")(spark, docs, SF)
    assert exact.columns == docs.columns
    want = [(1, text("b")), (2, text("a")), (None, text("c")), (None, text("d")), (3, text("c") + " more"), (5, text("e", 31)), (6, text("e"))]
    got = shown(exact)
    assert [x for x in got if x[1]] == sorted(want, key=str) and len([x for x in got if not x[1]]) == 1
    near = _stage("near_dedup")(spark, docs, SF)
    got = shown(near)
    assert near.columns == docs.columns
    assert [x for x in got if x[1]] == sorted([(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), *([(5, text("e"))] if (5, text("e")) in got else [(5, text("e", 31))])], key=str)
    assert [x for x in got if not x[1]] == [(4, None), (4, "")] or [x for x in got if not x[1]] == [(4, ""), (4, None)]  # without words, linked with nothing
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    rows = [(7, f"x {item} y"), (7, text("f")), (None, item), (None, text("g")), (None, None), (8, "")]
    clean = _stage("decontaminate")(spark, documents(rows, "row int, items string"), SF)
    assert shown(clean) == sorted([(7, text("f")), (None, text("g")), (None, None), (8, "")], key=str)


def test_stages_of_an_empty_table(spark, documents):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, documents([]), SF)
        assert out.count() == 0 and (name == "encode" or out.columns == documents([]).columns)


def test_quality_stage_against_brute_force(spark):
    """The rows that stay have the k largest keys, by weights from the operator's ratios and a plain sort."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op2_importance(spark, SF).collect()
    k = sum(r["log_weight"] is not None and (r["log_weight"] > 0) for r in rows) or sum(r["log_weight"] is not None for r in rows)
    ranked = sorted((r for r in rows if r["sample_key"] is not None), key=lambda r: -r["sample_key"])[:k]
    assert {r["doc_id"] for r in _stage("quality")(spark, docs, SF).collect()} == {r["doc_id"] for r in ranked}


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
