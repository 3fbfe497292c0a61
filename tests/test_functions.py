import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions import passages as P
from tessel.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (T.normalize_lines, "  a \r\n\r\n\x0b b\x85c\u2028 ", "a\nb\nc"),
        (T.collapse, " a\u3000\x1c b\n", "a b"),
        (T.optional_text, " N/A ", None),
        (T.optional_text, " x  y ", "x y"),
        (T.non_blank, " \t", None),
        (lambda c: T.excerpt(c, 5), "abcdefgh", "abcde…"),
        (lambda c: T.bounded(c, 14), "a" * 30, "aaaaaa\n[…]\naaa"),
        (T.match_key, "Article 4 (11)", "article411"),
        (T.strict_key, "Article 4 (11)", "article4(11)"),
        (T.iso_date, "2.1.2025", "2025-01-02"),
        (T.iso_date, "31.02.2025", None),
        (T.chinese_number, "一百零三", 103),
        (T.chinese_number, "十", 10),
        (T.chinese_number, "x", None),
        (lambda c: T.looked_up(c, {"spain": "ES"}), " Spain ", "ES"),
        (lambda c: T.looked_up(c, {}), "fr", "FR"),
        (lambda c: T.looked_up(c, {}), "nowhere", None),
    ],
)
def test_text_expressions(spark, column, value, want):
    assert one(spark, column, value) == want
    assert one(spark, column, None) is None


def test_token_estimate_equals_the_walk(spark):
    texts = ["", "a b", "第1条 §", "\x1c\x1d", "é_9 …", "word " * 500, "\u2028x\u3000"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.token_estimate(F.col("x")).alias("n")).collect()
    for r in rows:
        assert r["n"] == P.Counter().count(r["x"]) == math.ceil(round(P.units_of(r["x"]) / 20 * 1.2, 9))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?;\n。é漢", max_size=400), st.integers(3, 30))
def test_chunks_lose_no_text_and_end(text, target):
    counter = P.Counter()
    pieces = counter.split(text, target, target + 5, target // 3)
    assert bool(pieces) == bool(text.strip())
    letters = {c for c in text if not c.isspace()}
    assert letters == {c for p in pieces for c in p if not c.isspace()}
    assert all(counter.count(p) <= target + 8 for p in pieces)


def test_truncation_keeps_both_ends():
    counter = P.Counter()
    cut = counter.truncate("a" * 400 + "z" * 400, 40)
    assert cut.startswith("a") and cut.endswith("z") and P.MARKER in cut and counter.count(cut) <= 40
    assert counter.truncate("abc", 0) == "" and counter.truncate("abc", 5) == "abc"


def test_passages_number_across_segments(spark):
    rows = spark.createDataFrame([("case:1", [("facts", "One. " * 200), ("decision", "Two. " * 200)]), ("case:2", [("facts", "short")])], "parent_id string, segments array<struct<segment:string,text:string>>")
    got = P.passages(rows, threshold=40, target=20, most=30, overlap=5).orderBy("seq").collect()
    assert {r["parent_id"] for r in got} == {"case:1"} and [r["seq"] for r in got] == list(range(len(got)))
    assert {r["segment"] for r in got} == {"facts", "decision"}


def _law(i, tokens, **more):
    return {"evidence_id": f"law_unit:{i}", "source_type": "law_unit", "text": "x" * (tokens * 10 // 3), **more}


def test_packing_keeps_every_record_and_order():
    counter = P.Counter(100)
    out = P.pack_evidence([_law(i, 1000) for i in range(4)], P.Budget(total=400, reserve=50), counter)
    assert [r["evidence_id"] for r in out] == [f"law_unit:{i}" for i in range(4)] and sum(r["included_tokens"] for r in out) <= 400
    moved = P.pack_evidence([_law(0, 5), _law(1, 5, exact=True), _law(2, 5, expanded=True)], P.Budget(), counter)
    assert [r["evidence_id"][-1] for r in moved] == ["2", "1", "0"]
    with pytest.raises(ValueError):
        P.Budget(total=0)


def test_packing_prefers_matched_passages(spark):
    passages = [{"passage_id": f"p{i}", "segment": "decision" if i == 2 else "facts", "seq": i, "text": "word " * 20} for i in range(4)]
    item = {"evidence_id": "case:1", "source_type": "case", "text": "t " * 5000, "matched": ["p3"], "passages": passages}
    out = P.pack_evidence([item], P.Budget(case=90), P.Counter())[0]
    assert out["content_mode"] == "selected_passages" and out["passage_ids"][:2] == ["p3", "p2"]
    df = spark.createDataFrame([("r", 0, "case:1", "case", item["text"], False, False, ["p3"], [tuple(p.values()) for p in passages])], "request_id string, position int, evidence_id string, source_type string, text string, exact boolean, expanded boolean, matched array<string>, passages array<struct<passage_id:string,segment:string,seq:int,text:string>>")
    assert P.pack(df, P.Budget(case=90)).first()["passage_ids"] == out["passage_ids"]


def test_keys_fold_compatibility_forms(spark):
    df = spark.createDataFrame([("Ａrticle ４(11) STRASSE",), ("article 4(11) straße",), (None,)], "x string")
    keys = [r["k"] for r in df.select(T.match_key(T.folded(F.col("x"))).alias("k")).collect()]
    assert keys == ["article411strasse", "article411strasse", None]


def test_now_is_utc(spark):
    from datetime import datetime, timezone

    now = spark.range(1).select(T.utc_now().alias("t")).first()["t"]
    assert abs((datetime.now(timezone.utc) - datetime.strptime(now, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)).total_seconds()) < 120
