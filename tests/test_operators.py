import pytest
from pyspark.sql import functions as F

from tessel.operators import evaluation, integrity, parse, ranking, relations
from tessel.operators.retrieval import exact_lookup, normalized


def test_worked_metrics_example(spark):
    truth = spark.createDataFrame([("s", "case", 3, True), ("s", "law", 2, True)], "sample_id string, item_id string, grade int, required boolean")
    ranks = spark.createDataFrame([("s", "other", 1), ("s", "law", 2), ("s", "case", 3), ("s", "law", 9)], "sample_id string, item_id string, rank int")
    got = {r["k"]: r for r in evaluation.metrics(truth, ranks, (1, 2, 3)).collect()}
    assert got[1]["recall"] == 0 and got[2]["mrr"] == 0.5 and got[2]["required_recall"] == 0.5 and got[3]["recall"] == 1
    assert 0 < got[3]["ndcg"] <= 1 and got[3]["precision"] == pytest.approx(2 / 3, abs=1e-6)
    with pytest.raises(ValueError):
        evaluation.metrics(truth, ranks, ())


def test_fusion_keeps_the_best_recall_high(spark):
    rows = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "request_id int, item string, rank int")
    out = ranking.reciprocal_rank_fusion(rows(["gold", "b", "c", "d"]), rows(["b", "c", "d", "gold"]), ["request_id"], "item", "rank")
    assert "gold" in [r["item"] for r in out.orderBy("rank").limit(3).collect()]


def test_role_quotas():
    roles = ("law", "case", "more")
    assert ranking.role_quotas(8, roles, ("law", "case", "law", "more")) == {"law": 4, "case": 2, "more": 2}
    assert ranking.role_quotas(2, roles, ("law",)) == {"law": 1, "case": 1, "more": 0}


def test_quota_interleave_order(spark):
    rows = [("r", role, f"{role}{i}", i + 1) for role in ("L", "C", "S") for i in range(5)] + [("r", "C", "L0", 0)]
    df = spark.createDataFrame(rows, "request_id string, role string, item string, rank int")
    got = ranking.quota_interleave(df, ["request_id"], "role", "item", "rank", {"L": 4, "C": 2, "S": 2}, 8).orderBy("position").collect()
    assert [r["role"] for r in got] == ["L", "C", "S", "L", "C", "S", "L", "L"] and len({r["item"] for r in got}) == 8


def test_exact_lookup_needs_equal_punctuation(spark):
    units = spark.createDataFrame([("d", "Article 4(11)", 1), ("d", "Article 41(1)", 2)], "doc_id string, local_citation string, unit int")
    asked = spark.createDataFrame([("d", "ARTICLE  4 (11)", 0)], "doc_id string, wanted string, position int")
    assert [r["unit"] for r in exact_lookup(units, asked).collect()] == [1]


def test_normalized_vector(spark):
    row = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(normalized(F.col("v")).alias("u")).collect()
    assert [r["u"] for r in row] == [[0.6, 0.8], [0.0, 0.0]]


def test_conflicting_repeats_are_an_error(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int")
    assert integrity.require_no_conflicts(rows, ["id"], ["v"]).count() == 2
    with pytest.raises(Exception, match="conflicting rows for b"):
        integrity.require_no_conflicts(rows.unionByName(spark.createDataFrame([("b", 3)], "id string, v int")), ["id"], ["v"]).collect()


def test_units_and_cases_are_unique_or_an_error(spark):
    units = spark.createDataFrame([("u", "one", 1), ("u", "other", 1)], "unit_id string, text string, n int")
    with pytest.raises(Exception, match="conflicting rows for u: 3 characters [0-9a-f]{12} / 5 characters"):
        integrity.unique_units(units).collect()
    cases = spark.createDataFrame([("c", "t", "2", None), ("c", "t", "1", "ES")], "case_id string, title string, retrieved_at string, jurisdiction string")
    assert [tuple(r) for r in integrity.unique_cases(cases).collect()] == [("c", "t", "2", None)]
    with pytest.raises(Exception, match="conflicting rows for c"):
        integrity.unique_cases(cases.withColumn("title", F.col("retrieved_at"))).collect()


ALIASES = {"gdpr": ["GDPR", "Regulation (EU) 2016/679"], "ai": ["AI Act"]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("See Article 6(1), and Articles 12 to 14.", [("own", f"Article {x}") for x in ("6(1)", "12", "13", "14")]),
        ("under Article 4, point (1) of the GDPR", [("gdpr", "Article 4(1)")]),
        ("Article 10 of Directive (EU) 2016/680", []),
        ("the GDPR is mentioned", []),
        ("AI Act, Article 3 applies", [("ai", "Article 3")]),
        ("sections 2 and 205(4)", [("own", "Section 2"), ("own", "Section 205(4)")]),
        ("根据第十三条", [("own", "第十三条")]),
        ("Article 5 of this Regulation", [("own", "Article 5")]),
        ("Article 6(1), points (a), (b) and (c) of the GDPR", [("gdpr", f"Article 6(1)({x})") for x in "abc"]),
        ("Article 4 paragraph (2) applies", [("own", "Article 4(2)")]),
        ("Articles 3, 5 and 7 through 9 of Regulation (EU) 2016/679.", [("gdpr", f"Article {x}") for x in (3, 5, 7, 8, 9)]),
        ("Article 5 of the UK GDPR", [("own", "Article 5")]),
        ("GDPR; Article 9", [("own", "Article 9")]),
        ("Article 2 AI Act, Article 3", [("ai", "Article 2"), ("own", "Article 3")]),
        ("Articles 30 to 900", [("own", "Article 30"), ("own", "Article 900")]),
        ("§§ 12 and 14a pursuant to the AI Act", [("ai", "§ 12"), ("ai", "§ 14a")]),
        ("Recital 4; the article has 5 parts", [("own", "Recital 4")]),
    ],
)
def test_references(text, want):
    found = relations.references_of(text, "own", relations.Reader(ALIASES))
    assert [(doc, cited) for doc, cited, *_ in found] == want


def test_law_relations_resolve_with_fallback(spark):
    rows = [("g:1", "gdpr", "Article 1", "as in Article 2(7) and Article 1"), ("g:2", "gdpr", "Article 2", "none"), ("a:1", "ai", "Article 1", "Article 2 of the GDPR; Article 2 of the GDPR")]
    got = relations.law_relations(spark.createDataFrame(rows, "unit_id string, doc_id string, citation string, text string"), ALIASES).collect()
    shown = sorted((r["source_unit_id"], r["target_unit_id"], r["requested"], r["scope"], r["confidence"], len(r["evidence"])) for r in got)
    assert shown == [("a:1", "g:2", "Article 2", "cross_law", 1.0, 2), ("g:1", "g:2", "Article 2(7)", "intra_law", 0.95, 1)]


def test_citations_fall_back_through_all_their_parts(spark):
    asked = spark.createDataFrame([("d", f"Article 9{'(1)' * n}", n) for n in (0, 1, 7)] + [("d", "Article 8(1)", 99)], "doc string, requested string, n int")
    units = spark.createDataFrame([("d", "Article 9", "u")], "doc string, citation string, unit string")
    got = {r["n"]: (r["unit"], r["basis"]) for r in relations.resolve_citations(asked, units, ["doc"], "requested", "citation").collect()}
    assert got == {0: ("u", "exact"), 1: ("u", "parent_unit_fallback"), 7: ("u", "parent_unit_fallback"), 99: (None, "unresolved")}


def _units(family, text, title="T"):
    doc = {"doc_id": "d", "title": title, "jurisdiction": "J", "law_family": family, "version_date": None, "effective_date": None, "raw_text": text}
    units = [parse._row(doc, u) for u in parse.PARSERS[family](text, doc)]
    assert all(text[u["char_start"] : u["char_end"]] == u["text"] for u in units)
    return [u["local_citation"] for u in units], units


def test_eu_units():
    text = "(1) Whereas a.\n(2) b\nHAVE ADOPTED THIS:\nArticle 1\nSubject\n1. One:\n(h) x:\n(i) r\n(ii) s\n(j) y\n2. Two\nArticle 2\nBody\nDone at X\nANNEX I\nArticle 3\n"
    cited, units = _units("eu_gdpr", text)
    assert cited == ["Recital 1", "Recital 2", "Article 1", "Article 1(1)", "Article 1(1)(h)", "Article 1(1)(h)(i)", "Article 1(1)(h)(ii)", "Article 1(1)(j)", "Article 1(2)", "Article 2"]
    assert units[-1]["text"] == "Article 2\nBody" and units[3]["parent_id"] == "d:article_1" and units[2]["canonical_citation"] == "GDPR Article 1"


def test_other_families():
    assert _units("china_pipl", "第一条　目的\n第二十一条 x\n")[1][1]["unit_id"] == "d:article_21"
    assert _units("us_cfr", "§ 312.1 Scope\na\n§ 312.2 Definitions\nb", "16 CFR Part 312")[1][1]["canonical_citation"] == "16 CFR § 312.2"
    assert _units("us_cfr", "§ 164.308.1 Deep\na\n§ 164.308a No heading\nb", "45 C.F.R. Part 164")[0] == ["§ 164.308.1"]
    cited, units = _units("us_state_privacy", "1798.100.\na\nsee Section\n1798.105.\nb\n999.305.\nc\n1798.199.55.2.\n(a) d\nany subsection\n1798.200.\ne")
    assert cited == ["1798.100", "999.305", "1798.199.55.2", "1798.200"]
    assert units[0]["canonical_citation"] == "California Civil Code § 1798.100" and units[0]["unit_id"] == "d:section_1798_100"
    assert _units("singapore_pdpa", "1 Short title\na\n2 Definitions\nb\n2 Definitions again\nc")[0] == ["Section 1", "Section 2"]
    assert _units("malaysia_pdpa", "1. (1) a\n2. Bee\n1. Cee\n3. Dee")[0] == ["Section 1", "Section 2", "Section 3"]
    assert _units("korea_pipa", "Article 1 (Purpose)\nArticle 2 (Terms)\nArticle 1 (Purpose)\nThe purpose is this.\nArticle 2 Deleted")[0] == ["Article 1", "Article 2"]
    assert _units("hong_kong_pdpo", "Section: 1 Title\na\nSchedule: 1 Principles\n1. Principle 1 x\nb\n2. Principle 2 y\nc")[0] == ["Section 1", "Schedule 1 Principle 1", "Schedule 1 Principle 2"]


def test_singapore():
    text = "67 Saving and transitional provisions\na\n68 Dissolution\nb\nFIRST SCHEDULE\nX\n1. One.\nFIRST SCHEDULE — continued\n2A. Two.\nSECOND SCHEDULE\n1. Three.\nLegislative History\n1 Short title\nno"
    cited, units = _units("singapore_pdpa", text)
    assert cited == ["Section 67", "Section 68", "First Schedule", "Second Schedule"] and "2A. Two." in units[2]["text"] and units[3]["text"].endswith("Three.")
    text = "P AR T 1\nPRELIMINAR Y\nShort title\n1. This Act is the Act.\nInterpre tation\n2.—(1) In this Act —\nCompliance with Act\n1 1. In meeting its duties.\nP AR T 7\n27. [Repealed]\n"
    cited, units = _units("singapore_pdpa", text)
    assert cited == ["Section 1", "Section 2", "Section 11"] and units[1]["text"].startswith("Interpre tation")


def test_india():
    head = "CHAPTER I\n1. (1) This Act.\n(2) It shall.\n2 THE GAZETTE OF INDIA EXTRAORDINARY [PART II-\n2. In this Act,-\n(a) x.\n"
    assert _units("india_dpdp", head)[0] == ["Section 1", "Section 2"]
    table = "Breach of provisions of  this Act or rules made thereunder\n(2)\nBreach of a\nin two lines.\nBreach of b.\nSl. No.\n(1)\n1.\n2.\nPenalty\n(3)\nMay extend to one crore.\nMay extend to two.\nTHE  SCHEDULE\n[See section 33]\nDR. X,\n"
    doc = {"doc_id": "d", "title": "T", "jurisdiction": "IN", "law_family": "india_dpdp", "version_date": None, "effective_date": None, "raw_text": head + table}
    units = [parse._row(doc, u) for u in parse.PARSERS["india_dpdp"](head + table, doc)]
    assert [u["local_citation"] for u in units] == ["Section 1", "Section 2", "Schedule item 1", "Schedule item 2"]
    assert units[2]["text"] == "Breach of a\nin two lines.\nMay extend to one crore." and len(units[2]["span_ids"]) == 2 and "Breach" not in units[1]["text"]
    uneven = head + table.replace("2.\nPenalty", "Penalty")
    assert _units("india_dpdp", uneven)[0][-1] == "Schedule"


def test_canada():
    text = "Table of Contents\n1 - Short Title\n2 - PART 1\nShort Title\n1\nThis Act may be cited.\n2\n(1) Definitions.\n3\nPurpose.\nSCHEDULE 1\n4.1 Principle 1 — Accountability\na\n4.1.1\nb\n4.10.4\nc\nSCHEDULE 2\n1\nno"
    cited, units = _units("canada_pipeda", text)
    assert cited == ["Section 1", "Section 2", "Section 3", *(f"Schedule 1 clause {x}" for x in ("4.1", "4.1.1", "4.10.4"))]
    assert "Contents" not in units[0]["text"] and "no" not in units[-1]["text"] and units[-1]["unit_id"] == "d:schedule_1_clause_4_10_4"
    assert _units("canada_pipeda", "PART 1\n2 Definitions\na\n5 Compliance with obligations\nb")[0] == ["Section 2", "Section 5"]


def test_united_kingdom():
    text = "1\nOverview\na\n2\nProtection of personal data\nb\n\nSCHEDULE A1\nInternational law\nc\n\nSCHEDULE 2\nExemptions etc\nParagraph 1\nd\nParagraph 2\ne\nSCHEDULE 12A\nThe Commission\nParagraph 1\nf"
    cited, units = _units("uk_dpa", text)
    assert cited == ["Section 1", "Section 2", "Schedule A1", "Schedule 2 paragraph 1", "Schedule 2 paragraph 2", "Schedule 12A paragraph 1"]
    assert units[3]["canonical_citation"] == "T Schedule 2 paragraph 1 (Exemptions etc)" and units[3]["unit_type"] == "schedule_clause"
    doc = {"title": "T", "law_family": "uk_dpa", "section_titles": {"20": "Meaning of x", "114A": "The Commission"}}
    text = "20\nMeaning of x\n. . .\n21\nSome table row\nz\n114A\nThe  Commission\n1 A body corporate called so."
    assert [u.local for u in parse.united_kingdom(text, doc)] == ["Section 20", "Section 114A"]


def test_australia():
    text = (
        "Table of contents\n1\nShort title\nSchedule\n1\n—\nAustralian Privacy Principles\nEndnotes\nBE IT THEREFORE ENACTED by the Queen:\nPart\nI\n—\nPreliminary\n1\nShort title\na\n2A\nObjects of this Act\nb\n16A\nPermitted situations\nc\n5\nAPP entity\nd\n"
        "Schedule\n1\n—\nAustralian Privacy Principles\nOverview\nPart\n1\n—\nConsideration\n1\nAustralian Privacy Principle\n1—open\n1.1\ne\n13\nAustralian Privacy Principle\n13—correction\n13.5\nf\nSchedule\n2\n—\nStatutory Tort\n1\nObjects of this Schedule\ng\nEndnotes\nEndnote 1"
    )
    cited, units = _units("australia_privacy_act", text)
    assert cited == ["Section 1", "Section 2A", "Section 16A", "APP 1", "APP 1.1", "APP 13", "APP 13.5", "Schedule 2 clause 1"]
    assert units[2]["text"].endswith("\nd") and units[4]["unit_id"] == "d:app_1_1" and units[-1]["text"].endswith("g")
    assert _units("australia_privacy_act", "Part I Preliminary\n6 Interpretation\na\n13 Interferences with privacy\nb")[0] == ["Section 6", "Section 13"]


def test_windows_of_malaysia_south_africa_and_the_philippines():
    text = "SUSUNAN SEKSYEN\n1. Tajuk ringkas\nARRANGEMENT OF SECTIONS\n1. Short title\n2. Application\nAn Act to regulate data\nand more.\nShort title\n1. (1) This Act.\nA reference to section 2. is none.\n2. (1) It applies.\n3. This Act does not."
    cited, units = _units("malaysia_pdpa", text)
    assert cited == ["Section 1", "Section 2", "Section 3"] and units[0]["text"].startswith("1. (1) This Act.")
    text = "CHAPTER 1\n1. Definitions\n2. Purpose\n12 No. 37067 GOVERNMENT GAZETTE, 26 November\nSCHEDULE\nLaws amended\nCHAPTER 1\n1. In this Act.\n2. The purpose.\n14 No. 37067 GOVERNMENT GAZETTE, 26 November\nof this Act goes on.\n110.The laws are amended.\nSCHEDULE\n77K. No."
    doc = {"doc_id": "d", "title": "T", "jurisdiction": "ZA", "law_family": "south_africa_popia", "version_date": None, "effective_date": None, "raw_text": text}
    units = [parse._row(doc, u) for u in parse.south_africa(text, doc)]
    assert [u["local_citation"] for u in units] == ["Section 1", "Section 2", "Section 110"] and units[1]["text"] == "2. The purpose.\nof this Act goes on."
    assert _units("south_africa_popia", "CHAPTER 1\n1 Definitions\na\n2 Purpose of Act\nb")[0] == ["Section 1", "Section 2"]
    assert _units("philippines_dpa", "CHAPTER I\nSection 4.\nScope.\na\nSECTION 11. General\nb")[0] == ["Section 4", "Section 11"]
    assert _units("philippines_dpa", "CHAPTER I\n4 Scope\na\n11 General Principles\nb")[0] == ["Section 4", "Section 11"]


def test_articles():
    toc = "Table of Contents\nArticle 108\nSection 5 Provision of Information.\nArticle 185\nArticle 1 (Purpose)\nArticle 2 (Definitions)\nAct\nArticle 1\nThe purpose is this.\nArticle 2\nIn this Act.\nArticle 108\nThe provisions do not.\n"
    cited, units = _units("japan_appi", toc)
    assert cited == ["Article 1", "Article 2", "Article 108"] and "Section 5" not in units[2]["text"]
    assert _units("korea_pipa", "Article 7-2 (Composition)\nIt is composed.\nArticle 8 Deleted. <2020>\nArticle 8-2 (Assessment)\nThe head shall.\nADDENDA\nArticle 8 (Measures)\nThe previous apply.")[0] == ["Article 7-2", "Article 8", "Article 8-2"]
    text = "Article 1 of another law.\nArticle 6. Activities follow.\nArticle 7 . Processing is so.\nArticle 8. Item I of article 7 of this Law.\n. Article 17. Every person.\nArticle 55. (vetoed)\nArticle 55 -A. The Authority is.\nArticle 55-B. (Repealed)\nArticle 60. Law is amended:\n“Article 7. (...)\nX.”"
    cited, units = _units("brazil_lgpd", text)
    assert cited == ["Article 6", "Article 7", "Article 8", "Article 17", "Article 55", "Article 55-A", "Article 55-B", "Article 60"]
    assert units[3]["text"] == "Article 17. Every person." and units[5]["unit_id"] == "d:article_55-a" and "“Article 7" in units[-1]["text"]
    assert _units("brazil_lgpd", "Art. 1\nThis Law provides.\nArt. 2\nThe discipline is.")[0] == ["Article 1", "Article 2"]


def test_parse_units_table(spark):
    schema = "doc_id string, title string, jurisdiction string, law_family string, version_date string, effective_date string, raw_text string"
    docs = spark.createDataFrame([("d", "T", "EU", "eu_gdpr", None, "2020-01-01", "HAVE ADOPTED\nArticle 1\nx"), ("e", "T", "EU", "eu_gdpr", None, None, None)], schema)
    units = parse.parse_units(docs)
    assert [r["unit_id"] for r in units.collect()] == ["d:article_1"]
    assert [r["doc_id"] for r in parse.without_units(docs, units).collect()] == ["e"]
    with pytest.raises(Exception, match="no parser"):
        parse.parse_units(docs.withColumn("law_family", F.lit("mars"))).collect()
    late = parse.parse_units(spark.createDataFrame([("d", "T", "UK", "uk_dpa", None, None, "1 Short title\na\n2 Gone things\nb")], schema))
    revised = parse.with_revisions(late, spark.createDataFrame([("d", "2", "omitted", None, "2021-01-01")], "source_doc_id string, section string, status string, effective_from string, effective_to string"))
    assert {r["local_citation"]: r["is_current"] for r in revised.collect()} == {"Section 1": True, "Section 2": False}
