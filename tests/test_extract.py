import pytest
from xml.etree import ElementTree

from tessel.sources import extract as X

AU = """<html><body><p class="TOC5">26C Eligible data breach</p><p id="n2" class="ActHead5">1 Short title</p><p class="subsection">This Act may be cited.</p>
<p class="ActHead5">6 Interpretation</p><p class="Definition">breach has the meaning.</p><p class="ActHead1">Schedule 1 — Australian Privacy Principles</p>
<p class="ActHead5">1 Australian Privacy Principle 1—open management</p><p class="subsection">1.1 The object.</p><p class="ActHead1">Schedule 2 — Statutory Tort</p>
<p class="ActHead5">1 Objects of this Schedule</p><p class="subsection">Not a section.</p><p class="ENotesHeading1">Endnotes</p><p class="ENoteTableText">26C history</p></body></html>"""
UK = """<?xml version="1.0"?><Legislation xmlns="http://www.legislation.gov.uk/namespaces/legislation"><Primary><Body>
<P1group><Title>Overview</Title><P1 DocumentURI="http://l/ukpga/2018/12/section/1"><Pnumber>1</Pnumber><P1para><P2><Pnumber>1</Pnumber><P2para><Text>This Act makes provision.</Text></P2para></P2></P1para></P1></P1group>
<P1group RestrictStartDate="2025-08-21"><Title>Meaning of “court”</Title><P1 DocumentURI="http://l/ukpga/2018/12/section/20"><Pnumber>20</Pnumber><P1para><Text>. . . . .</Text><CommentaryRef Ref="c20"/></P1para></P1></P1group>
<P1group RestrictStartDate="2025-08-22"><Title>Gone</Title><P1 DocumentURI="http://l/ukpga/2018/12/section/21"><Pnumber>21</Pnumber><P1para><Text>. . .</Text></P1para></P1></P1group>
<P1group><Title><Addition CommentaryRef="c114a">The Commission</Addition></Title><P1 DocumentURI="http://l/ukpga/2018/12/section/114A"><Pnumber><Addition CommentaryRef="c114a">114A</Addition></Pnumber><P1para><Text>It is established.</Text></P1para></P1></P1group>
</Body><Schedules><Schedule DocumentURI="http://l/ukpga/2018/12/schedule/12A"><Number>Schedule 12A</Number><TitleBlock><Title>The Commission</Title></TitleBlock>
<P1 DocumentURI="http://l/ukpga/2018/12/schedule/12A/paragraph/1"><Pnumber>1</Pnumber><P1para><Text>A body corporate.</Text></P1para></P1></Schedule></Schedules>
<BlockAmendment><Schedule><Number>Schedule 2</Number><P1 DocumentURI="http://l/uksi/2016/696/schedule/2/paragraph/1"><Pnumber>1</Pnumber><P1para><Text>Nested.</Text></P1para></P1></Schedule></BlockAmendment></Primary>
<Commentaries><Commentary id="c20">S. 20 omitted (20.8.2025) by another Act.</Commentary><Commentary id="c114a">S. 114A and cross-heading inserted (2.8.2025) by another Act.</Commentary></Commentaries></Legislation>"""


def test_suffixes():
    assert X.file_text("a.txt", "第一条 x".encode()) == "第一条 x"
    assert X.file_text("A.HTM", b"<h1>Article 1</h1><script>no</script><p>Text &amp; more") == "Article 1\nText & more"
    assert X.file_text("a.xml", b"<D><H>PART 312</H><S>\xc2\xa7 312.1</S></D>") == "PART 312\n§ 312.1"
    assert X.file_text("a.xml", b"<p>broken &nbsp; <b>page") == "broken\npage"
    for name in ("a.doc", "a"):
        with pytest.raises(ValueError):
            X.file_text(name, b"")


def test_australian_pages():
    text = X.html_text(AU)
    assert text.startswith("1\nShort title\nThis Act may be cited.\n6\nInterpretation\n") and "history" not in text and "26C" not in text
    assert "\nSchedule\n1\n—\nAustralian Privacy Principles\n1\nAustralian Privacy Principle\n1—open management\n1.1\nThe object.\nSchedule\n2\n" in text
    from tessel.operators import parse

    assert [u.local for u in parse.australia(text, {"title": "T", "law_family": "australia_privacy_act"})] == ["Section 1", "Section 6", "APP 1", "APP 1.1", "Schedule 2 clause 1"]


def test_british_texts_and_revisions():
    text = X.xml_text(UK)
    assert text.startswith("1\nOverview\n(1) This Act makes provision.\n\n20\nMeaning of “court”\n. . . . .") and "Nested" not in text
    assert text.endswith("\n\nSCHEDULE 12A\nThe Commission\nParagraph 1\nA body corporate.")
    rows = {r["section"]: r for r in X.british_revisions(ElementTree.fromstring(UK))}
    assert (rows["20"]["status"], rows["20"]["title"], rows["20"]["effective_to"]) == ("omitted", "Meaning of “court”", "2025-08-20")
    assert rows["21"]["effective_to"] == "2025-08-22" and rows["1"]["status"] == "active" and rows["20"]["commentaries"][0]["ref"] == "c20"
    assert (rows["114A"]["status"], rows["114A"]["effective_from"], rows["114A"]["effective_to"]) == ("active", "2025-08-02", None)


def test_files_of_a_folder_become_units(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessel.operators import parse

    (tmp_path / "uk.xml").write_text(UK)
    (tmp_path / "a.txt").write_text("plain")
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in X.read_files(spark, str(tmp_path)).collect()}
    assert texts["a.txt"] == "plain"
    revisions = X.read_revisions(spark, str(tmp_path)).withColumn("source_doc_id", F.lit("uk"))
    docs = spark.createDataFrame([("uk", "T", "UK", "uk_dpa", None, None, texts["uk.xml"], {r["section"]: r["title"] for r in revisions.collect()})], "doc_id string, title string, jurisdiction string, law_family string, version_date string, effective_date string, raw_text string, section_titles map<string,string>")
    units = parse.with_revisions(parse.parse_units(docs), revisions.select("source_doc_id", "section", "status", "effective_from", "effective_to"))
    got = {r["local_citation"]: (r["is_current"], r["effective_from"], r["effective_to"]) for r in units.collect()}
    assert got == {"Section 1": (True, None, None), "Section 20": (False, None, "2025-08-20"), "Section 21": (False, None, "2025-08-22"), "Section 114A": (True, "2025-08-02", None), "Schedule 12A paragraph 1": (True, None, None)}


def test_paginated_and_embedded_pages():
    page = '<body><div id="content"><a class="page-Article" href="b?p=2">2</a><a class="x page-Article" href="/a">1</a><p class="t">One &lt; two<br></div><p>out</body>'
    assert X.pagination_urls(page, "http://h/a") == ["http://h/b?p=2"]
    assert X.article_fragment(page) == '<p class="t">One &lt; two<br></p>'
    assert X.combined_pages([page, "<body><b>Two</b>"]) == '<html><body><p class="t">One &lt; two<br></p>\n<b>Two</b></body></html>'
    assert X.embedded_document_url('<iframe id="epubFrame" src="x/y.html">', "http://h/a/") == "http://h/a/x/y.html" and X.embedded_document_url("<p>", "http://h") is None
