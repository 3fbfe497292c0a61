import json

import pytest

from tessel.sources import fetch as X


class Answer:
    def __init__(self, content, url="", error=None):
        self.content, self.url, self.error = content.encode(), url, error

    def raise_for_status(self):
        if self.error:
            raise OSError(self.error)

    def json(self):
        return json.loads(self.content)


class Session:
    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def get(self, url, params=None, headers=None, timeout=None):
        self.asked.append((url, params, headers))
        page = self.pages[url]
        page = page(params) if callable(page) else page
        return page if isinstance(page, Answer) else Answer(page, url)


def _source(tmp_path, doc, url, mode="auto", wanted="html"):
    return {"doc_id": doc, "title": doc.upper(), "url": url, "preferred_format": wanted, "download_mode": mode, "target_path": str(tmp_path / "raw" / f"{doc}.{wanted}"), "manual_instructions": ""}


def test_acquire(tmp_path):
    session = Session({
        "http://h/a": '<div id="content">One<a class="page-Article" href="/a?2">2</a></div>', "http://h/a?2": '<div id="content">Two</div>',
        "http://h/b": '<iframe id="epubFrame" src="/b.html">', "http://h/b.html": "<p>Framed</p>", "http://h/c": "  ", "http://h/d": "<p>Please solve the CAPTCHA", "http://h/e": Answer("x", error="404"), "http://h/f": "<x/>",
    })
    sources = [_source(tmp_path, x, f"http://h/{x}") for x in "abcde"] + [_source(tmp_path, "f", "http://h/f", wanted="xml"), _source(tmp_path, "g", "http://h/g", mode="manual")]
    got = {r["doc_id"]: r["status"] for r in X.acquire(sources, session, tmp_path / "m" / "manual.md")}
    assert got == {"a": "written", "b": "written", "c": "failed", "d": "failed", "e": "failed", "f": "written", "g": "manual"}
    assert (tmp_path / "raw/a.html").read_text() == "<html><body>One\nTwo</body></html>" and "Framed" in (tmp_path / "raw/b.html").read_text()
    about = json.loads((tmp_path / "raw/f.xml.metadata.json").read_text())
    assert about["bytes"] == 4 and about["doc_id"] == "f" and not (tmp_path / "raw/c.html").exists()
    report = (tmp_path / "m/manual.md").read_text()
    assert [x for x in "abcdefg" if f"## {x}\n" in report] == ["c", "d", "e", "g"] and report.endswith("\n")
    assert X.manual_report([]).endswith("No manual fetch is required.\n")
    assert session.asked[-1][2]["Accept"] == "application/xml;notice=tree"
    assert X.headers_for("https://sso.agc.gov.sg/x", "pdf")["User-Agent"] == X.AGENT
    checked = X.compared([sources[1], sources[2]], session, lambda s: "Framed")
    assert (checked["checked"], checked["same"], checked["failed"]) == (2, 1, 1)


def test_wiki_pages_and_titles():
    def answer(params):
        if params["action"] == "parse":
            return json.dumps({"parse": {"title": "A - 1", "text": {"*": "<p>x"}, "categories": [{"*": "Article_6"}, "Category:Spain"], **({"pageid": 7} if params["page"] == "A - 1" else {})}})
        first = "apcontinue" not in params
        rows = [{"ns": 0, "title": "A - 1"}, {"ns": 1, "title": "Talk - 2"}, {"ns": 0, "title": "no"}] if first else [{"ns": 0, "title": "B - 2"}, {"ns": 0, "title": "C - 3"}]
        return json.dumps({"query": {"allpages": rows}, **({"continue": {"apcontinue": "B"}} if first else {})})

    wiki = X.Wiki(Session({"u": answer}), "u")
    assert wiki.page("A - 1") == {"case_id": "gdprhub:7", "title": "A - 1", "raw_html": "<p>x", "categories": ["Article 6", "Spain"]}
    assert len(wiki.page("other")["case_id"]) == len("gdprhub:") + 16
    good = lambda t: " - " in t
    assert list(wiki.titles("allpages", good)) == ["A - 1", "B - 2", "C - 3"] and list(wiki.titles("allpages", good, 2)) == ["A - 1", "B - 2"]


def test_retries():
    tries, pauses = [], []

    def get():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("no")
        return "yes"

    assert X.retried(get, 2, 0.5, pauses.append) == "yes" and pauses == [0.5, 0.5]
    tries.clear()
    with pytest.raises(OSError):
        X.retried(get, 1, 0, pauses.append)
