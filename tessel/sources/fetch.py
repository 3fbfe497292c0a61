"""Fetching sources over a session that the caller brings, with what is kept beside them.

A session has get(url, params=..., headers=..., timeout=...) and its answers have content, text, url, raise_for_status()
and json(). Fetching is paced by the servers, not by the data, so it runs on the driver.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from pathlib import Path

from .extract import combined_pages, embedded_document_url, file_text, pagination_urls

#: What a request says of itself, by the wanted format and by host.
AGENT = "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Safari/537.36"
ACCEPTS = {"xml": "application/xml;notice=tree", "pdf": "application/pdf,text/html,application/xhtml+xml,*/*;q=0.8"}
PLAIN_HOSTS = ("sso.agc.gov.sg",)
#: Marks of a page that an access gate answers with.
GATES = ("captcha", "access denied", "are you a robot", "request blocked", "enable javascript and cookies")


def headers_for(url: str, wanted: str, own_name: str = "tessel/0.1") -> dict[str, str]:
    """The headers of a request."""
    agent = AGENT if any(h in url for h in PLAIN_HOSTS) else f"{AGENT} {own_name}"
    return {"User-Agent": agent, "Accept": ACCEPTS.get(wanted, "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"), "Accept-Language": "en-US,en;q=0.9"}


def retried(get: Callable[[], object], retries: int, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """What get gives, tried retries + 1 times with a pause between; the last error is raised."""
    for left in range(retries, -1, -1):
        try:
            return get()
        except Exception:
            if not left:
                raise
            sleep(pause)
    raise AssertionError


def blocked(url: str, text: str) -> bool:
    """Whether an access gate answered, by its address or the first 20,000 characters (H9)."""
    said = f"{url}\n{text[:20_000]}".lower()
    return any(g in said for g in GATES)


def fetched(source: Mapping[str, str], session, timeout: float = 30) -> bytes:
    """The bytes of a source (S9): an empty or gated answer is an error; a framed document is followed, and a text of several pages is made one."""
    ask = lambda url: session.get(url, headers=headers_for(url, source["preferred_format"]), timeout=timeout)

    def checked(url: str) -> tuple[bytes, str]:
        answer = ask(url)
        answer.raise_for_status()
        content = answer.content
        if not content.strip():
            raise ValueError(f"{url}: the answer is empty")
        text = content.decode("utf-8", "replace")
        if source["preferred_format"] != "pdf" and blocked(getattr(answer, "url", url) or url, text):
            raise ValueError(f"{url}: an access gate answered")
        return content, text

    content, text = checked(source["url"])
    if source["preferred_format"] != "html":
        return content
    if framed := embedded_document_url(text, source["url"]):
        content, text = checked(framed)
    if more := pagination_urls(text, source["url"]):
        content = combined_pages([text, *(checked(url)[1] for url in more)]).encode()
    return content


def sidecar_path(path: str | Path) -> Path:
    return Path(f"{path}.metadata.json")


def keep(source: Mapping[str, str], content: bytes) -> None:
    """The raw bytes, and what is known of them in a file beside them (K4)."""
    path = Path(source["target_path"])
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    about = {**source, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}
    sidecar_path(path).write_text(json.dumps(about, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


#: The wording of the list of what has to be fetched by hand.
BY_HAND, NOTHING_BY_HAND, HOW = "# Manual Law Source Fetch List", "No manual fetch is required.", "Download the official text and save it to the target path."


def manual_report(sources: Sequence[Mapping[str, str]]) -> str:
    """A list of what has to be fetched by hand, in Markdown (K5)."""
    out = [BY_HAND, ""]
    if not sources:
        out.append(NOTHING_BY_HAND)
    for s in sources:
        how = s.get("manual_instructions") or HOW
        out += [f"## {s['doc_id']}", "", f"- Title: {s['title']}", f"- URL: {s['url']}", f"- Save to: `{s['target_path']}`", f"- Metadata sidecar: `{sidecar_path(s['target_path'])}`", f"- Instructions: {how}", ""]
    return "\n".join(out) + "\n"


def acquire(sources: Iterable[Mapping[str, str]], session, report: str | Path, timeout: float = 30) -> list[dict]:
    """doc_id, status (written, manual or failed) and error of each source; what was not written is in the report."""
    out, by_hand = [], []
    for s in sources:
        error = None
        if s["download_mode"] == "manual":
            status = "manual"
        else:
            try:
                keep(s, fetched(s, session, timeout))
                status = "written"
            except Exception as e:  # one source's failure is a row of the report
                status, error = "failed", str(e)
        if status != "written":
            by_hand.append(s)
        out.append({"doc_id": s["doc_id"], "status": status, "error": error})
    Path(report).parent.mkdir(parents=True, exist_ok=True)
    Path(report).write_text(manual_report(by_hand), encoding="utf-8")
    return out


class Wiki:
    """Pages and title lists of a MediaWiki interface."""

    def __init__(self, session, address: str, *, prefix: str = "gdprhub", retries: int = 2, pause: float = 1.0, timeout: float = 30, sleep: Callable[[float], None] = time.sleep):
        self.session, self.address, self.prefix, self.retries, self.pause, self.timeout, self.sleep = session, address, prefix, retries, pause, timeout, sleep

    def ask(self, **params) -> dict:
        def once():
            answer = self.session.get(self.address, params={"format": "json", **params}, timeout=self.timeout)
            answer.raise_for_status()
            return answer.json()

        return retried(once, self.retries, self.pause, self.sleep)

    def page(self, title: str) -> dict:
        """case_id, title, raw_html and categories of a page; without a page number its id comes from the title."""
        got = self.ask(action="parse", page=title, prop="text|categories")["parse"]
        html, named = got.get("text") or "", got.get("title") or title
        number = got.get("pageid") or hashlib.sha1(named.encode()).hexdigest()[:16]
        return {"case_id": f"{self.prefix}:{number}", "title": named, "raw_html": html.get("*", "") if isinstance(html, dict) else html, "categories": [category_name(c) for c in got.get("categories") or []]}

    def titles(self, kind: str, good: Callable[[str], bool], limit: int | None = None, **params) -> Iterator[str]:
        """Titles of a list (allpages, categorymembers) in the main space, page after page until it ends or the limit is met."""
        more, given = {}, 0
        while True:
            got = self.ask(action="query", list=kind, **params, **more)
            for row in got.get("query", {}).get(kind, []):
                if row.get("ns", 0) == 0 and good(row["title"]):
                    yield row["title"]
                    given += 1
                    if limit is not None and given >= limit:
                        return
            more = got.get("continue") or {}
            if not more:
                return


def category_name(raw: str | Mapping) -> str:
    """The name of a category, given bare or as an object (Q22)."""
    name = raw if isinstance(raw, str) else raw.get("*") or raw.get("category") or raw.get("title") or ""
    return name.removeprefix("Category:").replace("_", " ").strip()


def compared(sources: Iterable[Mapping[str, str]], session, local: Callable[[Mapping[str, str]], str], timeout: float = 30) -> dict:
    """Each source's text as it is now against the one that is kept: same, changed or failed, with the number of each."""
    rows = []
    for s in sources:
        try:
            now = file_text(f"x.{s['preferred_format']}", fetched(s, session, timeout))
            have = local(s)
            rows.append({"doc_id": s["doc_id"], "status": "same" if now == have else "changed", "remote_chars": len(now), "local_chars": len(have)})
        except Exception as e:
            rows.append({"doc_id": s["doc_id"], "status": "failed", "error": str(e)})
    return {"checked": len(rows), **{k: sum(r["status"] == k for r in rows) for k in ("same", "changed", "failed")}, "sources": rows}
