"""Texts of files by their suffix: plain text, web pages, XML, with the forms of two publishers of statutes.

Markup needs a parser, which Spark has not, so files go through Arrow batches; each file is read alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "noscript"))


class Node:
    """An element of a page: its children are elements and texts."""

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes or {}, parent, []

    @property
    def kinds(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """The element and all below it, in page order."""
        yield self
        for child in self.children:
            if isinstance(child, Node):
                yield from child.walk()

    def texts(self) -> Iterator[str]:
        """The stripped texts below that are no code."""
        for child in self.children:
            if isinstance(child, str):
                if bare := child.strip():
                    yield bare
            elif child.tag not in SILENT:
                yield from child.texts()

    def text(self) -> str:
        return " ".join(" ".join(self.texts()).split())

    def markup(self) -> str:
        inner = "".join(escape(c, quote=False) if isinstance(c, str) else c.markup() for c in self.children)
        opened = "".join(f' {k}="{escape(v)}"' for k, v in self.attributes.items())
        return f"<{self.tag}{opened}>" + (inner + f"</{self.tag}>" if self.tag not in VOID else "")


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p" and self.at.parent:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def page_tree(html: str) -> Node:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


def html_text(html: str) -> str:
    """The texts of a page, one to a line; an Australian statute by its paragraphs' classes (H1, H2)."""
    page = page_tree(html)
    return australian_text(page) or "\n".join(line for t in page.texts() for x in t.splitlines() if (line := x.strip()))


def australian_text(page: Node) -> str | None:
    """The lines of a statute from its first section to the end notes, with numbers and names of headings on lines of their own; None for another page."""
    lines: list[str] = []
    schedule = ""
    for p in page.walk():
        if p.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "div") or not p.kinds:
            continue
        text, kinds = p.text(), p.kinds
        if not lines and not ("ActHead5" in kinds and text.split(None, 1)[:1] == ["1"] and text.lower().endswith("short title")):
            continue
        if "ENotesHeading1" in kinds:
            break
        first, _, rest = text.partition(" ")
        if "ActHead1" in kinds and first == "Schedule":
            schedule, _, name = (x.strip() for x in rest.partition("—"))
            lines += ["Schedule", schedule, "—", name]
        elif "ActHead5" in kinds and first[:1].isdigit():
            principle = "Australian Privacy Principle "
            lines += [first, principle.strip(), rest[len(principle) :]] if schedule == "1" and rest.startswith(principle) else [first, rest]
        elif schedule == "1" and re.fullmatch(r"\d+\.\d+", first) and rest:
            lines += [first, rest]
        elif text and p.tag != "div":
            lines.append(text)
    return "\n".join(x for x in lines if x) or None


def _name(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def _said(element: ElementTree.Element) -> str:
    return " ".join("".join(element.itertext()).split())


def _child(element: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((x for x in element if _name(x) == name), None)


def _body(element: ElementTree.Element, numbered: bool = True) -> str:
    """What a provision says, with its parts' numbers in brackets."""
    parts = [element.text or ""]
    for x in element:
        name = _name(x)
        if name == "Pnumber":
            parts.append(f" ({_said(x)}) " if numbered else "")
        elif name:
            parts.append(_body(x) if len(x) else _said(x))
        parts.append(x.tail or "")
    return " ".join(" ".join(parts).split())


def _british(root: ElementTree.Element) -> tuple[str, list[tuple[ElementTree.Element, ElementTree.Element, str]]]:
    """The document's address, and for each section its group, its element and its number in the address."""
    found, address = [], ""
    for group in root.iter():
        if _name(group) == "P1group":
            for p in group:
                at = p.get("DocumentURI", "")
                if _name(p) == "P1" and "/section/" in at:
                    address = address or at.split("/section/")[0]
                    if at.split("/section/")[0] == address:
                        found.append((group, p, at.split("/section/")[1]))
    return address, found


def british_text(root: ElementTree.Element) -> str | None:
    """Sections as number, title and body, then the schedules at the document's own address, by their paragraphs (H4); None for another document."""
    address, sections = _british(root)
    if not sections:
        return None
    parts = []
    for group, p, _ in sections:
        title, number = _child(group, "Title"), _child(p, "Pnumber")
        parts.append("\n".join(x for x in (_said(number) if number is not None else "", _said(title) if title is not None else "", _body(p, False)) if x))
    for schedule in root.iter():
        at = schedule.get("DocumentURI", "")
        if _name(schedule) != "Schedule" or not at.startswith(f"{address}/schedule/"):
            continue
        number, block = _child(schedule, "Number"), _child(schedule, "TitleBlock")
        title = _child(block, "Title") if block is not None else None
        name = _said(number) if number is not None else at.rsplit("/", 1)[1]
        lines = [name.upper() if name.lower().startswith("schedule") else f"SCHEDULE {name}", _said(title) if title is not None else ""]
        paragraphs = [p for p in schedule.iter() if _name(p) == "P1" and p.get("DocumentURI", "").startswith(f"{at}/paragraph/")]
        for p in paragraphs:
            lines += [f"Paragraph {p.get('DocumentURI').rsplit('/', 1)[1]}", _body(p, False)]
        if not paragraphs:
            lines.append(" ".join(_body(x) for x in schedule if _name(x) not in ("Number", "TitleBlock")))
        parts.append("\n".join(x for x in lines if x))
    return "\n\n".join(parts)


def british_revisions(root: ElementTree.Element) -> list[dict]:
    """For each section its title, status and dates, from its commentaries; an omission without a date is dated by the group's restriction (H5)."""
    notes = {x.get("id"): _said(x) for x in root.iter() if _name(x) == "Commentary"}
    out = []
    for group, p, number in _british(root)[1]:
        refs = list(dict.fromkeys(r for x in group.iter() for r in (x.get("Ref") if _name(x) == "CommentaryRef" else None, x.get("CommentaryRef")) if r in notes))
        said, title = _body(p, False), _child(group, "Title")

        def event(words: tuple[str, ...], refs=refs, number=number) -> str | None:
            for word in words:
                for r in refs:
                    m = re.search(rf"\bS\.\s*{re.escape(number)}\b.*?\b{word}\b.*?\((\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})\)", notes[r])
                    if m:
                        return f"{m.group(3)}-{int(m.group(2)):02d}-{int(m.group(1)):02d}"
            return None

        omitted = not any(c.isalnum() for c in said)
        restricted = group.get("RestrictStartDate") or p.get("RestrictStartDate")
        out.append({"section": number, "uri": p.get("DocumentURI"), "title": _said(title) if title is not None else None, "status": "omitted" if omitted else "active", "effective_from": event(("inserted",)), "effective_to": (event(("omitted", "repealed")) or restricted) if omitted else None, "restricted_from": restricted, "has_omitted_parts": not omitted and ". . . ." in said, "commentaries": [{"ref": r, "text": notes[r]} for r in refs]})
    return out


def xml_text(xml: str) -> str:
    """A statute by its sections, else the texts of all elements, one to a line; what is no XML is read as a page (H3)."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return html_text(xml)
    return british_text(root) or "\n".join(x for t in root.itertext() if (x := " ".join(t.split())))


def pdf_text(content: bytes) -> str:
    """The pages' texts (H6). The library is not part of this package; without it a PDF is an error."""
    import io

    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def file_text(name: str, content: bytes) -> str:
    """The text of a file by its suffix (S8); an unknown one is an error."""
    suffix = name[name.rfind(".") :].lower() if "." in name else ""
    if suffix == ".pdf":
        return pdf_text(content)
    readers = {".txt": str, ".html": html_text, ".htm": html_text, ".xml": xml_text}
    if suffix not in readers:
        raise ValueError(f"no reader for {name!r}")
    return readers[suffix](content.decode("utf-8", "replace"))


def read_file_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("path").to_pylist()
            texts = [file_text(n, c.as_py() or b"") for n, c in zip(names, b.column("content"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, text string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the files of a folder."""
    return read_file_list(spark, path)


REVISIONS = "path string, section string, uri string, title string, status string, effective_from string, effective_to string, restricted_from string, has_omitted_parts boolean, commentaries array<struct<ref:string,text:string>>"


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """A row for each section of the statutes among the XML files of a folder, with its status and dates."""
    return read_revision_list(spark, path)


def read_revision_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same for some files or folders."""
    schema = pa.schema([(n, pa.string()) for n in ("path", "section", "uri", "title", "status", "effective_from", "effective_to", "restricted_from")] + [("has_omitted_parts", pa.bool_()), ("commentaries", pa.list_(pa.struct([("ref", pa.string()), ("text", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": n, **r} for n, c in zip(b.column("path").to_pylist(), b.column("content"), strict=True) for r in british_revisions(ElementTree.fromstring(c.as_py()))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(paths).select("path", "content").mapInArrow(run, REVISIONS)


def pagination_urls(html: str, base: str) -> list[str]:
    """Addresses of a text's further pages, each once, without the page itself (H7)."""
    links = (urljoin(base, a.attributes.get("href", "")) for a in page_tree(html).walk() if a.tag == "a" and "page-Article" in a.kinds and a.attributes.get("href"))
    return list(dict.fromkeys(x for x in links if x != base))


def article_fragment(html: str) -> str:
    """The markup of a page's own part, without its page links: the element BodyLabel, else content, else the body (H7)."""
    page = page_tree(html)
    nodes = list(page.walk())
    body = next((n for name in ("BodyLabel", "content") for n in nodes if n.attributes.get("id") == name), None) or next((n for n in nodes if n.tag == "body"), page)
    for n in list(body.walk()):
        n.children = [c for c in n.children if isinstance(c, str) or not (c.tag == "a" and "page-Article" in c.kinds)]
    return "".join(escape(c, quote=False) if isinstance(c, str) else c.markup() for c in body.children)


def combined_pages(pages: list[str]) -> str:
    """One page of the parts of several."""
    return "<html><body>" + "\n".join(article_fragment(p) for p in pages) + "</body></html>"


def embedded_document_url(html: str, base: str) -> str | None:
    """Where the frame of an electronic book points (H8)."""
    return next((urljoin(base, n.attributes["src"]) for n in page_tree(html).walk() if n.tag == "iframe" and n.attributes.get("id") == "epubFrame" and n.attributes.get("src")), None)

