"""Structural parsing of documents into citable units: one Arrow pass over documents, a rule set for each family.

A text is taken as its lines. A rule set says which lines are headings, by what they begin with, in which stretch of
the text, and in what order their numbers come; a unit runs from its heading to the next one, without white space
at its end. Nesting and order need state along a text, which Spark expressions have not, so the walk is
plain Python in each batch; documents are independent and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = (
    "unit_id string, source_doc_id string, parent_id string, jurisdiction string, law_name string, version string, unit_type string, canonical_citation string, local_citation string, "
    "text string, span_ids array<string>, char_start bigint, char_end bigint, parser_confidence double, effective_from string, effective_to string, is_current boolean"
)
#: Fixed names by which the laws of these families are cited.
LABELS = {"eu_gdpr": "GDPR", "eu_ai_act": "EU AI Act", "eu_data_act": "EU Data Act", "eu_data_governance_act": "EU Data Governance Act", "eu_dsa": "Digital Services Act", "eu_nis2": "NIS2 Directive", "china_pipl": "PIPL", "china_dsl": "Data Security Law", "china_csl": "Cybersecurity Law"}
#: Roman numerals of nested points.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
#: Chinese numerals.
HAN = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
HAN_UNITS = {"十": 10, "百": 100, "千": 1000}
#: What follows a number at the start of a line that opens no section (references, page headers).
NO_HEADING_OPENS = ("no. ", "u.s.c", "fr ", "ch ", "sec. ")
NO_HEADING_HOLDS = ("government gazette", "legislative history", "revised edition", "the gazette of india", "[part ii", "[p art ii")
#: Names of schedules.
ORDINALS = ("FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH", "TENTH", "ELEVENTH", "TWELFTH")


@dataclass(frozen=True)
class Unit:
    """Stretches of the text (one, unless lines between are left out); key is the last part of its id, local its citation within the document."""

    kind: str
    key: str
    local: str
    pieces: tuple[tuple[int, int], ...]
    confidence: float
    parent: "Unit | None" = None
    cited_as: str | None = None

    def path(self) -> str:
        return f"{self.parent.path()}:{self.key}" if self.parent else self.key


class Line(NamedTuple):
    """A line without white space at its ends, and where it stands."""

    text: str
    start: int
    end: int


class Head(NamedTuple):
    """A heading: where its unit begins, where what follows the heading begins, its number, and a title if it has one."""

    start: int
    after: int
    number: str
    title: str = ""


def lines_of(text: str) -> list[Line]:
    """The lines that hold more than white space."""
    out, at = [], 0
    for whole in text.split("\n"):
        if bare := whole.strip():
            begin = at + whole.index(bare)
            out.append(Line(bare, begin, begin + len(bare)))
        at += len(whole) + 1
    return out


def digits_at(text: str, at: int = 0) -> str:
    end = at
    while end < len(text) and text[end] in "0123456789":
        end += 1
    return text[at:end]


class Numbered(NamedTuple):
    """What a line begins with: a number ("12", "12A"), the sign after it, and the rest."""

    number: str
    sign: str
    rest: str


def numbered_of(text: str) -> Numbered | None:
    number = digits_at(text)
    if not number:
        return None
    at = len(number)
    if text[at : at + 1].isupper() and text[at].isascii() and not text[at + 1 : at + 2].isalpha():
        number, at = text[: at + 1], at + 1
    sign = "." if text[at : at + 1] == "." else ""
    rest = text[at + len(sign) :]
    if not sign and rest and not rest[0].isspace():
        return None
    return Numbered(number, sign, rest.strip())


def dotted_of(text: str) -> tuple[str, str] | None:
    """A dotted number ("4.1.1") at the start of a line, and the rest."""
    parts, at = [], 0
    while found := digits_at(text, at):
        parts.append(found)
        at += len(found)
        if text[at : at + 1] == "." and digits_at(text, at + 1):
            at += 1
        else:
            break
    return (".".join(parts), text[at:]) if parts else None


def bracketed_of(text: str) -> str | None:
    """What stands in the bracket that a line begins with: "a" of "(a) text"."""
    close = text.find(")")
    inner = text[1:close] if text[:1] == "(" and 1 < close < 8 else ""
    return inner if inner.isascii() and inner.isalnum() else None


def is_title(text: str, least: int = 3) -> bool:
    """Whether what follows a number is a section's title (F8)."""
    bare = text.lstrip("\"'“”‘’().… \t")
    low = text.lower()
    if not bare[:1].isupper() or not bare[:1].isascii() or not least <= len(bare) <= 161 or len(text) > 180:
        return False
    return not (low.startswith(NO_HEADING_OPENS) or low.replace(" ", "").startswith("part") or any(x in low for x in NO_HEADING_HOLDS))


def ordered(number: str) -> tuple[int, str]:
    """A number's place: 12, 12A, 13."""
    plain = digits_at(number)
    return int(plain), number[len(plain) :]


def cut(text: str, opened: Iterable[Head], limit: int, without: Iterable[Line] = ()) -> Iterator[tuple[Head, tuple[tuple[int, int], ...]]]:
    """Each heading with the stretches of its unit, which ends at the next heading; lines of `without` are left out."""
    opened, without = list(opened), list(without)
    for i, head in enumerate(opened):
        end = opened[i + 1].start if i + 1 < len(opened) else limit
        pieces, at = [], head.start
        for line in [*without[bisect_right(without, head.start, key=_start) : bisect_left(without, end, key=_start)], Line("", end, end)]:
            if kept := text[at : line.start].rstrip():
                pieces.append((at, at + len(kept)))
            at = min(line.end + 1, end)
        if pieces:
            yield head, tuple(pieces)


def _start(line: Line) -> int:
    return line.start


def between(lines: list[Line], lo: int, hi: int) -> list[Line]:
    """The lines, which are in order, that begin in a stretch; found by bisection, as a law asks this for each of its articles."""
    return lines[bisect_left(lines, lo, key=_start) : bisect_left(lines, hi, key=_start)]


def first(lines: Iterable[Line], test: Callable[[str], bool]) -> Line | None:
    return next((x for x in lines if test(x.text)), None)


# European Union and China


def _letters(lines: list[Line]) -> list[Head]:
    """Points (a), (b) ... in rising order; a letter that is a Roman numeral too is nested if a colon stands right before it."""
    out: list[Head] = []
    for before, x in zip([None, *lines], lines, strict=False):
        name = bracketed_of(x.text)
        if name and len(name) == 1 and name.islower():
            rises = not out or name > out[-1].number
            nested = out and name in ROMAN and before.text.endswith(":")
            if rises and not nested:
                out.append(Head(x.start, x.start + 3, name))
    return out


def eu(text: str, _: dict) -> Iterator[Unit]:
    """Recitals before the adoption words; then articles, their paragraphs, points and nested points."""
    lines = lines_of(text)
    adopted = text.find("HAVE ADOPTED")
    recitals = [Head(x.start, x.start, n) for x in between(lines, 0, adopted) if (n := bracketed_of(x.text)) and n.isdigit() and len(n) <= 3]
    for h, pieces in cut(text, recitals, adopted):
        yield Unit("recital", f"recital_{h.number}", f"Recital {h.number}", pieces, 0.9)
    rest = between(lines, max(adopted, 0), len(text))
    annex = first(rest, lambda t: t == "ANNEX" or t.startswith("ANNEX") and not (t[5].isalnum() or t[5] == "_"))
    rest = between(rest, 0, limit := annex.start if annex else len(text))
    opened = []
    for x in rest:
        words = x.text.split()
        if len(words) == 2 and words[0] == "Article" and (n := digits_at(words[1])) and (words[1] == n or words[1][len(n) :].isalpha() and len(words[1]) == len(n) + 1):
            opened.append(Head(x.start, x.end, words[1]))
    for h, ((start, end),) in cut(text, opened, limit):
        signed = first(between(rest, start, end), lambda t: t.startswith("Done at"))
        end = start + len(text[start : signed.start].rstrip()) if signed else end
        article = Unit("article", f"article_{h.number.lower()}", f"Article {h.number}", ((start, end),), 0.9)
        yield article
        yield from _eu_parts(text, between(rest, h.after, end), article, end)


def _eu_parts(text: str, lines: list[Line], article: Unit, limit: int) -> Iterator[Unit]:
    opened = []
    for x in lines:
        number = digits_at(x.text)
        if number and x.text[len(number) : len(number) + 1] == ".":
            opened.append(Head(x.start, x.start, number))
        elif (inner := bracketed_of(x.text)) and inner.isdigit():
            opened.append(Head(x.start, x.start, inner))
    for h, ((start, end),) in cut(text, opened, limit):
        paragraph = Unit("paragraph", f"paragraph_{h.number}", f"{article.local}({h.number})", ((start, end),), 0.88, article)
        yield paragraph
        own = between(lines, start, end)
        for p, ((p_start, p_end),) in cut(text, _letters(own), end):
            point = Unit("point", f"point_{p.number}", f"{paragraph.local}({p.number})", ((p_start, p_end),), 0.86, paragraph)
            yield point
            nested = [Head(x.start, x.start, n) for x in between(own, p.after, p_end) if (n := bracketed_of(x.text)) in ROMAN]
            for r, pieces in cut(text, nested, p_end):
                yield Unit("point", f"point_{r.number}", f"{point.local}({r.number})", pieces, 0.84, point)


def han_number(text: str) -> int | None:
    """A Chinese or Arabic numeral; None if it is neither."""
    if text.isdigit():
        return int(text)
    total = now = 0
    for c in text:
        if c in HAN_UNITS:
            total, now = total + max(now, 1) * HAN_UNITS[c], 0
        elif c in HAN:
            now = HAN[c]
        else:
            return None
    return total + now if text else None


def china(text: str, _: dict) -> Iterator[Unit]:
    opened = []
    for x in lines_of(text):
        close = x.text.find("条")
        numeral = x.text[1:close]
        if x.text[0] == "第" and close > 1 and all(c in HAN or c in HAN_UNITS or c.isdigit() for c in numeral) and (close + 1 == len(x.text) or x.text[close + 1].isspace()):
            opened.append(Head(x.start, x.start, x.text[: close + 1]))
    for h, pieces in cut(text, opened, len(text)):
        number = han_number(h.number[1:-1])
        key = str(number) if number is not None else h.number
        yield Unit("article", f"article_{key}", h.number, pieces, 0.9 if number is not None else 0.75, cited_as=f"Article {key}")


# United States


def cfr(text: str, doc: dict) -> Iterator[Unit]:
    """Sections "§ n.n", with any number of dots; the volume is the number before CFR in the title."""
    words = (doc["title"] or "").replace(".", "").split()
    volume = next((f"{a} CFR " for a, b in zip(words, words[1:], strict=False) if a.isdigit() and b == "CFR"), "")
    opened = []
    for x in lines_of(text):
        found = dotted_of(x.text[1:].lstrip()) if x.text[0] == "§" else None
        if found and "." in found[0] and not (found[1][:1].isalnum() or found[1][:1] == "_"):
            opened.append(Head(x.start, x.start, found[0]))
    for h, pieces in cut(text, opened, len(text)):
        yield Unit("section", "section_" + h.number.replace(".", "_"), f"§ {h.number}", pieces, 0.9, cited_as=f"{volume}§ {h.number}")


def california(text: str, _: dict) -> Iterator[Unit]:
    """Numbers of the Civil Code alone on a line, unless the line before ends in the word section: that one is a reference."""
    opened, before = [], ""
    for x in lines_of(text):
        found = dotted_of(x.text)
        alone = found is not None and found[1] == "." and "." in found[0] and 3 <= len(digits_at(found[0])) <= 4
        if alone and not (" " + before.lower()).endswith((" section", " sections")):
            opened.append(Head(x.start, x.start, found[0]))
        before = x.text
    for h, pieces in cut(text, opened, len(text)):
        yield Unit("section", "section_" + h.number.replace(".", "_"), h.number, pieces, 0.8, cited_as=f"California Civil Code § {h.number}")


# Numbered sections and schedules


def _sections(text: str, doc: dict, opened: Iterable[Head], limit: int, without: Iterable[Line] = ()) -> Iterator[Unit]:
    """A repeated number is skipped, but still ends the unit before it."""
    seen: set[str] = set()
    for h, pieces in cut(text, opened, limit, without):
        if h.number not in seen:
            seen.add(h.number)
            yield Unit("section", f"section_{h.number.lower()}", f"Section {h.number}", pieces, 0.75, cited_as=f"{doc['title']} Section {h.number}")


def _clause(doc: dict, local: str, pieces: tuple[tuple[int, int], ...], title: str = "") -> Unit:
    """A part of a schedule."""
    key = re.sub(r"[^a-z0-9]+", "_", local.lower()).strip("_")
    return Unit("schedule_clause", key, local, pieces, 0.8, cited_as=f"{doc['title']} {local}" + (f" ({title})" if title else ""))


def _titled(lines: list[Line]) -> list[Head]:
    """Lines of a number and a title."""
    return [Head(x.start, x.end, n.number, n.rest) for x in lines if (n := numbered_of(x.text)) and is_title(n.rest)]


def _alone(lines: list[Line]) -> list[Head]:
    """Numbers alone on their line before a line that is a title."""
    out = []
    for x, after in zip(lines, lines[1:], strict=False):
        n = numbered_of(x.text)
        if n and not n.sign and not n.rest and is_title(after.text):
            out.append(Head(x.start, x.end, n.number, after.text))
    return out


def _rising(opened: Iterable[Head], most: int | None = None, ties: bool = False, key: Callable[[str], object] = ordered) -> list[Head]:
    """Those headings whose numbers go on from the one before (or repeat it, with ties), up to the law's last one."""
    out: list[Head] = []
    for h in opened:
        goes_on = not out or key(h.number) > key(out[-1].number) or ties and key(h.number) == key(out[-1].number)
        if goes_on and (most is None or ordered(h.number)[0] <= most):
            out.append(h)
    return out


def numbered(text: str, doc: dict) -> Iterator[Unit]:
    return _sections(text, doc, _titled(lines_of(text)), len(text))


def _or_numbered(found: list[Unit], text: str, doc: dict) -> Iterator[Unit]:
    yield from found or numbered(text, doc)


def singapore(text: str, doc: dict) -> Iterator[Unit]:
    """Sections up to the legislative history, as "1 Title" or as a title line before "1. Text"; then the schedules by their names."""
    lines = lines_of(text)
    history = first(lines, lambda t: t.lower().startswith("legislative history"))
    lines = between(lines, 0, limit := history.start if history else len(text))
    names = {f"{x} SCHEDULE": f"{x.capitalize()} Schedule" for x in ORDINALS}
    schedules = [Head(x.start, x.end, names[x.text]) for x in lines if x.text in names]
    body = between(lines, 0, end := schedules[0].start if schedules else limit)
    opened = [h for h, x in ((h, text[h.start : h.after]) for h in _titled(body)) if numbered_of(x).sign == ""]
    if not opened:  # numbers can be broken by spaces there
        for before, x in zip([None, *body], body, strict=False):
            number = x.text.split(".")[0] if "." in x.text[:8] else ""
            after = x.text[len(number) + 1 :].lstrip()
            if number[:1].isdigit() and (n := numbered_of("".join(number.split()))) and not n.rest and not n.sign and (after[:1].isupper() or after[:1] in ("—", "(")):
                titled = before is not None and not before.text.endswith((".", ";", ":", ",")) and is_title(before.text)
                opened.append(Head(before.start if titled else x.start, x.end, n.number))
    yield from _sections(text, doc, opened, end)
    seen: set[str] = set()
    for h, pieces in cut(text, schedules, limit):
        if h.number not in seen:
            seen.add(h.number)
            yield _clause(doc, h.number, pieces)


def hong_kong(text: str, doc: dict) -> Iterator[Unit]:
    """Lines "Section: n title" and "Schedule: n title"; the first schedule by its principles."""
    lines = lines_of(text)
    kinds, opened = {}, []
    for x in lines:
        kind, colon, rest = x.text.partition(":")
        found = numbered_of(rest.strip()) if colon and kind in ("Section", "Schedule") else None
        if found and found.rest:
            opened.append(Head(x.start, x.end, found.number))
            kinds[x.start] = kind
    seen: set[str] = set()
    for h, ((start, end),) in cut(text, opened, len(text)):
        local = f"{kinds[start]} {h.number}"
        if local in seen:
            continue
        seen.add(local)
        if kinds[start] == "Section":
            yield Unit("section", f"section_{h.number.lower()}", local, ((start, end),), 0.75, cited_as=f"{doc['title']} {local}")
            continue
        principles = [Head(x.start, x.end, p) for x in between(lines, h.after, end) if (n := numbered_of(x.text)) and n.sign and n.rest.startswith("Principle ") and (p := digits_at(n.rest, 10))]
        for p, pieces in cut(text, principles, end):
            yield _clause(doc, f"{local} Principle {p.number}", pieces)
        if not principles:
            yield _clause(doc, local, ((start, end),))


def india(text: str, doc: dict) -> Iterator[Unit]:
    """Sections "1. Text" by their first occurrence; then the table of penalties, which the page gives column by column."""
    lines = lines_of(text)
    plain = lambda t: " ".join(t.split()).lower()
    table = first(lines, lambda t: plain(t).startswith("breach of provisions of this act"))
    end = table.start if table else len(text)
    opened = []
    for x in between(lines, 0, end):
        n = numbered_of(x.text)
        if n and n.sign and (n.rest[:1].isupper() or n.rest[:1] == "(") and not any(y in plain(x.text) for y in NO_HEADING_HOLDS):
            opened.append(Head(x.start, x.end, n.number))
    yield from _sections(text, doc, opened, end)
    if not table:
        return
    rest = between(lines, table.start, len(text))
    # the column heads: each has its number in brackets on the next line
    at = {inner: i for i, x in enumerate(rest) if (inner := bracketed_of(x.text)) in ("1", "2", "3") and len(x.text) == 3}
    closing = next((i for i, x in enumerate(rest) if i and plain(x.text) in ("the schedule", "schedule")), len(rest))
    columns: list[list[tuple[int, int]]] = []
    for name in "123":
        begin = at.get(name, closing)
        stop = min([i - 1 for i in at.values() if i > begin] + [closing])
        items: list[tuple[int, int]] = []
        for x, before in zip(rest[begin + 1 : stop], [None, *rest[begin + 1 : stop]], strict=False):
            if before is None or before.text.endswith("."):
                items.append((x.start, x.end))
            else:
                items[-1] = (items[-1][0], x.end)
        columns.append(items)
    numbers, breaches, penalties = columns
    if numbers and len(numbers) == len(breaches) == len(penalties):
        for (a, b), breach, penalty in zip(numbers, breaches, penalties, strict=True):
            number = text[a:b].rstrip(".")
            yield Unit("schedule_clause", f"schedule_item_{number}", f"Schedule item {number}", (breach, penalty), 0.8, cited_as=f"{doc['title']} Schedule item {number}")
    else:
        yield _clause(doc, "Schedule", ((table.start, rest[closing - 1].end),))


def canada(text: str, doc: dict) -> Iterator[Unit]:
    """Section numbers alone on their line; then the clauses of the first schedule."""
    lines = lines_of(text)
    schedules = [x for x in lines if x.text.upper().startswith("SCHEDULE ") and digits_at(x.text, 9) == x.text[9:]]
    one = first(schedules, lambda t: t[9:] == "1")
    end = one.start if one else len(text)
    place = lambda number: tuple(map(int, number.split(".")))
    alone = [Head(x.start, x.end, n[0]) for x in between(lines, 0, end) if (n := dotted_of(x.text)) and not n[1]]
    opened = []
    for h in alone:
        if not opened or place(h.number) > place(opened[-1].number):
            opened.append(h)
    found = list(_sections(text, doc, opened, end))
    if one:
        other = next((x.start for x in schedules if x.start > one.start), len(text))
        clauses = []
        for x in between(lines, one.end, other):
            n = dotted_of(x.text)
            if n and "." in n[0] and (not n[1] or n[1][0].isspace() and is_title(n[1].strip())):
                clauses.append(Head(x.start, x.end, n[0]))
        seen: set[str] = set()
        for h, pieces in cut(text, clauses, other):
            if h.number not in seen:
                seen.add(h.number)
                found.append(_clause(doc, f"Schedule 1 clause {h.number}", pieces))
    yield from _or_numbered(found, text, doc)


def malaysia(text: str, doc: dict) -> Iterator[Unit]:
    """Sections of the English text, which the words "An Act to" open after both lists of contents; numbers only rise."""
    lines = lines_of(text)
    enacted = first(lines, lambda t: t.startswith("An Act to"))
    body = between(lines, enacted.start if enacted else 0, len(text))
    marked = [Head(x.start, x.end, n.number) for x in body if (n := numbered_of(x.text)) and n.sign and n.number.isdigit() and (n.rest[:1] == "(" or n.rest[:1].isupper())]
    yield from _or_numbered(list(_sections(text, doc, _rising(marked, 146), len(text))), text, doc)


def united_kingdom(text: str, doc: dict) -> Iterator[Unit]:
    """Rising section numbers, alone before their title or beside it (the official title, where it is known); then schedules by their paragraphs."""
    lines = lines_of(text)
    schedules = [Head(x.start, x.end, x.text.split()[1]) for x in lines if x.text.startswith("SCHEDULE ") and len(x.text.split()) == 2]
    body = between(lines, 0, end := schedules[0].start if schedules else len(text))
    known = {str(k): " ".join(v.split()).lower() for k, v in dict(doc.get("section_titles") or {}).items() if v}
    opened = sorted([*_alone(body), *_titled(body)])
    if known:
        opened = [h for h in opened if known.get(h.number) == " ".join(h.title.split()).lower()]
    yield from _sections(text, doc, _rising(opened), end)
    for h, ((start, stop),) in cut(text, schedules, len(text)):
        own = between(lines, h.after, stop)
        title = own[0].text if own and not own[0].text.startswith("Paragraph ") else ""
        paragraphs = []
        for x in own:
            words = x.text.split()
            if len(words) == 2 and words[0] == "Paragraph" and digits_at(words[1]):
                paragraphs.append(Head(x.start, x.end, words[1]))
        for p, pieces in cut(text, paragraphs, stop):
            yield _clause(doc, f"Schedule {h.number} paragraph {p.number}", pieces, title)
        if not paragraphs:
            yield _clause(doc, f"Schedule {h.number}", ((start, stop),), title)


def australia(text: str, doc: dict) -> Iterator[Unit]:
    """Three stretches: the body, the principles of the first schedule, and the second schedule. Numbers alone on their line, or beside their title."""
    lines = lines_of(text)
    enacted = first(lines, lambda t: t.upper().startswith("BE IT THEREFORE ENACTED"))
    lines = between(lines, enacted.end if enacted else 0, len(text))
    notes = first(lines, lambda t: t == "Endnotes")
    lines = between(lines, 0, limit := notes.start if notes else len(text))
    # a schedule's name can stand on one line or on several: Schedule, its number, a dash, its title
    at: dict[str, int] = {}
    for i, x in enumerate(lines):
        words = " ".join(y.text for y in lines[i : i + 4]).replace("—", " ").split()
        if x.text.split("—")[0].split()[:1] == ["Schedule"] and len(words) > 2 and words[0] == "Schedule" and words[1] in ("1", "2") and (x.text == "Schedule" or "—" in x.text):
            at.setdefault(words[1], x.start)
    one, two = at.get("1", at.get("2", limit)), at.get("2", limit)
    body = between(lines, 0, one)
    base = lambda number: ordered(number)[0]
    yield from _sections(text, doc, _rising(sorted([*_alone(body), *_titled(body)]), ties=True, key=base), one)
    principles, own = [], between(lines, one, two)
    for x, after in zip(own, own[1:], strict=False):
        n = dotted_of(x.text)
        if n and not n[1] and ("." in n[0] or after.text.startswith("Australian Privacy Principle")):
            principles.append(Head(x.start, x.end, n[0]))
    seen: set[str] = set()
    for h, pieces in cut(text, principles, two):
        if h.number not in seen:
            seen.add(h.number)
            yield Unit("schedule_clause", "app_" + h.number.replace(".", "_"), f"APP {h.number}", pieces, 0.8, cited_as=f"{doc['title']} APP {h.number}")
    own = between(lines, two, limit)[2:]
    for h, pieces in cut(text, _rising(sorted([*_alone(own), *_titled(own)])), limit):
        yield _clause(doc, f"Schedule 2 clause {h.number}", pieces)


def south_africa(text: str, doc: dict) -> Iterator[Unit]:
    """Sections of the body, which the last "CHAPTER 1" opens and a schedule ends, without the gazette's page headers; numbers only rise."""
    lines = lines_of(text)
    noise = [x for x in lines if "government gazette" in x.text.lower() or x.text.startswith("Act No.") and any(y in x.text for y in (" of 19", " of 20"))]
    opening = [x.start for x in lines if x.text.upper() == "CHAPTER 1"]
    body = between(lines, opening[-1] if opening else 0, len(text))
    schedule = first(body, lambda t: t.upper() == "SCHEDULE")
    body = between(body, 0, end := schedule.start if schedule else len(text))
    heads = {x.start for x in noise}
    marked = [Head(x.start, x.end, n.number) for x in body if x.start not in heads and (n := numbered_of(x.text)) and n.sign and n.rest]
    yield from _or_numbered(list(_sections(text, doc, _rising(marked, 115), end, noise)), text, doc)


def philippines(text: str, doc: dict) -> Iterator[Unit]:
    """Lines "Section n." """
    opened = []
    for x in lines_of(text):
        word, _, rest = x.text.partition(" ")
        n = numbered_of(rest.strip()) if word.lower() == "section" else None
        if n and n.sign:
            opened.append(Head(x.start, x.end, n.number))
    yield from _or_numbered(list(_sections(text, doc, opened, len(text))), text, doc)


# Articles of Japan, Korea and Brazil


def _article_of(line: str) -> tuple[str, str, bool] | None:
    """The number of an article that a line opens, what the line says of its matter, and whether it was taken out of the law."""
    bare = line[1:].lstrip() if line[:1] == "." else line
    word, _, rest = bare.partition(" ")
    rest = rest.lstrip()
    number = digits_at(rest) if word in ("Article", "Art.") else ""
    if not number:
        return None
    rest = rest[len(number) :]
    if rest.lstrip()[:1] == "-":  # a number of two parts, "7-2" or "55 -A"
        second = rest.lstrip()[1:].lstrip()
        part = digits_at(second)
        part += second[len(part) : len(part) + 1] if second[len(part) : len(part) + 1].isupper() else ""
        if not part or second[len(part) : len(part) + 1].isalnum():
            return None
        number, rest = f"{number}-{part}", second[len(part) :]
    said = rest.strip()
    gone = rest[:1].isspace() and said.split(None, 1)[:1] in (["Deleted"], ["Deleted."], ["Omitted"], ["Omitted."])
    if not said or said == "." or gone or said[0] == "(" and said[-1] == ")" and rest[0].isspace():
        return number, "", gone
    if said[0] == "." and said[1:2].isspace():
        return number, said[1:].strip(), False
    return None


def _says_something(said: str) -> bool:
    """Whether a body has a sentence: a word, and a sign that ends or divides one after it."""
    word = re.search(r"[A-Za-z]{3}", said)
    return bool(word) and any(c in ".;:" for c in said[word.end() :])


def articles(text: str, doc: dict) -> Iterator[Unit]:
    """Of several headings with a number (contents, body, addenda) the first with a real body, else the first. Japan's body begins where its first article has one and the second follows."""
    opened: list[tuple[Head, bool]] = []
    for x in lines_of(text):
        if found := _article_of(x.text):
            start = x.start + (len(x.text) - len(x.text[1:].lstrip()) if x.text[0] == "." else 0)
            opened.append((Head(start, x.end, found[0], found[1]), found[2]))
    parts = list(cut(text, [h for h, _ in opened], len(text)))
    gone = {h.start for h, taken in opened if taken}
    real = [h.start in gone or _says_something(f"{h.title} {text[h.after : pieces[-1][1]]}") for h, pieces in parts]
    begin = 0
    if doc["law_family"] == "japan_appi":
        numbers = [h.number for h, _ in parts]
        begin = next((i for i in range(len(parts)) if real[i] and numbers[i : i + 2] == ["1", "2"]), 0)
    best: dict[str, int] = {}
    for i in range(begin, len(parts)):
        number = parts[i][0].number
        if number not in best or real[i] and not real[best[number]]:
            best[number] = i
    for i in sorted(best.values()):
        number, pieces = parts[i][0].number, parts[i][1]
        yield Unit("article", f"article_{number.lower()}", f"Article {number}", pieces, 0.75, cited_as=f"{doc['title']} Article {number}")


PARSERS: dict[str, Callable[[str, dict], Iterator[Unit]]] = {
    **dict.fromkeys(("eu_gdpr", "eu_ai_act", "eu_data_act", "eu_data_governance_act", "eu_dsa", "eu_nis2"), eu),
    **dict.fromkeys(("china_pipl", "china_dsl", "china_csl"), china),
    "us_cfr": cfr,
    "us_state_privacy": california,
    **dict.fromkeys(("japan_appi", "korea_pipa", "brazil_lgpd"), articles),
    "philippines_dpa": philippines,
    "south_africa_popia": south_africa,
    "malaysia_pdpa": malaysia,
    "hong_kong_pdpo": hong_kong,
    "singapore_pdpa": singapore,
    "india_dpdp": india,
    "uk_dpa": united_kingdom,
    "canada_pipeda": canada,
    "australia_privacy_act": australia,
}


def register(family: str, parser: Callable[[str, dict], Iterator[Unit]]) -> None:
    """Adds or replaces a family's rule set in this process; tasks get the one that the driver has when a plan is made."""
    PARSERS[family] = parser


def _row(doc: dict, unit: Unit) -> dict:
    parts = [doc["raw_text"][a:b] for a, b in unit.pieces]
    text = "\n".join(parts)
    spans = [hashlib.sha1("::".join((doc["doc_id"], str(a), part[:80])).encode()).hexdigest()[:16] for (a, _), part in zip(unit.pieces, parts, strict=True)]
    label = LABELS.get(doc["law_family"], doc["title"])
    cited = unit.cited_as if unit.cited_as and not unit.cited_as.startswith("Article") else f"{label} {unit.cited_as or unit.local}"
    return {
        "unit_id": f"{doc['doc_id']}:{unit.path()}", "source_doc_id": doc["doc_id"], "parent_id": f"{doc['doc_id']}:{unit.parent.path()}" if unit.parent else None, "jurisdiction": doc["jurisdiction"], "law_name": doc["title"], "version": doc["version_date"],
        "unit_type": unit.kind, "canonical_citation": cited, "local_citation": unit.local, "text": text, "span_ids": [f"{doc['doc_id']}:span:{x}" for x in spans], "char_start": unit.pieces[0][0], "char_end": unit.pieces[-1][1], "parser_confidence": unit.confidence,
        "effective_from": doc["effective_date"], "effective_to": None, "is_current": True,
    }


#: Units that go on to Spark at once, and the characters of their texts: a law's units are never held together.
ROWS_MOST, ROWS_CHARS = 2000, 4 << 20


def parse_units(documents: DataFrame) -> DataFrame:
    """Units of documents(doc_id, title, jurisdiction, law_family, version_date, effective_date, raw_text); an unknown family is an error.

    An optional column section_titles (a map) holds official titles by section number. A unit of several stretches
    has a span for each, and its text joins them by line breaks.
    """
    parsers = dict(PARSERS)
    more = [c for c in ("section_titles",) if c in documents.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (doc,) = batch.slice(i, 1).to_pylist()
                if doc["law_family"] not in parsers:
                    raise ValueError(f"no parser for the family {doc['law_family']!r} of {doc['doc_id']}")
                rows, held = [], 0
                for unit in parsers[doc["law_family"]](doc["raw_text"] or "", doc):
                    rows.append(_row(doc, unit))
                    held += len(rows[-1]["text"])
                    if held >= ROWS_CHARS or len(rows) >= ROWS_MOST:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return documents.select("doc_id", "title", "jurisdiction", "law_family", "version_date", "effective_date", "raw_text", *more).mapInArrow(run, UNITS)


_ARROW = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in UNITS.split(", "))])


def without_units(documents: DataFrame, units: DataFrame) -> DataFrame:
    """Documents that no unit came from."""
    return documents.join(units.select(F.col("source_doc_id").alias("doc_id")).distinct(), "doc_id", "left_anti")


def with_revisions(units: DataFrame, revisions: DataFrame) -> DataFrame:
    """Sections overlaid with revisions(source_doc_id, section, status, effective_from, effective_to); the rest as it was."""
    r = revisions.select("source_doc_id", F.concat(F.lit("Section "), F.col("section")).alias("local_citation"), "status", F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"))
    rows = units.join(r, ["source_doc_id", "local_citation"], "left")
    known = F.col("status").isNotNull() & (F.col("unit_type") == "section")
    return rows.withColumns({"effective_from": F.when(known, F.coalesce("_from", "effective_from")).otherwise(F.col("effective_from")), "effective_to": F.when(known, F.col("_to")).otherwise(F.col("effective_to")), "is_current": F.when(known, F.col("status") != "omitted").otherwise(F.col("is_current"))}).select(*units.columns)
