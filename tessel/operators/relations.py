"""Citations in unit texts: extraction with target documents, resolution to units, and merged relations.

A text is read once into tokens: citation words, locators, points, names of documents, joining
words, ends of clauses. References are then found by a walk over the tokens, and a
reference's document by what stands beside it, so no pattern looks around in the text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import relation_id

#: The words that open a citation, with the kind they name.
KINDS = {"article": "Article", "articles": "Article", "section": "Section", "sections": "Section", "recital": "Recital", "recitals": "Recital", "§": "§", "§§": "§"}
#: Instruments that a text can name without an alias being known.
INSTRUMENTS = frozenset(("regulation", "directive", "act", "convention", "charter", "treaty", "protocol", "constitution", "gdpr"))
POINTS = frozenset(("point", "points", "paragraph", "paragraphs"))
#: A locator as it is written, "6", "12.3", "5a", "6(1)(f)"; and an article in Chinese.
LOCATOR = r"\d+(?:\.\d+)*[A-Za-z]?(?:\([0-9A-Za-z]+\))*"
CHINESE = r"第[零〇一二三四五六七八九十百千万两\d]+条"
#: Longest ranges that are spelled out, and the reach of a name in characters: after a reference, before it, and across signs.
RANGE, AFTER, BEFORE, SIGNS = 200, 240, 180, 30
REFERENCES = "unit_id string, doc_id string, target_doc string, requested string, alias string, char_start bigint, char_end bigint, citation_text string, excerpt string"


class Token(NamedTuple):
    """kind: name, han, locator, part, word, other (a character of no word), comma, end or sign."""

    kind: str
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower()


class Reader:
    """Reads texts into tokens; names maps document ids to the names by which they are cited."""

    def __init__(self, names: Mapping[str, Sequence[str]]):
        self.document = {" ".join(n.lower().split()): (doc, n) for doc, own in names.items() for n in own}
        longest = sorted((n for own in names.values() for n in own), key=len, reverse=True)
        # the GDPR of the United Kingdom is another document
        named = "|".join((r"(?<!UK\s)" if n == "GDPR" else "") + re.escape(n) for n in longest)
        kinds = [("name", rf"(?i:(?<!\w)(?:{named})(?!\w))")] if named else []
        kinds += [("han", CHINESE), ("locator", rf"(?<![\w.]){LOCATOR}"), ("part", r"\([0-9A-Za-z]+\)"), ("word", r"§{1,2}|[^\W\d_\u3400-\u9fff]+"), ("other", r"\w"), ("end", r"[.;\n](?!\d)"), ("comma", ","), ("sign", r"\S")]
        self.pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in kinds))

    def tokens(self, text: str) -> list[Token]:
        return [Token(m.lastgroup, m.group(), m.start(), m.end()) for m in self.pattern.finditer(text)]

    def named(self, token: Token) -> tuple[str, str]:
        return self.document[" ".join(token.low.split())]


def _joining(tokens: Sequence[Token], at: int) -> tuple[str, int]:
    """The word that joins what stands before `at` to what comes next ("" is none), and where that is: a comma, a word, or a comma and "and" or "or"."""
    if at < len(tokens) and tokens[at].kind == "comma":
        more = at + 1 < len(tokens) and tokens[at + 1].low in ("and", "or")
        return ",", at + 1 + more
    if at < len(tokens) and tokens[at].low in ("and", "or", "to", "through", "-"):
        return tokens[at].low, at + 1
    return "", at


def _series(tokens: Sequence[Token], at: int, kind: str) -> tuple[list[tuple[str, str]], int]:
    """Tokens of a kind in a row, each with what joins it to the one before, and where the row ends."""
    out, joined, ahead = [], "", at
    while ahead < len(tokens) and tokens[ahead].kind == kind:
        out.append((joined, tokens[ahead].text))
        at = ahead + 1
        joined, ahead = _joining(tokens, at)
        if not joined:
            break
    return out, at


def expand_locators(series: str | Sequence[tuple[str, str]]) -> list[str]:
    """Locators of a row, each once; "12 to 14" names all between, up to 200."""
    if isinstance(series, str):
        series = _series(Reader({}).tokens(series), 0, "locator")[0]
    out: dict[str, None] = {}
    before = ""
    for joined, now in series:
        if joined in ("to", "through") and before.isdigit() and now.isdigit() and int(before) <= int(now) <= int(before) + RANGE:
            out.update(dict.fromkeys(map(str, range(int(before), int(now) + 1))))
        out[now] = None
        before = now
    return list(out)


class Reference(NamedTuple):
    """What is cited, where it stands in the text, and its tokens: first, and the one after the last."""

    citations: list[str]
    start: int
    end: int
    first: int
    after: int


def _references(tokens: Sequence[Token]) -> Iterator[Reference]:
    for i, token in enumerate(tokens):
        if token.kind == "han":
            yield Reference([token.text], token.start, token.end, i, i + 1)
        kind = KINDS.get(token.low) if token.kind == "word" else None
        series, after = _series(tokens, i + 1, "locator") if kind else ([], i)
        if not series:
            continue
        locators, end = expand_locators(series), tokens[after - 1].end
        # points of one article: "Article 6(1), points (a), (b) and (c)" cites three
        at = after + (after < len(tokens) and tokens[after].kind == "comma")
        if at < len(tokens) and tokens[at].low in POINTS:
            parts, beyond = _series(tokens, at + 1, "part")
            if parts:
                after = beyond
                if kind == "Article" and len(locators) == 1:
                    locators = [locators[0] + part for _, part in parts]
        yield Reference([f"{kind} {x}" for x in locators], token.start, end, i, after)


def _document(reader: Reader, tokens: Sequence[Token], found: Reference, own: str) -> tuple[str, str | None] | None:
    """The cited document and the name that says so: named right after the reference, or right before it, else its own text's (G2). None if the text names one that is not known."""
    at, linked = found.after, False
    if at < len(tokens) and tokens[at].kind == "comma":
        at += 1
    if at < len(tokens) and tokens[at].low in ("of", "under", "pursuant"):
        linked = tokens[at].low != "pursuant" or at + 1 < len(tokens) and tokens[at + 1].low == "to"
        at += 1 + (tokens[at].low == "pursuant" and linked)
        at += linked and at < len(tokens) and tokens[at].low == "the"
    beside = tokens[at] if at < len(tokens) and tokens[at].start <= found.end + AFTER else None
    if beside is not None and beside.kind == "name":
        return reader.named(beside)
    i = found.first - 1
    while i >= 0 and tokens[i].kind in ("sign", "comma") and found.start - tokens[i].start <= SIGNS:
        i -= 1
    if i >= 0 and tokens[i].kind == "name" and found.start - tokens[i].end <= SIGNS:
        j = i - 1  # a citation earlier in the clause has that name to itself
        while j >= 0 and tokens[j].kind != "end" and found.start - tokens[j].start <= BEFORE and tokens[j].low not in KINDS:
            j -= 1
        if j < 0 or tokens[j].low not in KINDS or tokens[j].low.startswith("§"):
            return reader.named(tokens[i])
    if linked and beside is not None and beside.low in INSTRUMENTS:
        return None
    return own, None


def references_of(text: str, own: str, reader: Reader) -> Iterator[tuple[str, str, str | None, int, int]]:
    """(target document, requested citation, name, start, end) of each reference of a text."""
    tokens = reader.tokens(text)
    for found in _references(tokens):
        target = _document(reader, tokens, found, own)
        if target is not None:
            for citation in found.citations:
                yield target[0], citation, target[1], found.start, found.end


def extract_references(units: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """A row for each reference in units(unit_id, doc_id, text). Spark has no expression for all match positions, hence Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(aliases)
        names = [x.split()[0] for x in REFERENCES.split(", ")]
        for batch in batches:
            rows = []
            for unit, doc, text in zip(*(batch.column(c).to_pylist() for c in ("unit_id", "doc_id", "text")), strict=True):
                for target, requested, alias, a, b in references_of(text or "", doc, reader):
                    rows.append((unit, doc, target, requested, alias, a, b, text[a:b], " ".join(text[max(0, a - 80) : b + 80].split())))
            kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()] * 2
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return units.select("unit_id", "doc_id", "text").mapInArrow(run, REFERENCES)


def resolve_citations(asked: DataFrame, units: DataFrame, scope: Sequence[str], requested: str, citation: str) -> DataFrame:
    """asked with the unit columns of the citation itself, else of the nearest parent that is left when trailing "(x)" parts go, one after the other until none is left.

    basis is exact, parent_unit_fallback or unresolved. Units meet on (scope, lower-cased citation); of repeated citations the last stands.
    Equal rows of asked become one.
    """
    columns = asked.columns
    more = [c for c in units.columns if c not in scope]
    known = units.groupBy(*scope, F.lower(citation).alias("_key")).agg(F.max(F.struct(*more)).alias("_unit"))
    parts = F.regexp_count(F.regexp_extract(requested, r"(?:\s*\([^()]*\))*$", 0), F.lit(r"\("))
    shorter = lambda done, _: F.array_append(done, F.regexp_replace(F.element_at(done, -1), r"\s*\([^()]*\)$", ""))
    tries = F.array_distinct(F.aggregate(F.when(parts > 0, F.sequence(F.lit(1), parts)).otherwise(F.array().cast("array<int>")), F.array(F.col(requested)), shorter))
    keyed = asked.select(*columns, F.posexplode(F.when(F.col(requested).contains("§"), F.flatten(F.transform(tries, lambda t: F.array(t, F.replace(t, F.lit("§"), F.lit("Section")), F.replace(t, F.lit("§ "), F.lit("§")))))).otherwise(tries)).alias("_try", "_text")).withColumn("_key", F.lower("_text"))
    found = keyed.join(known, [*scope, "_key"], "left").groupBy(*columns).agg(F.min_by(F.struct("_unit", "_try"), F.when(F.col("_unit").isNotNull(), F.col("_try"))).alias("_b"))
    basis = F.when(F.col("_b._unit").isNull(), "unresolved").when(F.col("_b._try") == 0, "exact").otherwise("parent_unit_fallback")
    return found.select(*columns, *(F.col(f"_b._unit.{c}").alias(c if c not in columns else f"target_{c}") for c in more), basis.alias("basis"))


def law_relations(units: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Relations between units(unit_id, doc_id, citation, text): resolved references without self-links, merged by source, target and requested citation."""
    found = extract_references(units, aliases)
    targets = units.select(F.col("doc_id").alias("target_doc"), "citation", F.col("unit_id").alias("target_unit_id"))
    resolved = resolve_citations(found, targets, ["target_doc"], "requested", "citation").where("target_unit_id is not null and target_unit_id <> unit_id")
    evidence = F.struct("char_start", "char_end", "citation_text", "excerpt")
    merged = resolved.groupBy(F.col("unit_id").alias("source_unit_id"), "target_unit_id", F.lower("requested").alias("_r")).agg(
        F.min("requested").alias("requested"), F.first("doc_id").alias("source_doc_id"), F.first("target_doc").alias("target_doc_id"), F.min("basis").alias("basis"), F.array_sort(F.array_compact(F.collect_set("alias"))).alias("aliases"), F.array_sort(F.collect_set(evidence)).alias("evidence")
    )
    scope = F.when(F.col("source_doc_id") == F.col("target_doc_id"), "intra_law").otherwise("cross_law")
    confidence = F.when(F.col("basis") == "exact", 1.0).otherwise(0.95)
    return merged.select(relation_id("law_relation", F.col("source_unit_id"), F.col("target_unit_id"), F.col("_r")).alias("relation_id"), "source_unit_id", "source_doc_id", "target_unit_id", "target_doc_id", "requested", scope.alias("scope"), "basis", confidence.alias("confidence"), "aliases", "evidence")
