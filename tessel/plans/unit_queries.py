"""Statutes made from the parts of each brand, parsed into units; citations made from orders; passages and packing. With their SQL.

The texts are written by expressions that Spark and DuckDB read alike, from rows of a table; what the library must find
in them follows from the rows, so the SQL never reads a text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import passages as P
from ..operators import parse, relations
from .retrieval_queries import read, spread

#: The parts of a brand in order: n counts them from 1.
_PARTS = "SELECT p_brand AS doc, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS n, p_name AS name, p_type AS kind FROM {part}"
_HAN = "CASE WHEN n < 10 THEN substr('一二三四五六七八九', n, 1) WHEN n < 20 THEN '十' || CASE WHEN n % 10 = 0 THEN '' ELSE substr('一二三四五六七八九', n % 10, 1) END ELSE CAST(n AS STRING) END"
_N = "CAST(n AS STRING)"


@dataclass(frozen=True)
class Statute:
    """How a family's text is written: what comes before the first unit and after the last, and for each part its unit's text, key, local and full citation."""

    title: str
    text: str
    key: str
    local: str
    cited: str
    head: str = ""
    tail: str = ""
    most: int = 10**9
    kind: str = "section"
    confidence: float = 0.75


_SECTION = dict(key=f"'section_' || {_N}", local=f"'Section ' || {_N}")
_ARTICLE = dict(key=f"'article_' || {_N}", local=f"'Article ' || {_N}", kind="article")


def _clause(local: str) -> dict:
    return dict(local=local, key=f"replace(replace(replace(lower({local}), ' ', '_'), '.', '_'), '(', '')", kind="schedule_clause", confidence=0.8)


STATUTES = {
    "eu_dsa": Statute("T", f"'Article ' || {_N} || chr(10) || 'Title ' || name || chr(10) || 'Body of ' || kind || '.'", **_ARTICLE | dict(confidence=0.9), cited=f"'Digital Services Act Article ' || {_N}", head="(x) Whereas no number is here;\nHAVE ADOPTED THIS REGULATION:", tail="ANNEX I\nArticle 1\nCorrelation"),
    "china_pipl": Statute("T", f"'第' || {_HAN} || '条' || chr(10) || name || '。'", f"'article_' || {_N}", f"'第' || {_HAN} || '条'", f"'PIPL Article ' || {_N}", head="第一章 总则", kind="article", confidence=0.9),
    "us_cfr": Statute("45 CFR Part 164", f"'§ 164.' || {_N} || '.1 ' || name || chr(10) || '(a) See § 164.1.1 there.'", f"'section_164_' || {_N} || '_1'", f"'§ 164.' || {_N} || '.1'", f"'45 CFR § 164.' || {_N} || '.1'", head="PART 164", confidence=0.9),
    "us_state_privacy": Statute("T", f"'1798.' || CAST(n + 99 AS STRING) || '.' || chr(10) || name || ' under Section' || chr(10) || '1798.1.' || chr(10) || 'ends.'", "'section_1798_' || CAST(n + 99 AS STRING)", "'1798.' || CAST(n + 99 AS STRING)", "'California Civil Code § 1798.' || CAST(n + 99 AS STRING)", head="Civil Code", confidence=0.8),
    "singapore_pdpa": Statute("T", f"{_N} || ' Title ' || name || chr(10) || 'Body of ' || kind || '.'", **_SECTION, cited=f"'T Section ' || {_N}", head="PART 1\nPRELIMINARY", tail="Legislative History\n1 Short title\nno"),
    "hong_kong_pdpo": Statute("T", f"'Section: ' || {_N} || ' ' || name || ' E.R. 1 of 2013' || chr(10) || {_N} || '. Principle 1 is no schedule here.'", **_SECTION, cited=f"'T Section ' || {_N}", head="Part 1 Preliminary"),
    "india_dpdp": Statute("T", f"{_N} || '. (1) ' || name || '.' || chr(10) || '2 THE GAZETTE OF INDIA EXTRAORDINARY [PART II-' || chr(10) || '(2) ' || kind || '.'", **_SECTION, cited=f"'T Section ' || {_N}", head="CHAPTER I"),
    "canada_pipeda": Statute("T", f"{_N} || chr(10) || '(1) ' || name || '.' || chr(10) || '1 - ' || kind", **_SECTION, cited=f"'T Section ' || {_N}", head="Table of Contents\n1 - Short Title\nShort Title"),
    "malaysia_pdpa": Statute("T", f"{_N} || '. (1) ' || name || '.' || chr(10) || '1. Repeated number.'", **_SECTION, cited=f"'T Section ' || {_N}", head="SUSUNAN SEKSYEN\n1. Tajuk\n2. Pemakaian\nAn Act to regulate", most=146),
    "uk_dpa": Statute("T", f"{_N} || chr(10) || 'Title ' || name || chr(10) || 'Body of ' || kind || '.'", **_SECTION, cited=f"'T Section ' || {_N}", head="PART 1"),
    "australia_privacy_act": Statute("T", f"{_N} || chr(10) || 'Title ' || name || chr(10) || 'body of ' || kind || '.'", **_SECTION, cited=f"'T Section ' || {_N}", head="Table of contents\n1\nShort title\nBE IT THEREFORE ENACTED by the Queen", tail="Endnotes\n1\nAbout the endnotes"),
    "south_africa_popia": Statute("T", f"{_N} || '. ' || name || '.' || chr(10) || 'and ' || kind || '.'", **_SECTION, cited=f"'T Section ' || {_N}", head="CHAPTER 1\n1. Definitions\nSCHEDULE\nCHAPTER 1", tail="SCHEDULE\n77K. No.", most=115),
    "philippines_dpa": Statute("T", f"'SECTION ' || {_N} || '. ' || name || chr(10) || 'Body of ' || kind || '.'", **_SECTION, cited=f"'T Section ' || {_N}", head="CHAPTER I"),
    "japan_appi": Statute("T", f"'Article ' || {_N} || ' (' || name || ')' || chr(10) || 'Body of ' || kind || '.'", **_ARTICLE, cited=f"'T Article ' || {_N}", head="Table of Contents\nArticle 1 (Purpose)\nArticle 2 (Terms)\nArticle 1 (Purpose)"),
    "brazil_lgpd": Statute("T", f"'Article ' || {_N} || '. ' || name || '.' || chr(10) || 'Article 1 of ' || kind || ' is another.'", **_ARTICLE, cited=f"'T Article ' || {_N}", head="CHAPTER I"),
}
#: Schedules: numbered clauses after a first section.
SCHEDULES = {
    "canada_pipeda": Statute("T", f"'4.' || {_N} || ' Principle — ' || name || chr(10) || kind || '.'", **_clause(f"'Schedule 1 clause 4.' || {_N}"), cited=f"'T Schedule 1 clause 4.' || {_N}", head="1\nThis Act.\nSCHEDULE 1", tail="SCHEDULE 2\n4.1 No"),
    "uk_dpa": Statute("T", f"'Paragraph ' || {_N} || chr(10) || name || '.'", **_clause(f"'Schedule 2 paragraph ' || {_N}"), cited=f"'T Schedule 2 paragraph ' || {_N} || ' (Exemptions)'", head="1\nOverview\nThis Act.\nSCHEDULE 2\nExemptions"),
    "hong_kong_pdpo": Statute("T", f"{_N} || '. Principle ' || {_N} || '-' || name || chr(10) || kind || '.'", **_clause(f"'Schedule 1 Principle ' || {_N}"), cited=f"'T Schedule 1 Principle ' || {_N}", head="Section: 1 Title\nBody.\nSchedule: 1 Data Protection Principles"),
    "australia_privacy_act": Statute("T", f"'1.' || {_N} || chr(10) || 'The ' || name || '.'", f"'app_1_' || {_N}", f"'APP 1.' || {_N}", f"'T APP 1.' || {_N}", head="1\nShort title\nThis Act.\nSchedule\n1\n—\nAustralian Privacy Principles", tail="Endnotes\n", kind="schedule_clause", confidence=0.8),
}
_FIXED = ("Section 1",)  # the section before a schedule, which these queries leave out


def _units_query(family: str, s: Statute, schedule: bool) -> Callable:
    def query(spark, sf_dir):
        parts = spark.sql(f"SELECT doc, n, {s.text} AS piece FROM ({_PARTS}) WHERE n <= {s.most}", part=read(spark, sf_dir, "part"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "\n")
        raw = F.concat_ws("\n", *(x for x in (F.lit(s.head) if s.head else None, F.col("body"), F.lit(s.tail) if s.tail else None) if x is not None))
        docs = parts.groupBy(F.col("doc").alias("doc_id")).agg(joined.alias("body")).select("doc_id", F.lit(s.title).alias("title"), F.lit("X").alias("jurisdiction"), F.lit(family).alias("law_family"), F.lit("2020").alias("version_date"), F.lit(None).cast("string").alias("effective_date"), raw.alias("raw_text"))
        units = parse.parse_units(docs)
        if schedule:
            units = units.where(~F.col("local_citation").isin(*_FIXED))
        return units.select("unit_id", "local_citation", "canonical_citation", "unit_type", "parser_confidence", "char_start", "char_end", F.sha2("text", 256).alias("sha"))

    query.__name__ = f"{'schedule' if schedule else 'units'}_{family}"
    return query


def _units_sql(s: Statute) -> str:
    lead = len(s.head) + 1 if s.head else 0
    return f"""
        WITH u AS (SELECT doc, n, {s.text} AS piece, {s.key} AS k, {s.local} AS local, {s.cited} AS cited FROM ({_PARTS.format(part='part')}) WHERE n <= {s.most}),
        placed AS (SELECT *, {lead} + coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM u)
        SELECT doc || ':' || k AS unit_id, local AS local_citation, cited AS canonical_citation, '{s.kind}' AS unit_type, {s.confidence}::DOUBLE AS parser_confidence,
               begin::BIGINT AS char_start, (begin + length(piece))::BIGINT AS char_end, sha256(piece) AS sha FROM placed"""


#: A regulation of the Union: recitals, articles, two paragraphs each, points and nested points. One row for each line group.
_EU = f"""
    SELECT doc, 0 AS part, n AS a, 0 AS b, 0 AS c, 0 AS d, '(' || {_N} || ') Whereas ' || name || ';' AS piece FROM ({_PARTS}) WHERE n <= 9
    UNION ALL SELECT doc, 1, 0, 0, 0, 0, 'HAVE ADOPTED THIS REGULATION:' FROM ({_PARTS}) WHERE n = 1
    UNION ALL SELECT doc, 2, n, 0, 0, 0, 'Article ' || {_N} || chr(10) || name FROM ({_PARTS})
    UNION ALL SELECT doc, 2, n, 1, 0, 0, '1. First of ' || kind || ':' FROM ({_PARTS})
    UNION ALL SELECT doc, 2, n, 1, 1, 0, '(h) such of the following:' FROM ({_PARTS})
    UNION ALL SELECT doc, 2, n, 1, 1, 1, '(i) ' || name || ';' FROM ({_PARTS})
    UNION ALL SELECT doc, 2, n, 1, 1, 2, '(ii) others;' FROM ({_PARTS})
    UNION ALL SELECT doc, 2, n, 1, 2, 0, '(j) the rest.' FROM ({_PARTS})
    UNION ALL SELECT doc, 2, n, 2, 0, 0, '2. Second.' FROM ({_PARTS})"""


def units_eu_gdpr(spark, sf_dir):
    pieces = spark.sql(_EU, part=read(spark, sf_dir, "part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "c", "d", "piece"))), lambda x: x["piece"]), "\n")
    docs = pieces.groupBy(F.col("doc").alias("doc_id")).agg(joined.alias("raw_text")).select("doc_id", F.lit("T").alias("title"), F.lit("EU").alias("jurisdiction"), F.lit("eu_gdpr").alias("law_family"), F.lit("2020").alias("version_date"), F.lit("2021").alias("effective_date"), "raw_text")
    return parse.parse_units(docs).select("unit_id", "parent_id", "local_citation", "canonical_citation", "unit_type", F.round("parser_confidence", 2).alias("parser_confidence"), "char_start", "char_end", F.sha2("text", 256).alias("sha"))


_EU_SQL = f"""
    WITH s AS ({_EU.format(part='part')}),
    placed AS (SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc ORDER BY part, a, b, c, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM s),
    u AS (
        SELECT doc, 'recital_' || a AS path, NULL AS up, 'Recital ' || a AS local, 'recital' AS kind, 0.9 AS conf, begin, piece AS text FROM placed WHERE part = 0
        UNION ALL SELECT doc, 'article_' || a, NULL, 'Article ' || a, 'article', 0.9, min(begin), string_agg(piece, chr(10) ORDER BY b, c, d) FROM placed WHERE part = 2 GROUP BY doc, a
        UNION ALL SELECT doc, 'article_' || a || ':paragraph_' || b, 'article_' || a, 'Article ' || a || '(' || b || ')', 'paragraph', 0.88, min(begin), string_agg(piece, chr(10) ORDER BY c, d) FROM placed WHERE part = 2 AND b > 0 GROUP BY doc, a, b
        UNION ALL SELECT doc, 'article_' || a || ':paragraph_' || b || ':point_' || ['h', 'j'][c], 'article_' || a || ':paragraph_' || b, 'Article ' || a || '(' || b || ')(' || ['h', 'j'][c] || ')', 'point', 0.86, min(begin), string_agg(piece, chr(10) ORDER BY d) FROM placed WHERE part = 2 AND c > 0 GROUP BY doc, a, b, c
        UNION ALL SELECT doc, 'article_' || a || ':paragraph_1:point_h:point_' || ['i', 'ii'][d], 'article_' || a || ':paragraph_1:point_h', 'Article ' || a || '(1)(h)(' || ['i', 'ii'][d] || ')', 'point', 0.84, begin, piece FROM placed WHERE d > 0)
    SELECT doc || ':' || path AS unit_id, doc || ':' || up AS parent_id, local AS local_citation, 'GDPR ' || local AS canonical_citation, kind AS unit_type, conf::DOUBLE AS parser_confidence,
           begin::BIGINT AS char_start, (begin + length(text))::BIGINT AS char_end, sha256(text) AS sha FROM u"""

#: Citations that an order's text makes, by its number: a range, a list, points of one article, another document's before it, an unknown one's.
_CITING = """
    SELECT o_orderkey AS k, CAST(o_orderkey % 50 + 1 AS INT) AS a, CAST(o_orderkey % 5 AS INT) AS m, CAST(o_orderkey % 6 AS INT) AS form, CAST(o_orderkey AS STRING) AS said FROM {orders}"""
_CITING_TEXT = """
    SELECT 'u' || said AS unit_id, 'own' AS doc_id, CASE form
        WHEN 0 THEN said || ': see Articles ' || CAST(a AS STRING) || ' to ' || CAST(a + m AS STRING) || ' of the GDPR.'
        WHEN 1 THEN said || ': Sections ' || CAST(a AS STRING) || ', ' || CAST(a + 60 AS STRING) || ' and ' || CAST(a + 120 AS STRING) || '(4) apply here.'
        WHEN 2 THEN said || ': Article ' || CAST(a AS STRING) || '(1), points (a), (b) and (c) of this Act; the GDPR'
        WHEN 3 THEN said || ': Article ' || CAST(a AS STRING) || ' of Directive 95/46/EC and Recital ' || CAST(a AS STRING) || ' under the AI Act'
        WHEN 4 THEN said || '. GDPR, Article ' || CAST(a AS STRING) || '; UK GDPR and 第十条'
        ELSE said || ': the article and section ' || name END AS text
    FROM (SELECT c.*, 'words' AS name FROM (""" + _CITING + ") c)"
_NAMES = {"gdpr": ["GDPR", "Regulation (EU) 2016/679"], "ai": ["AI Act"]}


def reference_extract(spark, sf_dir):
    """All citations of all texts, with their documents and places."""
    texts = spark.sql(_CITING_TEXT, orders=read(spark, sf_dir, "orders"))
    return relations.extract_references(texts, _NAMES).select("unit_id", "target_doc", "requested", "alias", "char_start", "char_end", "citation_text")


_REFERENCE_SQL = f"""
    WITH c AS ({_CITING.format(orders='orders')}), x AS (SELECT *, length(said) AS l, a::VARCHAR AS t FROM c),
    r AS (
        SELECT said, 'gdpr' AS target_doc, 'Article ' || unnest(range(a, a + m + 1)) AS requested, 'GDPR' AS alias, l + 6 AS s, 'Articles ' || a || ' to ' || (a + m) AS cited FROM x WHERE form = 0
        UNION ALL SELECT said, 'own', 'Section ' || unnest([t, (a + 60)::VARCHAR, (a + 120) || '(4)']), NULL, l + 2, 'Sections ' || a || ', ' || (a + 60) || ' and ' || (a + 120) || '(4)' FROM x WHERE form = 1
        UNION ALL SELECT said, 'own', 'Article ' || a || '(1)(' || unnest(['a', 'b', 'c']) || ')', NULL, l + 2, 'Article ' || a || '(1)' FROM x WHERE form = 2
        UNION ALL SELECT said, 'ai', 'Recital ' || a, 'AI Act', l + length('Article ' || a || ' of Directive 95/46/EC and ') + 2, 'Recital ' || a FROM x WHERE form = 3
        UNION ALL SELECT said, 'gdpr', 'Article ' || a, 'GDPR', l + 8, 'Article ' || a FROM x WHERE form = 4
        UNION ALL SELECT said, 'own', '第十条', NULL, l + length('. GDPR, Article ' || a || '; UK GDPR and '), '第十条' FROM x WHERE form = 4)
    SELECT 'u' || said AS unit_id, target_doc, requested, alias, s::BIGINT AS char_start, (s + length(cited))::BIGINT AS char_end, cited AS citation_text FROM r"""


def law_relations(spark, sf_dir):
    """Units of each brand that cite each other, merged and resolved, the unit itself left out (G4, A12, J9, J14). Article 0 is in no brand, however many parts it has."""
    units = spark.sql(
        f"""SELECT doc || ':' || {_N} AS unit_id, doc AS doc_id, 'Article ' || {_N} AS citation,
            'By Article ' || CAST(n % 7 + 1 AS STRING) || '(2)(a) and Article ' || CAST(n % 3 + 1 AS STRING) || ', again Article ' || CAST(n % 3 + 1 AS STRING) || '; Article 0' AS text FROM ({_PARTS})""",
        part=read(spark, sf_dir, "part"),
    )
    return relations.law_relations(units, _NAMES).select("source_unit_id", "target_unit_id", "requested", "scope", "basis", "confidence", F.size("evidence").cast("long").alias("n_evidence"))


_LAW_RELATIONS_SQL = f"""
    WITH p AS ({_PARTS.format(part='part')}), most AS (SELECT doc, max(n) AS m FROM p GROUP BY doc),
    r AS (SELECT doc, n, n % 7 + 1 AS t, 'Article ' || (n % 7 + 1) || '(2)(a)' AS requested, 'parent_unit_fallback' AS basis, 0.95 AS confidence, 1 AS ev FROM p
          UNION ALL SELECT doc, n, n % 3 + 1, 'Article ' || (n % 3 + 1), 'exact', 1.0, 2 FROM p)
    SELECT doc || ':' || n AS source_unit_id, doc || ':' || t AS target_unit_id, requested, 'intra_law' AS scope, basis, confidence::DOUBLE AS confidence, ev::BIGINT AS n_evidence
    FROM r JOIN most USING (doc) WHERE t <= m AND t <> n"""

# Records of customers: paragraphs of equal length, so how many fit is one division. In twentieths, a letter is 5 and a gap 4.
_LETTERS, _TARGET, _MOST, _THRESHOLD = 37, 60, 75, 120


def passages_make(spark, sf_dir):
    """Passages of records over a threshold; numbers go on across their segments."""
    said = lambda n: F.array_join(F.array_repeat(F.lit("x" * _LETTERS), n), "\n\n")
    n = (F.col("c_custkey") % 40 + 1).cast("int")
    records = spread(read(spark, sf_dir, "customer").select("c_custkey"), 10_000).select(F.concat(F.lit("c"), "c_custkey").alias("parent_id"), F.array(F.struct(F.lit("facts").alias("segment"), said(n).alias("text")), F.struct(F.lit("decision").alias("segment"), said(F.lit(7)).alias("text"))).alias("segments"))
    return P.passages(records, threshold=_THRESHOLD, target=_TARGET, most=_MOST, overlap=5).select("parent_id", "segment", "seq", "n_tokens", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))


_PASSAGES_SQL = f"""
    WITH c AS (SELECT c_custkey, (c_custkey % 40 + 1)::INT AS n FROM customer),
    s AS (SELECT c_custkey, n, 'facts' AS segment, n AS k, 0 AS before FROM c UNION ALL SELECT c_custkey, n, 'decision', 7, n FROM c),
    -- paragraphs of a passage, and of a text that needs no parting
    f AS (SELECT ((({_TARGET} * 2000) // 120 + 4) // ({5 * _LETTERS} + 4))::INT AS per),
    w AS (SELECT s.*, CASE WHEN ceil(({5 * _LETTERS} * k + 4 * (k - 1)) * 120 / 2000) <= {_MOST} THEN k ELSE per END AS size FROM s, f
          WHERE ceil(({5 * _LETTERS} * (n + 7) + 4 * (n - 1) + 4 * 6 + 2) * 120 / 2000) > {_THRESHOLD}),
    g AS (SELECT *, unnest(range(0, ceil(k / size)::INT)) AS i FROM w),
    t AS (SELECT *, least(size, k - i * size)::INT AS m, row_number() OVER (PARTITION BY c_custkey ORDER BY segment = 'decision', i) - 1 AS seq FROM g)
    SELECT 'c' || c_custkey AS parent_id, segment, seq::INT AS seq, ceil(({5 * _LETTERS} * m + 4 * (m - 1)) * 120 / 2000)::INT AS n_tokens, ({_LETTERS} * m + 2 * (m - 1))::INT AS n_chars,
           sha256(repeat('{'x' * _LETTERS}' || chr(10) || chr(10), m - 1) || '{'x' * _LETTERS}') AS sha FROM t"""


def _by_rows(rows: DataFrame, schema: str, one: Callable[[dict], list[tuple]]) -> DataFrame:
    """What a plain function makes of each row, in Arrow batches."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    columns = [x.split() for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            out = [r for row in b.to_pylist() for r in one(row)]
            values = list(zip(*out, strict=True)) if out else [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), kinds[k]) for v, (_, k) in zip(values, columns, strict=True)], names=[c for c, _ in columns])

    return rows.mapInArrow(run, schema)


def token_windows(spark, sf_dir):
    """Overlapping windows of texts that have no place to part (T4)."""
    rows = spread(read(spark, sf_dir, "customer").select("c_custkey"), 10_000).select(F.col("c_custkey").alias("k"), F.repeat(F.lit("a"), (F.col("c_custkey") % 700 + 300).cast("int")).alias("text"))
    return _by_rows(rows, "k bigint, seq int, n_chars int", lambda r: [(r["k"], i, len(w)) for i, w in enumerate(P.Counter().split(r["text"], 30, 40, 10))])


_WINDOWS_SQL = """
    WITH t AS (SELECT c_custkey AS k, c_custkey % 700 + 300 AS n FROM customer),
    w AS (SELECT k, n, unnest(range(0, greatest(ceil((n - 33) / 67), 0)::BIGINT + 1)) AS i FROM t)
    SELECT k, i::INT AS seq, least(100, n - i * 67)::INT AS n_chars FROM w WHERE i = 0 OR n - (i - 1) * 67 > 100"""


def token_truncate(spark, sf_dir):
    """Texts cut to a number of tokens, two thirds from the head."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.repeat(F.lit("a"), (F.col("c_custkey") % 200).cast("int")), F.repeat(F.lit("z"), F.lit(150))).alias("text"))
    return _by_rows(rows, "k bigint, text string", lambda r: [(r["k"], P.Counter().truncate(r["text"], 60))])


_TRUNCATE_SQL = """
    WITH t AS (SELECT c_custkey AS k, repeat('a', (c_custkey % 200)::INT) || repeat('z', 150) AS text FROM customer)
    SELECT k, CASE WHEN ceil(length(text) * 5 * 120 / 2000) <= 60 THEN text ELSE left(text, ((1000 - 44) * 2 / 3 / 5)::INT - CASE WHEN ((1000 - 44) * 2 / 3 / 5)::INT > (1000 - 44) * 2 / 3 / 5 THEN 1 ELSE 0 END) || chr(10) || '[…]' || chr(10)
           || right(text, floor((1000 - 44) / 3 / 5)::INT) END AS text FROM t"""


def evidence_pack(spark, sf_dir):
    """The dearest orders of each customer as evidence within a budget, exact ones first."""
    from pyspark.sql import Window

    best = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    orders = read(spark, sf_dir, "orders").withColumn("position", F.row_number().over(best) - 1).where("position < 3")
    none = F.array().cast("array<struct<passage_id:string,segment:string,seq:int,text:string>>")
    items = orders.select(F.col("o_custkey").cast("string").alias("request_id"), F.col("position").cast("int").alias("position"), F.concat(F.lit("law_unit:"), "o_orderkey").alias("evidence_id"), F.lit("law_unit").alias("source_type"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 300 + 20).cast("int")).alias("text"), (F.col("o_orderkey") % 4 == 0).alias("exact"), F.lit(False).alias("expanded"), F.array().cast("array<string>").alias("matched"), none.alias("passages"))
    packed = P.pack(items, P.Budget(total=100, law=50, exact_law=50, case=50, expanded=50, reserve=15))
    return packed.select("request_id", "evidence_id", "position", "original_tokens", "included_tokens", "is_truncated", F.length("text").alias("n_chars"))


_ONE = """
    a{i} AS (SELECT *, least(50, left_{p} - 15 * (n - {i})) AS allowed FROM {before}),
    b{i} AS (SELECT *, CASE WHEN n < {i} OR allowed < 1 THEN NULL WHEN ceil(0.3 * len{i}) <= allowed THEN len{i}
                  ELSE (floor(round(greatest(20, greatest(20, allowed * 2000 / 120) - 44) / 3 * 2 / 5, 9)) + floor(round(greatest(20, greatest(20, allowed * 2000 / 120) - 44) / 3 / 5, 9)) + 5)::INT END AS c{i},
                  n >= {i} AND allowed >= 1 AND ceil(0.3 * len{i}) > allowed AS cut{i} FROM a{i}),
    s{i} AS (SELECT * EXCLUDE (allowed), left_{p} - coalesce(CASE WHEN cut{i} THEN ceil((5 * (c{i} - 5) + 44) * 120 / 2000) ELSE ceil(0.3 * c{i}) END, 0)::INT AS left_{i} FROM b{i})"""
_PACK_SQL = (
    """
    WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 300 + 20 AS len, o_orderkey % 4 = 0 AS exact, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 3),
    q AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY NOT exact, r) AS i FROM o),
    s0 AS (SELECT o_custkey, count(*) AS n, 100 AS left_0, """
    + ", ".join(f"max(len) FILTER (i = {i})::INT AS len{i}, max(o_orderkey) FILTER (i = {i}) AS key{i}" for i in (1, 2, 3))
    + " FROM q GROUP BY o_custkey),"
    + ",".join(_ONE.format(i=i, p=i - 1, before=f"s{i - 1}") for i in (1, 2, 3))
    + ", every AS ("
    + " UNION ALL ".join(f"SELECT o_custkey, {i} AS i, key{i} AS k, len{i} AS len, c{i} AS c, cut{i} AS cut FROM s3 WHERE c{i} IS NOT NULL" for i in (1, 2, 3))
    + """)
    SELECT o_custkey::VARCHAR AS request_id, 'law_unit:' || k AS evidence_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY i) - 1)::INT AS position, ceil(0.3 * len)::INT AS original_tokens,
           CASE WHEN cut THEN ceil((5 * (c - 5) + 44) * 120 / 2000) ELSE ceil(0.3 * c) END::INT AS included_tokens, cut AS is_truncated, c::INT AS n_chars FROM every"""
)

QUERIES = {f.__name__: f for f in (units_eu_gdpr, reference_extract, law_relations, passages_make, token_windows, token_truncate, evidence_pack)}
QUERIES |= {f.__name__: f for f in (_units_query(k, s, False) for k, s in STATUTES.items())}
QUERIES |= {f.__name__: f for f in (_units_query(k, s, True) for k, s in SCHEDULES.items())}
ORACLE_SQL = {"units_eu_gdpr": _EU_SQL, "reference_extract": _REFERENCE_SQL, "law_relations": _LAW_RELATIONS_SQL, "passages_make": _PASSAGES_SQL, "token_windows": _WINDOWS_SQL, "token_truncate": _TRUNCATE_SQL, "evidence_pack": _PACK_SQL}
ORACLE_SQL |= {f"units_{k}": _units_sql(s) for k, s in STATUTES.items()} | {f"schedule_{k}": _units_sql(s) for k, s in SCHEDULES.items()}
