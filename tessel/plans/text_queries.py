"""Text, key, date and extraction expressions over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval_queries import read

#: Fixed keyword lists of the query, in the order of the result.
RULES = {"reference": ("the", "of"), "negation": ("nicht", "no"), "licence": ("all rights reserved", "version 2.0"), "contact": ("example.com",)}
#: Fixed label table of the query: names of the test table's nations.
CODES = {"argentina": "AR", "brazil": "BR", "canada": "CA", "egypt": "EG", "france": "FR", "germany": "DE", "india": "IN", "japan": "JP", "china": "CN", "united kingdom": "UK", "united states": "US"}


def token_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens"))


def normalize_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_lines(F.concat(F.lit("  \r\n\t"), F.replace(F.col("text"), F.lit(". "), F.lit(" \t\n\n ")))), 256).alias("sha"))


def excerpt(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 120).alias("excerpt"), T.optional_text(F.when(F.col("doc_id") % 3 == 0, " N/A ").otherwise(F.col("lang"))).alias("lang_or_null"))


def bounded_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.bounded(F.col("text"), 200).alias("bounded"))


def html_plain_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(T.html_plain(F.col("html")), 256).alias("sha"), T.title_of(F.col("html")).alias("title"), T.blocked_page(F.col("url"), F.col("html"), ("captcha", "access denied", "/fr/")).alias("blocked"))


def keyword_rules(spark, sf_dir):
    found = T.keyword_rules(F.col("text"), RULES)
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["label"], F.array_join(x["terms"], "+"))), ";").alias("rules"))


def jurisdiction_map(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    label = F.when(F.col("n_nationkey") % 5 == 4, F.substring("n_name", 1, 2)).otherwise(F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")))
    return nation.select("n_nationkey", T.looked_up(label, CODES).alias("code"))


def date_normalize(spark, sf_dir):
    day = F.col("o_orderdate")
    shown = F.element_at(F.array(F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "d-M-yyyy"), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, " dd/MM/yyyy "), F.lit("31.02.2025"), F.lit("no date")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.iso_date(shown).alias("iso"))


def stable_ids(spark, sf_dir):
    """Ids of spans, which by their definition take the first 80 characters of a text, and of relations, which take it whole (P20)."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", T.stable_id(F.col("source"), F.col("doc_id").cast("string"), F.substring("text", 1, 80)).alias("span_id"), T.relation_id("law_relation", F.col("lang"), F.col("text")).alias("relation_id"))


def text_conflicts(spark, sf_dir):
    from ..operators.integrity import conflicts

    docs = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), "lang", "source", "n_chars")
    return conflicts(docs, ["sha"], ["lang", "source", "n_chars"]).withColumn("fields", F.array_join("fields", ","))


def ordered_distinct(spark, sf_dir):
    words = F.split("text", " ")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.ordered_distinct(words), " ").alias("words"), F.array_join(T.merged_distinct(F.split("lang", ""), F.split("source", ""), 5), "").alias("letters"))


def chinese_numbers(spark, sf_dir):
    shown = F.translate(F.col("n_nationkey").cast("string"), "0123456789", "零一二三四五六七八九")
    tens = F.floor(F.col("n_nationkey") / 10)
    name = F.concat(F.when(tens > 1, F.substring(shown, 1, 1)).otherwise(F.lit("")), F.when(tens > 0, F.lit("十")).otherwise(F.lit("")), F.when((F.col("n_nationkey") % 10 > 0) | (F.col("n_nationkey") == 0), F.substring(shown, -1, 1)).otherwise(F.lit("")))
    return read(spark, sf_dir, "nation").select("n_nationkey", T.chinese_number(F.concat(F.lit("三百"), F.when(F.col("n_nationkey").between(1, 9), F.lit("零")).otherwise(F.lit("")), F.when(F.col("n_nationkey").between(10, 19), F.concat(F.lit("一"), name)).otherwise(name))).alias("number"))


QUERIES = {
    f.__name__: f
    for f in (token_count, normalize_lines, excerpt, bounded_text, html_plain_text, keyword_rules, jurisdiction_map, date_normalize, stable_ids, text_conflicts, ordered_distinct, chinese_numbers)
}

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_COUNTED = f"""
    SELECT doc_id, ceil((2 * w + 5 * a + 10 * (n - w - a - o) + 20 * o) * 120 / 2000)::INT AS n_tokens FROM (
        SELECT doc_id, length(text) AS n, length(text) - length(regexp_replace(text, '{_SPACE}', '', 'g')) AS w, length(text) - length(regexp_replace(text, '[A-Za-z0-9_]', '', 'g')) AS a,
               length(regexp_replace(text, '[\\x00-\\x7f]|{_SPACE}', '', 'g')) AS o FROM documents)"""
_PLAIN = f"trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'))"
_TEXT = "html"
for _a, _b in ((r"(?is)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>", "\n"), (r"(?s)<!--.*?-->|<[^>]*>", "\n")):
    _TEXT = f"regexp_replace({_TEXT}, '{_a}', '{_b}', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_a}', '{_b}')"


def _lines(text: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split_regex({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> ''), chr(10))"


def _rule(keyword: str) -> str:
    return f"contains(lower(text), '{keyword}')" if " " in keyword or "-" in keyword else f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_]){keyword.replace('.', '[.]')}([^\\p{{L}}\\p{{N}}\\p{{M}}_]|$)')"


_RULES = ", ".join(
    "CASE WHEN {0} THEN '{1}:' || array_to_string(list_filter([{2}], lambda x: x IS NOT NULL), '+') END".format(" OR ".join(map(_rule, ks)), name, ", ".join(f"CASE WHEN {_rule(k)} THEN '{k}' END" for k in ks)) for name, ks in RULES.items()
)
_DATES = "['%d.%m.%Y', '%d-%m-%Y', '%Y-%m-%d', '%d/%m/%Y']"

ORACLE_SQL = {
    "token_count": _COUNTED,
    "normalize_lines": "SELECT doc_id, sha256(" + _lines("'  ' || chr(13) || chr(10) || chr(9) || replace(text, '. ', ' ' || chr(9) || chr(10) || chr(10) || ' ')") + ") AS sha FROM documents",
    "excerpt": f"""
        SELECT doc_id, CASE WHEN length({_PLAIN}) > 120 THEN rtrim({_PLAIN}[1:120]) || '…' ELSE {_PLAIN} END AS excerpt,
               CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang_or_null FROM documents""",
    "bounded_text": "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE text[1:130] || chr(10) || '[…]' || chr(10) || right(text, 65) END AS bounded FROM documents",
    "html_plain_text": f"""
        SELECT page_id, sha256({_lines(_TEXT)}) AS sha, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{_SPACE}+', ' ', 'g')), '') AS title,
               lower(url || chr(10) || html[1:20000]) SIMILAR TO '(?s).*(captcha|access denied|/fr/).*' AS blocked FROM pages""",
    "keyword_rules": f"SELECT doc_id, array_to_string(list_filter([{_RULES}], lambda x: x IS NOT NULL), ';') AS rules FROM documents",
    "jurisdiction_map": """
        SELECT n_nationkey, CASE WHEN n_nationkey %% 5 = 4 THEN upper(n_name[1:2]) ELSE map {%s}[lower(n_name)] END AS code FROM nation""" % ", ".join(f"'{k}': '{v}'" for k, v in CODES.items()),
    "date_normalize": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""",
    "stable_ids": """
        SELECT doc_id, sha1(source || '::' || doc_id || '::' || text[1:80])[1:16] AS span_id, 'law_relation:' || sha256(lang || '::' || text)[1:20] AS relation_id FROM documents""",
    "text_conflicts": """
        SELECT sha, n_rows, n_versions, concat_ws(',', CASE WHEN l > 1 THEN 'lang' END, CASE WHEN s > 1 THEN 'source' END, CASE WHEN c > 1 THEN 'n_chars' END) AS fields FROM (
            SELECT sha256(text) AS sha, count(*) AS n_rows, count(DISTINCT (lang, source, n_chars)) AS n_versions, count(DISTINCT lang) AS l, count(DISTINCT source) AS s, count(DISTINCT n_chars) AS c FROM documents GROUP BY 1)
        WHERE n_versions > 1""",
    "ordered_distinct": f"""
        WITH w AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS s FROM documents)),
        f AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, i, regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS x FROM w) WHERE x <> '' GROUP BY doc_id, x),
        g AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id),
        c AS (SELECT doc_id, list_concat(string_split(lang, ''), string_split(source, '')) AS c FROM documents)
        SELECT c.doc_id, coalesce(words, '') AS words, array_to_string(list_slice(list_filter(c.c, lambda x, i: list_position(c.c, x) = i), 1, 5), '') AS letters FROM c LEFT JOIN g ON g.doc_id = c.doc_id""",
    "chinese_numbers": "SELECT n_nationkey, (300 + n_nationkey)::INT AS number FROM nation",
}
