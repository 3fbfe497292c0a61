"""Case pages made from orders, and benchmark files and model answers made from tables, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.json_repair import first_valid, parse_object
from ..operators import agent, benchmark, cases, integrity, rerank
from ..operators.parse import without_units
from .retrieval_queries import read, spread
from .unit_queries import _by_rows

#: Countries by a customer's nation number; the rest have none.
_COUNTRY = {0: "Spain", 1: "France", 2: "Germany", 3: "Italy", 4: "Austria", 5: "Nowhere"}
_COUNTRY_SQL = "['Spain', 'France', 'Germany', 'Italy', 'Austria', 'Nowhere'][c_nationkey % 6 + 1]"
_CODE_SQL = "['ES', 'FR', 'DE', 'IT', 'AT', NULL][c_nationkey % 6 + 1]"


def _country(column: str = "c_nationkey"):
    return F.element_at(F.array(*map(F.lit, _COUNTRY.values())), (F.col(column) % 6 + 1).cast("int"))


def _pages(spark, sf_dir):
    """A page for each order: a table of what is known of it, and sections under headings."""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "c_nationkey", "c_mktsegment")
    orders = orders.repartition(max(1, -(-read(spark, sf_dir, "orders").count() // 50_000)))  # a page is some hundred times its row
    key, n = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 50 + 1
    row = lambda label, value: F.concat(F.lit(f"<tr><th>{label}</th><td>"), value, F.lit("</td></tr>"))
    law = F.concat(F.lit('<a href="x">Article '), n, F.lit("(1) GDPR</a><br>Section "), n, F.lit(" X<br/>Article "), n, F.lit("(1) GDPR"))
    table = F.concat(F.lit('<table class="wikitable">'), row("Authority:", F.concat(F.lit("Court ("), _country(), F.lit(")"))), row("Case Number", F.concat(F.lit("N "), key)), row("Decided", F.date_format("o_orderdate", "dd.MM.yyyy")), row("Relevant Law:", law), row("Parties", F.when(F.col("o_orderkey") % 3 == 0, "N/A").otherwise(F.concat(F.lit("A "), F.col("c_mktsegment"), F.lit(" bank")))), row("Original Source", F.concat(F.lit('<a href="http://s/'), key, F.lit('">Source</a>'))), F.lit("</table>"))
    body = F.concat(F.lit('<h2>Facts<span class="mw-editsection">[<a>edit</a>]</span></h2><p>Order '), key, F.lit(" &amp; shop.</p><h3>Holding</h3><p>Status "), F.col("o_orderstatus"), F.lit(".</p><p>More.</p><h3>Comment</h3>"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<p>Said "), F.col("o_orderpriority"), F.lit(".</p>"))).otherwise(F.lit("")), F.lit("<h2>Other</h2><ul><li>One</li><li>Two</li></ul>"))
    html = F.concat(F.lit('<div>Menu<h2>Nav</h2></div><div class="mw-parser-output">'), table, F.lit("<script>no()</script>"), body, F.lit("</div><div>Footer</div>"))
    return orders.select(F.concat(F.lit("c"), key).alias("case_id"), F.concat(F.lit("Court - "), key).alias("title"), html.alias("raw_html"), F.array(F.concat(F.lit("Article "), n, F.lit(" GDPR")), F.lit("Spain")).alias("categories"))


def case_pages(spark, sf_dir):
    """Metadata, cited laws, segments and text of case pages."""
    pages = cases.read_pages(_pages(spark, sf_dir))
    of = lambda key: F.try_element_at("metadata", F.lit(key))
    return pages.select("case_id", of("authority").alias("authority"), of("case_number").alias("case_number"), of("original_source_url").alias("source"), F.array_join("relevant_laws", "|").alias("laws"), F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["segment_type"], s["heading"], s["text"], s["char_start"].cast("string"), s["char_end"].cast("string"))), "|").alias("segments"))


_FACTS, _HELD, _SAID = "'Order ' || o_orderkey || ' & shop.'", "'Status ' || o_orderstatus || '. More.'", "'Said ' || o_orderpriority || '.'"
_JOINED = "orders JOIN customer ON o_custkey = c_custkey"
_CASE_PAGES = f"""
    WITH x AS (SELECT *, {_FACTS} AS f, {_HELD} AS h, CASE WHEN o_orderkey % 2 = 0 THEN {_SAID} END AS s FROM {_JOINED}),
    y AS (SELECT *, length(f) AS a, length(f) + 1 AS b, length(f) + 1 + length(h) AS c FROM x)
    SELECT 'c' || o_orderkey AS case_id, 'Court (' || {_COUNTRY_SQL} || ')' AS authority, 'N ' || o_orderkey AS case_number, 'http://s/' || o_orderkey AS source,
           'Article ' || (o_orderkey % 50 + 1) || '(1) GDPR|Section ' || (o_orderkey % 50 + 1) || ' X' AS laws,
           concat_ws('|', 'background:Facts:' || f || ':0:' || a, 'reasoning:Holding:' || h || ':' || b || ':' || c, 'comment:Comment:' || s || ':' || (c + 1) || ':' || (c + 1 + length(s)),
                     'unknown:Other:One Two:' || (c + 1 + coalesce(length(s) + 1, 0)) || ':' || (c + 8 + coalesce(length(s) + 1, 0))) AS segments FROM y"""


def case_structured(spark, sf_dir):
    """Structured cases with what they lack."""
    out = cases.structured(_pages(spark, sf_dir))
    return out.select("case_id", "jurisdiction", "country", "decided_date", "company_or_parties", "facts_text", "decision_text", F.array_join(F.transform("industry", lambda i: F.concat_ws("=", i["label"], F.array_join(i["terms"], "+"))), ",").alias("industry"), F.array_join("missing", ",").alias("missing"), "status")


_CASE_STRUCTURED = f"""
    SELECT 'c' || o_orderkey AS case_id, coalesce({_CODE_SQL}, 'ES') AS jurisdiction, CASE WHEN {_CODE_SQL} IS NULL THEN 'Spain' ELSE {_COUNTRY_SQL} END AS country, strftime(o_orderdate, '%Y-%m-%d') AS decided_date,
           CASE WHEN o_orderkey % 3 <> 0 THEN 'A ' || c_mktsegment || ' bank' END AS company_or_parties, {_FACTS} AS facts_text, {_HELD} AS decision_text,
           CASE WHEN o_orderkey % 3 <> 0 THEN 'finance_insurance=bank,' ELSE '' END || 'retail_ecommerce=shop' AS industry, '' AS missing, 'complete' AS status FROM {_JOINED}"""


def case_law_links(spark, sf_dir):
    """Laws that case pages and their categories cite, resolved to units where these are known."""
    rows = cases.read_pages(_pages(spark, sf_dir), "categories").select("case_id", "relevant_laws", "categories")
    nations = read(spark, sf_dir, "nation")
    units = nations.select(F.concat(F.lit("u"), "n_nationkey").alias("unit_id"), F.lit("eu_gdpr_2016_679").alias("doc_id"), F.concat(F.lit("Article "), F.col("n_nationkey") + 1, F.when(F.col("n_nationkey") % 2 == 0, "(1)").otherwise("")).alias("local_citation"))
    return cases.case_law_links(rows, units)


_CASE_LAW_LINKS = """
    WITH o AS (SELECT 'c' || o_orderkey AS case_id, (o_orderkey % 50 + 1)::INT AS n FROM orders)
    SELECT case_id, 'Article ' || n || '(1) GDPR' AS citation, CASE WHEN n <= 25 AND n % 2 = 1 THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN n <= 25 AND n % 2 = 1 THEN 'u' || (n - 1) END AS target_unit_id FROM o
    UNION ALL SELECT case_id, 'Section ' || n || ' X', 'unresolved', NULL FROM o
    UNION ALL SELECT case_id, 'Article ' || n || ' GDPR', CASE WHEN n <= 25 AND n % 2 = 0 THEN 'resolved' ELSE 'unresolved' END, CASE WHEN n <= 25 AND n % 2 = 0 THEN 'u' || (n - 1) END FROM o"""


def case_titles(spark, sf_dir):
    """Titles of pages that are cases."""
    form = F.element_at(F.array(F.lit("Court - "), F.lit("Category:Court - "), F.lit("Court "), F.lit("Talk:x - ")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(F.concat(form, "o_orderkey").alias("title")).where(cases.is_case_title(F.col("title")))


def industry_tags(spark, sf_dir):
    """The older tags of parties, types and paragraphs."""
    customers = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 10_000)
    tags = cases.industry_tags(F.when(F.col("c_custkey") % 2 == 0, "A Shop").otherwise("shopping"), F.lower("c_mktsegment"), F.concat(F.repeat(F.lit("x "), 2495), F.when(F.col("c_custkey") % 3 == 0, "police").otherwise(F.lit("bank and police"))))
    return customers.select("c_custkey", F.array_join(tags, ",").alias("tags"))


_INDUSTRY_TAGS = """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'retail' END, CASE WHEN c_custkey % 3 <> 0 THEN 'finance' END, CASE WHEN c_custkey % 3 = 0 THEN 'public_sector' END) AS tags FROM customer"""


def _samples(spark, sf_dir):
    orders, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    judged = F.array(F.struct(F.concat(F.lit("e"), k).alias("evidence_id"), F.when(k % 13 == 0, 9).otherwise(3).alias("grade"), F.lit(True).alias("required"), F.lit("why").alias("rationale")), F.struct(F.concat(F.lit("e"), F.when(k % 17 == 0, k).otherwise(k + 1)).alias("evidence_id"), F.lit(1).alias("grade"), F.lit(False).alias("required"), F.lit("why").alias("rationale")))
    return orders.select(
        F.concat(F.lit("s"), k).alias("id"), pick(("dev", "test"), k).alias("split"), F.when(k % 11 == 0, "odd").otherwise(pick(benchmark.TASKS, k)).alias("task"), F.when(k % 7 == 0, " ").otherwise("q").alias("query"), F.lit("en").alias("language"), pick(("easy", "medium", "hard"), k).alias("difficulty"), F.lit(10).alias("retrieval_k"), judged.alias("relevance"),
        F.expr("cast(array() as array<struct<name:string,evidence_ids:array<string>,min_hits:int>>)").alias("coverage_groups"), F.array().cast("array<string>").alias("expected_limitations"), F.array().cast("array<string>").alias("tags"), F.struct(F.when(k % 5 == 0, "gold").otherwise("draft").alias("status"), F.lit("m").alias("method"), F.when(k % 10 == 0, "r").alias("reviewer"), F.lit("2026-01-02").alias("reviewed_at")).alias("annotation"),
    )


def benchmark_problems(spark, sf_dir):
    """What is wrong with each sample (V5)."""
    found = benchmark.problems(_samples(spark, sf_dir))
    return found.select("id", F.exists("problems", lambda p: p == "query is blank").alias("blank_query"), F.exists("problems", lambda p: p == "task is unknown").alias("unknown_task"), F.exists("problems", lambda p: p == "gold needs a reviewer").alias("no_reviewer"), (F.size("problems") > 0).alias("wrong"))


_BENCHMARK_PROBLEMS = """
    SELECT 's' || o_orderkey AS id, o_orderkey % 7 = 0 AS blank_query, o_orderkey % 11 = 0 AS unknown_task, o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 AS no_reviewer,
           o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR (o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0) OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 AS wrong FROM orders"""


def benchmark_unknown(spark, sf_dir):
    """Judged ids that the index lacks."""
    index = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("e"), "o_orderkey").alias("evidence_id"))
    return benchmark.unknown_ids(_samples(spark, sf_dir), index)


_BENCHMARK_UNKNOWN = """
    WITH e AS (SELECT 's' || o_orderkey AS id, unnest([o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey ELSE o_orderkey + 1 END]) AS k FROM orders)
    SELECT DISTINCT id, 'e' || k AS evidence_id FROM e WHERE k % 3 <> 0 OR k NOT IN (SELECT o_orderkey FROM orders)"""


def benchmark_select(spark, sf_dir):
    """Samples of a task and a split, and what is still to be asked of them."""
    samples = benchmark.selected(_samples(spark, sf_dir), "compare", "dev")
    done = samples.select("id", (F.xxhash64("id") % 1 != 0).alias("failed"), F.substring("id", 2, 20).cast("long").alias("k")).where("k % 3 <> 0").withColumn("failed", F.col("k") % 9 == 1)
    return benchmark.pending(samples, done.select("id", "failed")).select("id", "task", "split")


_BENCHMARK_SELECT = """SELECT 's' || o_orderkey AS id, 'compare' AS task, 'dev' AS split FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 4 = 2 AND (o_orderkey % 3 = 0 OR o_orderkey % 9 = 1)"""


def annotation_rows(spark, sf_dir):
    """A row for each judgement with its text for a reviewer."""
    evidence = read(spark, sf_dir, "orders").select(F.concat(F.lit("e"), "o_orderkey").alias("evidence_id"), F.repeat("o_orderpriority", 9).alias("text"))
    return benchmark.annotation_rows(_samples(spark, sf_dir), evidence, 40)


_ANNOTATION_ROWS = """
    WITH e AS (SELECT 's' || o_orderkey AS sample_id, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'q' END AS query, unnest([{'k': o_orderkey, 'g': CASE WHEN o_orderkey % 13 = 0 THEN 9 ELSE 3 END}, {'k': CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey ELSE o_orderkey + 1 END, 'g': 1}]) AS x FROM orders)
    SELECT sample_id, query, 'e' || x.k AS evidence_id, repeat(o_orderpriority, 9)[1:40] AS text, x.g::INT AS grade, '' AS reviewer_grade, '' AS reviewer_note FROM e JOIN orders ON o_orderkey = x.k"""


def plan_checked(spark, sf_dir):
    """Plans of a model, broken in several ways, as they are taken."""
    k = F.col("o_orderkey")
    many = F.to_json(F.transform(F.sequence(F.lit(1), (k % 12 + 1).cast("int")), lambda i: F.concat(F.lit(" q"), i % 9, F.lit(" "))))
    cited = F.to_json(F.transform(F.sequence(F.lit(1), (k % 15 + 1).cast("int")), lambda i: F.struct(F.when(i % 5 == 0, " ").otherwise("d").alias("doc_id"), F.concat(F.lit("Article "), i).alias("local_citation"))))
    raw = F.concat(F.lit('{"task": "'), F.element_at(F.array(*map(F.lit, (*agent.TASKS, "sing"))), (k % 5 + 1).cast("int")), F.lit('", "queries": '), many, F.lit(', "exact_citations": '), cited, F.lit(', "filters": {"source_types": ['), F.when(k % 2 == 0, '"law"').otherwise('"odd"'), F.lit("]}, }"))
    text = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("Here: "), raw)).otherwise(F.concat(F.lit('{"plans": [1, '), raw, F.lit("]}")))

    def one(row):
        try:
            plan = first_valid(parse_object(row["text"]), agent.Plan.of)
        except ValueError:
            return [(row["k"], None, 0, 0, None)]
        return [(row["k"], plan.task, len(plan.queries), len(plan.citations), ",".join(plan.source_types))]

    return _by_rows(read(spark, sf_dir, "orders").select(k.alias("k"), text.alias("text")), "k bigint, task string, n_queries int, n_citations int, sources string", one)


_PLAN_CHECKED = """
    WITH p AS (SELECT o_orderkey AS k, ['exact_law', 'case_search', 'compare', 'risk', NULL][o_orderkey % 5 + 1] AS task, (o_orderkey % 12 + 1)::INT AS q, (o_orderkey % 15 + 1)::INT AS c FROM orders)
    SELECT k, task, CASE WHEN task IS NULL THEN 0 ELSE least(q, 8) END::INT AS n_queries, CASE WHEN task IS NULL THEN 0 ELSE least(c - c // 5, 12) END::INT AS n_citations,
           CASE WHEN task IS NULL THEN NULL WHEN k % 2 = 1 THEN 'law,case' WHEN task = 'case_search' THEN 'law,case' ELSE 'law' END AS sources FROM p"""


def answer_checked(spark, sf_dir):
    """Grades and answers of a model, with unknown evidence left out."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k.alias("k"))

    def one(row):
        k = row["k"]
        evidence = {f"law_unit:{k}": "law_unit", f"case:{k}": "case"}
        plan = agent.Plan.of({"task": "compare", "queries": ["q"]})
        status = ("sufficient", "context_gap", "retrieval_gap", "odd")[k % 4]
        grade = agent.checked_grade({"status": status, "requested_evidence_ids": [f"case:{k - k % 3}", "x"], "sufficient": k % 8 == 3}, plan, evidence, [f"case:{k}"])
        answer = agent.checked_answer({"answer": "a", "findings": [{"statement": "s", "evidence_ids": [f"law_unit:{k}", f"law_unit:{k}", "no"]}, {"statement": "t", "evidence_ids": [f"case:{k + 1}"]}, "odd"]}, evidence)
        return [(k, grade["status"], len(grade["requested_evidence_ids"]), len(answer["findings"]), answer["findings"][0]["evidence_ids"][0])]

    return _by_rows(rows, "k bigint, status string, n_asked int, n_findings int, cited string", one)


_ANSWER_CHECKED = """
    SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'sufficient' WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'context_gap' ELSE 'retrieval_gap' END WHEN 2 THEN 'retrieval_gap' ELSE CASE WHEN o_orderkey % 8 = 3 THEN 'sufficient' ELSE 'retrieval_gap' END END AS status,
           CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END::INT AS n_asked, 1::INT AS n_findings, 'law_unit:' || o_orderkey AS cited FROM orders"""


def _candidates(spark, sf_dir):
    from pyspark.sql import Window

    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("item")).agg(F.min("l_linenumber").alias("n"), F.max("l_quantity").alias("q"))
    order = Window.partitionBy("request_id").orderBy("n", "item")
    return line.withColumn("rank", F.row_number().over(order)).select("request_id", "item", "rank", F.concat(F.lit("q"), "request_id").alias("query"), F.repeat(F.lit("x"), F.col("q").cast("int")).alias("text"), F.when(F.col("item") % 2 == 0, "law_unit").otherwise("case").alias("source_type"), F.when(F.col("item") % 3 == 0, F.array(F.lit("applicable_law"))).when(F.col("item") % 3 == 1, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("roles"))


def rerank_topn(spark, sf_dir):
    """The best candidates of each request by a reranker (here the length of their texts) that are good enough."""
    found = rerank.rerank(_candidates(spark, sf_dir), ["request_id"], "rank", "item", lambda q, texts: [len(t) / 50 for t in texts], query="query", text="text", top_n=3, least=0.3)
    return found.select("request_id", "item", F.round("score", 6).alias("score"), "rank")


_CANDIDATES = "c AS (SELECT l_orderkey AS request_id, l_partkey AS item, max(l_quantity)::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) AS r FROM lineitem GROUP BY 1, 2)"
_RERANK_TOPN = f"""
    WITH {_CANDIDATES} SELECT request_id, item, round(q / 50, 6) AS score, row_number() OVER (PARTITION BY request_id ORDER BY q DESC, r, item)::INT AS rank FROM c WHERE q / 50 >= 0.3 QUALIFY rank <= 3"""


def role_filter(spark, sf_dir):
    """Candidates that can serve the role of applicable law."""
    return rerank.role_candidates(_candidates(spark, sf_dir), "applicable_law").select("request_id", "item", "rank")


def exact_promotion(spark, sf_dir):
    """Rankings led by their first exact hits."""
    candidates = _candidates(spark, sf_dir)
    exact = candidates.where("item % 5 = 0").select("request_id", "item", (F.lit(100) - F.col("rank")).alias("exact_rank"))
    return rerank.promote_exact(candidates, exact, ["request_id"], "item", "rank", 4)


_EXACT_PROMOTION = f"""
    WITH {_CANDIDATES}, e AS (SELECT *, CASE WHEN item % 5 = 0 THEN row_number() OVER (PARTITION BY request_id, item % 5 = 0 ORDER BY r DESC, item) END AS x FROM c)
    SELECT request_id, item, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN x <= 2 THEN x END NULLS LAST, r, item)::INT AS rank FROM e"""


def risk_selection(spark, sf_dir):
    """Role rankings by quotas, then their rest, then a fallback list."""
    from ..operators.ranking import role_quotas
    from .ranking_queries import CYCLE, ROLES, _role_rows

    rows = _role_rows(spark, sf_dir)
    fallback = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).alias("request_id"), (-F.col("s_suppkey")).alias("item"), F.col("s_suppkey").cast("int").alias("rank"))
    few = rows.where("rank <= 2")
    return rerank.risk_selection({r: few.where(F.col("role") == r).drop("role") for r in ROLES}, fallback, ["request_id"], "item", "rank", role_quotas(4, ROLES, CYCLE), 9)


def rerank_texts(spark, sf_dir):
    """What a reranker, a model and a reviewer read of an item."""
    line = read(spark, sf_dir, "customer")
    name, none = F.col("c_name"), F.lit(None).cast("string")
    cited = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Article "), "c_custkey"))
    shown = line.select("c_custkey", name.alias("title"), cited.alias("citation"), F.col("c_mktsegment").alias("jurisdiction"), F.lit("").alias("country"), F.concat(F.lit("body "), "c_custkey").alias("text"))
    kind = F.when(F.col("c_custkey") % 2 == 0, "law_unit").otherwise("case")
    return shown.select("c_custkey", rerank.rerank_text(F.col("title"), F.col("citation"), F.col("jurisdiction"), F.col("country"), F.col("text")).alias("rerank"), rerank.rerank_query(F.col("title"), F.when(F.col("c_custkey") % 3 == 0, "case_search").otherwise("compare")).alias("query"), F.sha2(rerank.role_query(F.col("title"), "analogous_case", F.array("jurisdiction", "text")), 256).alias("role_query"), rerank.review_text(kind, F.col("title"), F.col("citation"), none, F.lit(" "), F.concat(F.lit("c:"), "c_custkey"), F.col("jurisdiction"), F.col("text")).alias("review"), F.get_json_object(rerank.shown_to_model(shown), "$.citation").alias("model_citation"))


_RERANK_TEXTS = f"""
    WITH c AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'Article ' || c_custkey END AS cited FROM customer)
    SELECT c_custkey, concat_ws(' | ', c_name, cited, c_mktsegment) || chr(10) || 'body ' || c_custkey AS rerank,
           CASE WHEN c_custkey % 3 = 0 THEN '{rerank.CASE_SEARCH.replace(chr(10), "' || chr(10) || '")}' || c_name ELSE c_name END AS query,
           sha256('Retrieval task: legal risk assessment.' || chr(10) || 'Evidence role: analogous_case.' || chr(10) || 'Ranking objective: {rerank.OBJECTIVES["analogous_case"]}' || chr(10) || 'Role-specific retrieval queries:' || chr(10)
                  || '- ' || c_mktsegment || chr(10) || '- body ' || c_custkey || chr(10) || 'Original user scenario: ' || c_name) AS role_query,
           '标题：' || c_name || chr(10) || '引用：' || coalesce(cited, 'c:' || c_custkey) || chr(10) || '法域：' || c_mktsegment || chr(10) || chr(10) || 'body ' || c_custkey AS review, cited AS model_citation FROM c"""


def _laws(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    docs = part.groupBy(F.col("p_brand").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), "\n").alias("raw_text"), F.min("p_partkey").alias("k")).select("doc_id", F.when(F.col("k") % 2 == 0, "current").otherwise("2020-01-01").alias("version_date"), "raw_text")
    units = part.where("p_size <> 7").select(F.concat(F.lit("u"), "p_partkey").alias("unit_id"), F.col("p_brand").alias("source_doc_id"), F.when(F.col("p_partkey") % 50 == 3, "none").alias("parent_id"), F.when(F.col("p_size") > 25, "article").otherwise("section").alias("unit_type"), F.when(F.col("p_size") == 9, F.concat("p_name", F.lit(" more"))).otherwise(F.col("p_name")).alias("text"))
    return docs, units


def law_report(spark, sf_dir):
    """Checks of each law against its units."""
    expected = {"Brand#1": {"article": 1}, "Brand#2": {"section": 0}}
    out = integrity.law_report(*_laws(spark, sf_dir), expected)
    return out.select("doc_id", "source_text_chars", "unit_count", "exact_anchors", "exact_anchor_ratio", F.try_element_at("type_counts", F.lit("article")).alias("n_articles"), F.array_join("issues", ",").alias("issues"), "status")


_LAW_REPORT = """
    WITH d AS (SELECT p_brand AS doc_id, string_agg(p_name, chr(10) ORDER BY p_name) AS raw, min(p_partkey) AS k FROM part GROUP BY 1),
    u AS (SELECT p_brand AS doc_id, p_partkey AS k, p_size > 25 AS art, CASE WHEN p_size = 9 THEN p_name || ' more' ELSE p_name END AS text FROM part WHERE p_size <> 7),
    s AS (SELECT d.doc_id, count(*)::INT AS n, count(*) FILTER (contains(raw, text))::INT AS a, count(*) FILTER (art)::INT AS arts, count(*) FILTER (NOT art)::INT AS secs, bool_or(u.k % 50 = 3) AS orphan FROM d JOIN u USING (doc_id) GROUP BY 1),
    r AS (SELECT d.doc_id, length(raw)::INT AS source_text_chars, n AS unit_count, a AS exact_anchors, round(a / n, 6) AS exact_anchor_ratio, nullif(arts, 0) AS n_articles,
                 concat_ws(',', CASE WHEN orphan THEN 'missing_parent_unit' END, CASE WHEN a <> n THEN 'normalized_or_composed_unit_text' END, CASE WHEN (d.doc_id = 'Brand#1' AND arts <> 1) OR (d.doc_id = 'Brand#2' AND secs <> 0) THEN 'primary_structure_count_mismatch' END, CASE WHEN d.k % 2 = 0 THEN 'version_not_date_pinned' END) AS issues
          FROM d JOIN s USING (doc_id))
    SELECT *, CASE WHEN issues = '' THEN 'pass' ELSE 'warning' END AS status FROM r"""


def laws_without_units(spark, sf_dir):
    """Laws that no unit came from."""
    docs, units = _laws(spark, sf_dir)
    return without_units(docs, units.where("substring(source_doc_id, 7) % 2 = 0")).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (case_pages, case_structured, case_law_links, case_titles, industry_tags, benchmark_problems, benchmark_unknown, benchmark_select, annotation_rows, plan_checked, answer_checked, rerank_topn, role_filter, exact_promotion, risk_selection, rerank_texts, law_report, laws_without_units)
}
ORACLE_SQL = {
    "case_pages": _CASE_PAGES, "case_structured": _CASE_STRUCTURED, "case_law_links": _CASE_LAW_LINKS, "case_titles": "SELECT 'Court - ' || o_orderkey AS title FROM orders WHERE o_orderkey % 4 = 0", "industry_tags": _INDUSTRY_TAGS, "benchmark_problems": _BENCHMARK_PROBLEMS,
    "benchmark_unknown": _BENCHMARK_UNKNOWN, "benchmark_select": _BENCHMARK_SELECT, "annotation_rows": _ANNOTATION_ROWS, "plan_checked": _PLAN_CHECKED, "answer_checked": _ANSWER_CHECKED, "rerank_topn": _RERANK_TOPN,
    "role_filter": f"WITH {_CANDIDATES} SELECT request_id, item, r::INT AS rank FROM c WHERE item % 2 = 0 AND item % 3 <> 1", "exact_promotion": _EXACT_PROMOTION, "rerank_texts": _RERANK_TEXTS, "law_report": _LAW_REPORT,
    "laws_without_units": "SELECT DISTINCT p_brand AS doc_id FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size <> 7 AND substr(p_brand, 7)::INT % 2 = 0)",
    "risk_selection": """
        WITH r0 AS (SELECT l_suppkey % 20 AS request_id, l_partkey AS item, l_linenumber % 3 AS ro, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
        r AS (SELECT request_id, item, ro, row_number() OVER (PARTITION BY request_id, ro ORDER BY q DESC, item) AS rank FROM r0 QUALIFY rank <= 2),
        a AS (SELECT *, rank AS slot FROM r WHERE ro = 0 AND rank <= 2),
        b AS (SELECT r.*, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS slot FROM r WHERE ro = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.request_id = r.request_id AND a.item = r.item) QUALIFY slot <= 1),
        ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
        c AS (SELECT r.*, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS slot FROM r WHERE ro = 2 AND NOT EXISTS (SELECT 1 FROM ab WHERE ab.request_id = r.request_id AND ab.item = r.item) QUALIFY slot <= 1),
        p AS (SELECT * FROM ab UNION ALL SELECT * FROM c),
        rest AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.request_id = r.request_id AND p.item = r.item) QUALIFY row_number() OVER (PARTITION BY request_id, item ORDER BY ro, rank) = 1),
        every AS (SELECT request_id, item, ro, 0 AS late, slot AS x, ro AS y, rank AS z FROM p UNION ALL SELECT request_id, item, ro, 1, 0, ro, rank FROM rest UNION ALL SELECT s_suppkey % 20, -s_suppkey, NULL, 2, 0, 0, s_suppkey FROM supplier)
        SELECT request_id, item, ['applicable_law', 'analogous_case', 'supplementary_obligations'][ro + 1] AS role, row_number() OVER (PARTITION BY request_id ORDER BY late, x, y, z)::INT AS position FROM every QUALIFY position <= 9""",
}
