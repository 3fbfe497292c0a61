"""Statute files, fetched pages, model adapters and the loop, run over rows of tables with made answers in place of a network, with their SQL."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import functions as F

from ..functions import passages as P
from ..functions.text import limited, utc_now
from ..operators import agent, benchmark, parse, rerank, retrieval
from ..operators.hierarchy import leaves
from ..sources import extract, fetch
from ..sources.documents import source_documents
from .. import models
from ..service import checked_request
from .case_queries import _samples
from .io_queries import put, work_folder
from .retrieval_queries import read, spread
from .unit_queries import _PARTS, _by_rows


def _statute(rows: list) -> str:
    """A British statute in XML: a section for each part, every fourth one taken out, every fifth one added later; and a schedule."""
    groups, notes = [], []
    for r in rows:
        n, gone, new = r["n"], r["n"] % 4 == 0, r["n"] % 5 == 0
        body = ". . . . ." if gone else f"<P2><Pnumber>1</Pnumber><P2para><Text>Of {r['name']}.</Text></P2para></P2>"
        refs = "".join(f'<CommentaryRef Ref="c{kind}{n}"/>' for kind, on in (("x", gone and n % 3 == 0), ("y", new)) if on)
        groups.append(f'<P1group RestrictStartDate="2021-01-{n % 28 + 1:02d}"><Title>Title {n}</Title><P1 DocumentURI="http://l/a/section/{n}"><Pnumber>{n}</Pnumber><P1para>{body}{refs}</P1para></P1></P1group>')
        notes += [f'<Commentary id="cx{n}">S. {n} omitted ({n % 28 + 1}.2.2020) by an Act.</Commentary>', f'<Commentary id="cy{n}">S. {n} inserted ({n % 28 + 1}.3.2019) by an Act.</Commentary>']
    schedule = '<Schedules><Schedule DocumentURI="http://l/a/schedule/1"><Number>Schedule 1</Number><TitleBlock><Title>Last</Title></TitleBlock><P1 DocumentURI="http://l/a/schedule/1/paragraph/1"><Pnumber>1</Pnumber><P1para><Text>End.</Text></P1para></P1></Schedule></Schedules>'
    return f'<Legislation xmlns="http://x"><Primary><Body>{"".join(groups)}</Body>{schedule}</Primary><Commentaries>{"".join(notes)}</Commentaries></Legislation>'


def statute_files(spark, sf_dir):
    """British statutes from XML files to units with their revisions."""
    at = work_folder(spark, "statutes")
    parts = spark.sql(_PARTS, part=read(spark, sf_dir, "part")).where("doc in ('Brand#1', 'Brand#2')").orderBy("doc", "n").collect()  # two of 25 brands are the files
    sources = []
    for doc in sorted({r["doc"] for r in parts}):
        put(spark, f"{at}/{doc[-1]}.xml", _statute([r for r in parts if r["doc"] == doc]))
        sources.append({"doc_id": doc, "jurisdiction": "UK", "law_family": "uk_dpa", "source_type": "s", "title": "T", "version_date": "2020", "effective_date": "", "url": "u", "language": "en", "target_path": f"{at}/{doc[-1]}.xml"})
    units = parse.parse_units(source_documents(spark, sources, require=True))
    revisions = extract.read_revisions(spark, at).withColumn("source_doc_id", F.concat(F.lit("Brand#"), F.regexp_extract("path", r"(\d)\.xml$", 1)))
    shown = parse.with_revisions(units, revisions.select("source_doc_id", "section", "status", "effective_from", "effective_to"))
    return shown.select("source_doc_id", "local_citation", "text", "is_current", "effective_from", "effective_to")


_STATUTE_FILES = f"""
    WITH p AS ({_PARTS.format(part='part')})
    SELECT doc AS source_doc_id, 'Section ' || n AS local_citation, n || chr(10) || 'Title ' || n || chr(10) || CASE WHEN n % 4 = 0 THEN '. . . . .' ELSE '(1) Of ' || name || '.' END AS text, n % 4 <> 0 AS is_current,
           CASE WHEN n % 5 = 0 THEN '2019-03-' || lpad((n % 28 + 1)::VARCHAR, 2, '0') END AS effective_from,
           CASE WHEN n % 4 <> 0 THEN NULL WHEN n % 3 = 0 THEN '2020-02-' || lpad((n % 28 + 1)::VARCHAR, 2, '0') ELSE '2021-01-' || lpad((n % 28 + 1)::VARCHAR, 2, '0') END AS effective_to FROM p WHERE doc IN ('Brand#1', 'Brand#2')
    UNION ALL SELECT DISTINCT doc, 'Schedule 1 paragraph 1', 'Paragraph 1' || chr(10) || 'End.', true, NULL, NULL FROM p WHERE doc IN ('Brand#1', 'Brand#2')"""


def book_pages(spark, sf_dir):
    """Lines of Australian book pages, without contents and end notes (H2)."""
    rows = spread(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), 10_000)

    def one(r):
        page = f'<p class="TOC5">9 Contents</p><p class="ActHead5">1 Short title</p><p class="subsection">This {r["name"]}.</p><p class="ActHead5">{r["k"] + 2} Other title</p><p>x</p><p class="ActHead1">Schedule 1 — Principles</p><p class="ActHead5">1 Australian Privacy Principle 1—open</p><p class="subsection">1.1 The {r["name"]}.</p><p class="ENotesHeading1">Endnotes</p><p class="E">no</p>'
        return [(r["k"], extract.html_text(page))]

    return _by_rows(rows, "k bigint, text string", one)


_BOOK_PAGES = """
    SELECT p_partkey AS k, array_to_string(['1', 'Short title', 'This ' || p_name || '.', (p_partkey + 2)::VARCHAR, 'Other title', 'Schedule', '1', '—', 'Principles', '1', 'Australian Privacy Principle', '1—open', '1.1', 'The ' || p_name || '.'], chr(10)) AS text FROM part"""


def page_links(spark, sf_dir):
    """Further pages, own parts and frames of web pages (H7, H8)."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"))

    def one(r):
        k, base = r["k"], f"http://h/{r['k']}"
        page = f'<body><iframe id="epubFrame" src="/b/{k}"></iframe><div id="content"><a class="page-Article" href="?p=2">2</a><a class="page-Article" href="{base}">1</a><p class="t">{r["name"]} &amp; <br>x</p></div><p>out</p></body>'
        return [(k, ",".join(extract.pagination_urls(page, base)), extract.article_fragment(page), extract.embedded_document_url(page, base))]

    return _by_rows(rows, "k bigint, pages string, fragment string, frame string", one)


_PAGE_LINKS = """SELECT n_nationkey::BIGINT AS k, 'http://h/' || n_nationkey || '?p=2' AS pages, '<p class="t">' || n_name || ' &amp; <br>x</p>' AS fragment, 'http://h/b/' || n_nationkey AS frame FROM nation"""


class _Answer:
    def __init__(self, content: bytes, url: str):
        self.content, self.url = content, url

    def raise_for_status(self) -> None:
        pass

    def json(self) -> dict:
        return json.loads(self.content)


class _Session:
    """Answers a get by a function of the address and the parameters."""

    def __init__(self, answer):
        self.answer = answer

    def get(self, url, params=None, headers=None, timeout=None):
        return _Answer(self.answer(url, params or {}).encode(), url)


def sources_acquired(spark, sf_dir):
    """Sources that are fetched, refused or left to be fetched by hand, with what is kept of them."""
    folder = tempfile.mkdtemp(prefix="tessel-")  # acquisition is the driver's work
    nations = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    pages = {f"http://h/{r['n_nationkey']}": ("" if r["n_nationkey"] % 5 == 1 else "solve the captcha" if r["n_nationkey"] % 5 == 2 else f"<p>{r['n_name']}") for r in nations}
    sources = [{"doc_id": f"d{r['n_nationkey']}", "title": r["n_name"], "url": f"http://h/{r['n_nationkey']}", "preferred_format": "html", "download_mode": "manual" if r["n_nationkey"] % 5 == 3 else "auto", "target_path": f"{folder}/{r['n_nationkey']}.html", "manual_instructions": ""} for r in nations]
    got = fetch.acquire(sources, _Session(lambda url, _: pages[url]), f"{folder}/report.md")
    with open(f"{folder}/report.md", encoding="utf-8") as file:
        report = file.read()
    rows = []
    for s, r in zip(sources, got, strict=True):
        kept = fetch.sidecar_path(s["target_path"])
        about = json.loads(kept.read_text(encoding="utf-8")) if kept.exists() else {}
        rows.append((r["doc_id"], r["status"], about.get("bytes"), f"## {r['doc_id']}\n" in report))
    return spark.createDataFrame(rows, "doc_id string, status string, bytes bigint, reported boolean")


_SOURCES_ACQUIRED = """
    SELECT 'd' || n_nationkey AS doc_id, CASE n_nationkey % 5 WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' WHEN 3 THEN 'manual' ELSE 'written' END AS status,
           CASE WHEN n_nationkey % 5 IN (0, 4) THEN length(n_name) + 3 END::BIGINT AS bytes, n_nationkey % 5 IN (1, 2, 3) AS reported FROM nation"""


def wiki_pages(spark, sf_dir):
    """Pages and title lists of a wiki, over several answers."""
    nations = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    failed = set()

    def answer(url, params):
        if params["action"] == "parse":
            k = int(params["page"].split()[-1])
            if k % 7 == 0 and k not in failed:  # the first try of some fails
                failed.add(k)
                raise OSError("no")
            return json.dumps({"parse": {"pageid": k + 100, "title": params["page"], "text": {"*": f"<p>{k}"}, "categories": [{"*": "Article_6"}]}})
        at = int(params.get("apcontinue", 0))
        rows = [{"ns": 0 if r["n_nationkey"] % 6 else 1, "title": f"Court - {r['n_nationkey']}"} for r in nations[at : at + 10]]
        return json.dumps({"query": {"allpages": rows}, **({"continue": {"apcontinue": str(at + 10)}} if at + 10 < len(nations) else {})})

    wiki = fetch.Wiki(_Session(answer), "http://w", sleep=lambda s: None)
    rows = [wiki.page(t) for t in wiki.titles("allpages", lambda t: " - " in t)]
    return spark.createDataFrame([(r["case_id"], r["title"], r["raw_html"], ",".join(r["categories"])) for r in rows], "case_id string, title string, html string, categories string")


def settings_read(spark, sf_dir):
    """Settings in good and bad forms."""
    base = {"LLM_BINDING_HOST": "l", "LLM_MODEL": "m", "EMBEDDING_BINDING_HOST": "e", "EMBEDDING_MODEL": "e", "EMBEDDING_DIM": "8", "RERANK_BINDING_HOST": "r", "RERANK_MODEL": "r"}
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))

    def one(r):
        k = r["k"]
        try:
            s = models.Settings.read({**base, "LLM_JSON_RETRIES": str(k % 8), "PASSAGE_TARGET_TOKENS": str(k % 1200), "RERANK_BY_DEFAULT": ("on", "no", "odd")[k % 3]})
            return [(k, True, s.passage_target, s.rerank_enabled)]
        except ValueError:
            return [(k, False, None, None)]

    return _by_rows(rows, "k bigint, good boolean, target int, reranks boolean", one)


_SETTINGS_READ = """
    WITH s AS (SELECT c_custkey AS k, c_custkey % 8 <= 5 AND c_custkey % 1200 > 100 AND c_custkey % 1200 <= 1000 AND c_custkey % 3 <> 2 AS good FROM customer)
    SELECT k, good, CASE WHEN good THEN k % 1200 END::INT AS target, CASE WHEN good THEN k % 3 = 0 END AS reranks FROM s"""


def models_asked(spark, sf_dir):
    """Embedding, reranking and structured answers of hosted models that first fail."""
    base = {"LLM_BINDING_HOST": "l", "LLM_MODEL": "m", "EMBEDDING_BINDING_HOST": "e", "EMBEDDING_MODEL": "e", "EMBEDDING_DIM": "2", "EMBEDDING_BATCH_NUM": "3", "RERANK_BINDING_HOST": "r", "RERANK_MODEL": "r"}
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))

    def one(r):
        k, asked = r["k"], []

        def post(url, body, headers, timeout):
            asked.append(url)
            if "input" in body:
                return {"data": [{"index": i, "embedding": [3.0 * (k + 1), 4.0 * (k + 1)]} for i in range(len(body["input"]))]}
            if "documents" in body:
                if len(asked) % 2 == 0 and k % 2:
                    raise models.ModelError("again")
                return {"results": [{"index": i, "relevance_score": float(len(t))} for i, t in enumerate(body["documents"])]}
            return {"choices": [{"message": {"content": '{"task": "compare", "queries": ["q"]}' if "again" in str(body["messages"][-1]["content"]) or k % 3 else "none"}}]}

        s = models.Settings.read(base)
        vectors = models.embedder(s, post)(["x"] * (k % 5 + 1))
        scores = models.reranker(s, post)("q", ["a" * (k % 4 + 1), "b"])
        plan = models.JsonModel(s, post).ask("s", {}, 10, agent.Plan.of)
        return [(k, len(vectors), round(vectors[0][0], 6), scores[0], plan.task, len(asked))]

    return _by_rows(rows, "k bigint, n_vectors int, first double, score double, task string, n_asked int", one)


_MODELS_ASKED = """
    WITH c AS (SELECT c_custkey AS k, ((c_custkey % 5 + 3) // 3)::INT AS e FROM customer)
    SELECT k, (k % 5 + 1)::INT AS n_vectors, 0.6::DOUBLE AS first, (k % 4 + 1)::DOUBLE AS score, 'compare' AS task,
           (e + CASE WHEN k % 2 = 1 AND (e + 1) % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END)::INT AS n_asked FROM c"""


def loop_runs(spark, sf_dir):
    """The bounded loop around made models: enough, a text asked for at length, or a new plan."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))

    def one(r):
        k, plans, rounds = r["k"], [], []

        def plan(request, before, gaps):
            plans.append(gaps)
            return {"task": agent.TASKS[k % 4], "queries": [f"q{len(plans)}"]}

        def retrieve(p, top_k):
            rounds.append(sum(s["limit"] for s in agent.searches(p, top_k)))
            return [{"evidence_id": f"law_unit:{k}", "text": "x" * 400}]

        def pack(items, expanded):
            return [{"evidence_id": i["evidence_id"], "is_truncated": i["evidence_id"] not in expanded} for i in items]

        def grade(request, p, packed):
            if p.task == "risk":
                return {"status": "sufficient", "coverage": {}}
            return [{"status": "sufficient"}, {"status": "context_gap", "requested_evidence_ids": [f"law_unit:{k}"]}, {"status": "retrieval_gap", "gaps": ["g"]}][k % 3]

        out = agent.Loop(plan, retrieve, pack, grade, lambda *a: {"answer": "a"}, most=1).run("ask", 10)
        return [(k, len(plans), len(rounds), rounds[0], out["evidence"][0]["is_truncated"], len(out["plan"].queries))]

    return _by_rows(rows, "k bigint, n_plans int, n_rounds int, n_wanted int, cut boolean, n_queries int", one)


_LOOP_RUNS = """
    WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 = 3 AS risk, CASE WHEN o_orderkey % 4 = 3 THEN 2 ELSE o_orderkey % 3 END AS way FROM orders)
    SELECT k, CASE WHEN way = 2 THEN 2 ELSE 1 END::INT AS n_plans, CASE WHEN way = 2 THEN 2 ELSE 1 END::INT AS n_rounds, CASE WHEN risk THEN 3 * 30 ELSE 2 * 40 END::INT AS n_wanted, way <> 1 AS cut, CASE WHEN way = 2 THEN 2 ELSE 1 END::INT AS n_queries FROM o"""


def service_requests(spark, sf_dir):
    """Bodies of requests to the service, good and bad."""
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" ask "), k)).alias("question"), (k % 60).alias("top_k"), F.when(k % 7 == 0, F.lit("x")).alias("odd")))
    rows = read(spark, sf_dir, "orders").select(k.alias("k"), body.alias("body"))

    def one(r):
        try:
            got = checked_request(json.loads(r["body"]))
            return [(r["k"], got["question"], got["top_k"])]
        except ValueError:
            return [(r["k"], None, None)]

    return _by_rows(rows, "k bigint, question string, top_k int", one)


_SERVICE_REQUESTS = """
    WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 <> 0 AND o_orderkey % 60 BETWEEN 1 AND 50 AND o_orderkey % 7 <> 0 AS good FROM orders)
    SELECT k, CASE WHEN good THEN 'ask ' || k END AS question, CASE WHEN good THEN k % 60 END::INT AS top_k FROM o"""


def runs_resumed(spark, sf_dir):
    """Results of a run that failed for some samples and was started again."""
    samples = benchmark.selected(_samples(spark, sf_dir), "risk", "test", 12)
    at, first = work_folder(spark, "runs"), {"on": True}

    def ask(sample):
        if first["on"] and int(sample["id"][1:]) % 3 == 0:
            raise ValueError("no")
        return {"evidence": [{"evidence_id": f"e-{sample['id']}"}]}

    benchmark.run_samples(spark, samples, ask, at)
    first["on"] = False
    again = benchmark.run_samples(spark, samples, ask, at)
    return benchmark.results(spark, f"{at}/*.jsonl").select("id", F.array_join("ranking", ",").alias("ranking"), "failed", F.lit(again).alias("asked_again"))


_RUNS_RESUMED = """
    WITH s AS (SELECT 's' || o_orderkey AS id, o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 4 = 3 ORDER BY 1 LIMIT 12)
    SELECT id, 'e-' || id AS ranking, false AS failed, (SELECT count(*) FROM s WHERE k % 3 = 0)::INT AS asked_again FROM s"""


def annotation_csv(spark, sf_dir):
    """Annotation rows as a CSV file and back."""
    evidence = read(spark, sf_dir, "orders").select(F.concat(F.lit("e"), "o_orderkey").alias("evidence_id"), F.concat(F.lit('a "b", '), "o_orderpriority").alias("text"))
    rows = benchmark.annotation_rows(_samples(spark, sf_dir).where("id <= 's2'"), evidence, 0)
    benchmark.write_annotation_csv(spark, rows, at := f"{work_folder(spark, 'csv')}/a.csv")
    back = spark.read.option("header", True).option("escape", '"').csv(at)
    return back.select("sample_id", "evidence_id", "text", F.col("grade").cast("int").alias("grade"), F.coalesce("reviewer_grade", F.lit("")).alias("reviewer_grade"))


_ANNOTATION_CSV = """
    WITH e AS (SELECT 's' || o_orderkey AS sample_id, unnest([{'k': o_orderkey, 'g': CASE WHEN o_orderkey % 13 = 0 THEN 9 ELSE 3 END}, {'k': CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey ELSE o_orderkey + 1 END, 'g': 1}]) AS x FROM orders WHERE 's' || o_orderkey <= 's2')
    SELECT sample_id, 'e' || x.k AS evidence_id, 'a "b", ' || o_orderpriority AS text, x.g::INT AS grade, '' AS reviewer_grade FROM e JOIN orders ON o_orderkey = x.k"""


def passages_selected(spark, sf_dir):
    """Of a text beyond its budget the passages that match, then those of the decision, then the rest in order."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))

    def one(r):
        k = r["k"]
        own = [{"passage_id": f"p{i}", "segment": "decision" if i == k % 5 else "facts", "seq": i, "text": "w" * 60} for i in range(5)]
        item = {"evidence_id": "case:1", "source_type": "case", "text": "t" * 4000, "matched": [f"p{(k + 2) % 5}"], "passages": own}
        out = P.pack_evidence([item], P.Budget(case=30 * (k % 4) + 40))[0]
        return [(k, ",".join(out["passage_ids"]), out["content_mode"])]

    return _by_rows(rows, "k bigint, chosen string, mode string", one)


# a block is 60 letters, its head "[facts | p0]" or "[decision | p0]" and three line breaks: 300 + 5*(5+2) or 5*(8+2), + 10*3 + 2*2 + 2*3 twentieths
_PASSAGES_SELECTED = """
    WITH c AS (SELECT c_custkey AS k, 30 * (c_custkey % 4) + 40 AS room FROM customer),
    p AS (SELECT k, room, unnest([0, 1, 2, 3, 4]) AS i FROM c),
    o AS (SELECT *, CASE WHEN i = (k + 2) % 5 THEN 0 WHEN i = k % 5 THEN 1 ELSE 2 END AS g, ceil((300 + CASE WHEN i = k % 5 THEN 50 ELSE 35 END + 30 + 4 + 6) * 120 / 2000)::INT AS cost FROM p),
    s AS (SELECT *, sum(cost) OVER (PARTITION BY k ORDER BY g, i) AS used FROM o)
    SELECT k, string_agg('p' || i, ',' ORDER BY g, i) AS chosen, 'selected_passages' AS mode FROM s WHERE used <= room GROUP BY k"""


def vectors_normalized(spark, sf_dir):
    """Vectors at unit length."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.transform(retrieval.normalized(F.col("embedding")), lambda x: F.round(x, 5)).alias("v")).select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.element_at("v", 1).alias("first"))


def texts_limited(spark, sf_dir):
    """First characters of texts, all with the limit 0, at the time of the query."""
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(limited(F.col("text"), 300), 256).alias("some"), F.sha2(limited(F.col("text"), 0), 256).alias("whole"), (F.length(utc_now()) == 20).alias("timed"))


def evidence_roles(spark, sf_dir):
    """Leaf items tagged with the roles they were found for."""
    tree = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") - 1).alias("parent_id"))
    tagged = rerank.with_role(rerank.with_role(rerank.with_role(leaves(tree), "a"), "b"), "a")
    return tagged.select("unit_id", F.array_join("roles", ",").alias("roles"))


QUERIES = {
    f.__name__: f
    for f in (statute_files, book_pages, page_links, sources_acquired, wiki_pages, settings_read, models_asked, loop_runs, service_requests, runs_resumed, annotation_csv, passages_selected, vectors_normalized, texts_limited, evidence_roles)
}
ORACLE_SQL = {
    "statute_files": _STATUTE_FILES, "book_pages": _BOOK_PAGES, "page_links": _PAGE_LINKS, "sources_acquired": _SOURCES_ACQUIRED, "settings_read": _SETTINGS_READ, "models_asked": _MODELS_ASKED, "loop_runs": _LOOP_RUNS, "service_requests": _SERVICE_REQUESTS,
    "runs_resumed": _RUNS_RESUMED, "annotation_csv": _ANNOTATION_CSV, "passages_selected": _PASSAGES_SELECTED,
    "wiki_pages": "SELECT 'gdprhub:' || (n_nationkey + 100) AS case_id, 'Court - ' || n_nationkey AS title, '<p>' || n_nationkey AS html, 'Article 6' AS categories FROM nation WHERE n_nationkey % 6 <> 0",
    "vectors_normalized": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5)) AS v FROM embeddings)
        SELECT vec_id, round(list_sum(v), 5) AS total, v[1] AS first FROM v""",
    "texts_limited": "SELECT doc_id, sha256(text[1:300]) AS some, sha256(text) AS whole, true AS timed FROM documents",
    "evidence_roles": "SELECT o_orderkey AS unit_id, 'a,b' AS roles FROM orders WHERE NOT (o_orderkey % 4 <> 3 AND o_orderkey + 1 IN (SELECT o_orderkey FROM orders))",
}
