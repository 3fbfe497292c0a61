"""Files written from tables and read again, and an index built from such a corpus, with their SQL.

Files go to the folder that the session names in spark.checkpoint.dir, which all executors share; a local session without it uses a temporary one.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import benchmark
from ..sources import catalogue, extract, jsonl
from . import corpus
from .index import Index, build, hash_embedder, tables
from .retrieval_queries import read
from .unit_queries import _by_rows


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessel-")
    return f"{base.rstrip('/')}/tessel-{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: str) -> None:
    """Writes one small file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content.encode()))
    out.close()


def jsonl_roundtrip(spark, sf_dir):
    """Rows with nested columns as lines of JSON with sorted keys, and back through a schema."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("é "), "c_name")).alias("name"), F.array(F.col("c_mktsegment"), F.lit("x")).alias("tags"), F.struct(F.col("c_acctbal").alias("a")).alias("more"))
    jsonl.write_jsonl(rows, at := work_folder(spark, "jsonl"))
    back = jsonl.read_jsonl(spark, at, rows.schema)
    return back.select("c_custkey", "name", F.array_join("tags", ",").alias("tags"), F.col("more.a").alias("a"))


def jsonl_lines(spark, sf_dir):
    """Lines with their numbers, blank ones passed over, those of a choice of numbers, read into records."""
    rows = read(spark, sf_dir, "customer").orderBy("c_custkey").coalesce(1)
    text = F.when(F.col("c_custkey") % 4 == 3, F.lit(" ")).otherwise(F.to_json(F.struct("c_custkey", "c_name")))
    rows.select(text.alias("value")).write.text(at := work_folder(spark, "lines"))
    lines = jsonl.read_lines(spark, at).where("line_no % 5 = 1")
    return jsonl.parse_lines(lines, "c_custkey bigint, c_name string").select("line_no", "c_custkey", "c_name")


def title_discovery(spark, sf_dir):
    """Titles of lists in several forms, each once in the order of the lists."""
    orders = read(spark, sf_dir, "orders")
    line = lambda form: F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(form.alias("title")))).otherwise(F.concat(F.lit(" "), form, F.lit(" ")))
    first = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("line_no"), line(F.concat(F.lit("T"), F.col("o_custkey"))).alias("line"))
    second = orders.select(F.col("o_orderkey").alias("line_no"), line(F.concat(F.lit("T"), F.col("o_custkey"))).alias("line")).unionByName(orders.select(F.col("o_orderkey").alias("line_no"), F.lit("  ").alias("line")))
    return jsonl.discovered([jsonl.titles(first), jsonl.titles(second)]).select("title", "at.source", "at.line_no")


def append_resumed(spark, sf_dir):
    """Rows appended in two runs of which the second overlaps the first."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    at = work_folder(spark, "append")
    jsonl.append_missing(orders.where("o_orderkey % 3 <> 0").withColumn("run", F.lit(1)), spark, at, "o_orderkey")
    jsonl.append_missing(orders.where("o_orderkey % 3 <> 1").withColumn("run", F.lit(2)), spark, at, "o_orderkey")
    return spark.read.parquet(at)


def manifest_entries(spark, sf_dir):
    """Names, bytes and digests of files (K6)."""
    at = work_folder(spark, "manifest")
    for r in read(spark, sf_dir, "nation").collect():  # 25 rows
        put(spark, f"{at}/n{r['n_nationkey']}.jsonl", f"{r['n_name']} é\n")
    return jsonl.manifest(spark, f"{at}/*.jsonl")


def catalogue_union(spark, sf_dir):
    """Sources of two catalogues with their defaults."""
    import os

    folder = tempfile.mkdtemp(prefix="tessel-")  # a catalogue is a file of the driver
    paths = []
    for half in (0, 1):
        rows = [r for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").collect() if r["n_nationkey"] % 2 == half]
        entries = "\n".join(f'[[sources]]\ndoc_id = "d{r["n_nationkey"]}"\ntitle = "{r["n_name"]}"\njurisdiction = "J{r["n_regionkey"]}"\nlaw_family = "f"\nsource_type = "s"\nversion_date = "v"\neffective_date = ""\nlanguage = "en"\nurl = "u"\npreferred_format = "html"\n' + ('download_mode = "manual"\n' if r["n_nationkey"] % 5 == 0 else "") for r in rows)
        paths.append(os.path.join(folder, f"{half}.toml"))
        with open(paths[-1], "w", encoding="utf-8") as file:
            file.write(entries)
    return catalogue.catalogue(spark, paths).select("doc_id", "title", "jurisdiction", "download_mode", "target_path")


def file_texts(spark, sf_dir):
    """Texts of files by their suffix."""
    at = work_folder(spark, "files")
    for r in read(spark, sf_dir, "nation").collect():  # 25 rows
        k, name = r["n_nationkey"], r["n_name"]
        form = {0: ("txt", f"{name} é"), 1: ("html", f"<html><script>x</script><h1>{name} &amp; co</h1><p> two\n three</p>"), 2: ("xml", f"<a><b>{name}</b> tail <c/></a>"), 3: ("htm", f"<p>{name}<p>next"), 4: ("xml", f"<p>{name} &nbsp; broken")}[k % 5]
        put(spark, f"{at}/n{k}.{form[0]}", form[1])
    return extract.read_files(spark, at).select(F.element_at(F.split("path", "/"), -1).alias("file"), "text")


def results_read(spark, sf_dir):
    """Rankings of result files: a success before a failure, else the later line; blank ids left out."""
    orders = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    first = orders.select((key * 2).alias("n"), F.to_json(F.struct(F.concat(F.lit("s"), key).alias("id"), F.array(F.struct(F.concat(F.lit(" e"), key).alias("evidence_id")), F.struct(F.lit(" ").alias("evidence_id"))).alias("evidence"), F.when(key % 5 == 0, F.struct(F.lit("t").alias("type"))).alias("error")), {"ignoreNullFields": "false"}).alias("value"))
    second = orders.where("o_orderkey % 2 = 0").select((key * 2 + 1).alias("n"), F.to_json(F.struct(F.concat(F.lit("s"), key).alias("id"), F.array(F.struct(F.lit("again").alias("evidence_id"))).alias("evidence"), F.when(key % 3 == 0, F.struct(F.lit("t").alias("type"))).alias("error")), {"ignoreNullFields": "false"}).alias("value"))
    lines = first.unionByName(second)
    lines.repartitionByRange(max(1, -(-orders.count() // 200_000)), "n").sortWithinPartitions("n").select("value").write.text(at := work_folder(spark, "results"))
    return benchmark.results(spark, at).select("id", F.array_join("ranking", ",").alias("ranking"), "failed")


# A corpus of brands as laws, parts as units, orders as cases, lines as what cases cite


def _corpus(spark, sf_dir) -> str:
    part, orders, line = (read(spark, sf_dir, t) for t in ("part", "orders", "lineitem"))
    k, unit = F.col("p_partkey"), lambda x: F.concat(F.lit("u"), x)
    even = F.substring("p_brand", 7, 9).cast("int") % 2 == 0
    rows = {
        "laws": part.select(F.col("p_brand").alias("doc_id"), F.concat(F.lit("Law "), "p_brand").alias("title"), F.when(even, "EU").otherwise("CN").alias("jurisdiction"), F.lit("en").alias("language")).distinct(),
        "legal_units": part.select(unit(k).alias("unit_id"), F.col("p_brand").alias("source_doc_id"), F.when(k % 3 == 1, unit(k - 1)).alias("parent_id"), F.when(k % 2 == 0, "article").otherwise("section").alias("unit_type"), F.concat("p_brand", F.lit(" § "), k).alias("canonical_citation"), F.concat(F.lit("Article "), k, F.lit(" (Ａ)")).alias("local_citation"), F.col("p_name").alias("text"), F.when(even, "EU").otherwise("CN").alias("jurisdiction"), (F.col("p_size") != 7).alias("is_current")),
        "gdprhub_cases": orders.select(F.concat(F.lit("c"), "o_orderkey").alias("case_id"), F.concat(F.lit("Case "), "o_orderkey").alias("title"), F.lit("A").alias("authority"), F.when(F.col("o_orderkey") % 2 == 0, "ES").alias("jurisdiction"), F.when(F.col("o_orderkey") % 2 == 0, "Spain").alias("country"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("decided_date"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit("N"), "o_orderkey")).alias("case_number"), F.concat(F.lit("E"), "o_orderkey").alias("ecli"), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.col("o_orderpriority")).alias("facts_text"), F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderstatus")).alias("decision_text"), F.array(F.struct(F.lit("retail").alias("industry"))).alias("industry"), F.array(F.lit("x"), F.lit("y")).alias("categories")),
        "case_law_relations": line.select(F.concat(F.lit("c"), "l_orderkey").alias("case_id"), F.when(F.col("l_quantity") > 2, unit(F.col("l_partkey"))).alias("target_unit_id"), F.concat(F.lit("Article "), "l_linenumber").alias("citation"), F.when(F.col("l_quantity") > 10, "resolved").otherwise("unresolved").alias("resolution_status")),
        "law_relations": part.select(unit(k).alias("source_unit_id"), unit(k + 2).alias("target_unit_id"), F.when(F.col("p_size") % 2 == 0, "cross_law").otherwise("intra_law").alias("relation_scope")),
    }
    at = work_folder(spark, "corpus")
    for name, df in rows.items():
        jsonl.write_jsonl(df, f"{at}/{name}.jsonl")
    return at


def _table(name: str):
    def get(spark, sf_dir) -> DataFrame:
        return tables(spark, _corpus(spark, sf_dir), hash_embedder(8))[name]

    return get


def index_units(spark, sf_dir):
    """The current units with their folded keys."""
    return _table("units")(spark, sf_dir).select("unit_id", "doc_id", "citation_key")


def index_vectors(spark, sf_dir):
    """What is embedded of leaf units and of cases with a text."""
    return _table("vectors")(spark, sf_dir).select("evidence_id", "source_type", "jurisdiction", "country", "doc_id", "decided_date", "text_sha256", F.size("embedding").alias("dim"))


def index_links(spark, sf_dir):
    """Resolved links between known cases and units, each once, and cross-law links between known units."""
    built = tables(spark, _corpus(spark, sf_dir), hash_embedder(8))
    return built["case_law"].select(F.col("case_id").alias("source"), "target_unit_id", "citation").unionByName(built["cross_law"].select(F.col("source_unit_id").alias("source"), "target_unit_id", F.lit("").alias("citation")))


_opened: dict[tuple[str, str], Index] = {}


def _index(spark, sf_dir) -> Index:
    """One index for a session and a folder, as building it is dear."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _opened:
        at = work_folder(spark, "index")
        build(spark, _corpus(spark, sf_dir), at, hash_embedder(8), "hash", 8)
        _opened[key] = Index(spark, at, hash_embedder(8), "hash")
    return _opened[key]


def index_exact(spark, sf_dir):
    """Units of citations in other forms of letters and spaces."""
    asked = read(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_brand").alias("request_id"), F.col("p_brand").alias("doc_id"), F.concat(F.lit("ARTICLE  "), "p_partkey", F.lit("(a)")).alias("wanted"), F.col("p_partkey").cast("int").alias("position"))
    return _index(spark, sf_dir).exact(asked).select("request_id", "unit_id", "position", "score")


def index_related(spark, sf_dir):
    """Units that the cases of each request apply."""
    cases = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("request_id"), F.concat(F.lit("c"), "o_orderkey").alias("case_id"))
    return _index(spark, sf_dir).related(cases, 3).select("request_id", "unit_id", "title", "canonical_citation", "rank")


def index_evidence(spark, sf_dir):
    """Previews of found items."""
    index = _index(spark, sf_dir)
    ranked = index.table("vectors").select(F.lit("r").alias("request_id"), "evidence_id", "source_type", "record_id", F.lit(1).alias("rank"))
    return index.evidence(ranked, True).select("evidence_id", "title", "citation", "text", "content_mode")


def index_catalogue(spark, sf_dir):
    """Laws with an example citation of each kind."""
    shown = _index(spark, sf_dir).catalogue()
    return shown.select("doc_id", "title", "jurisdiction", F.array_join(F.transform(F.map_entries("examples"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("examples"))


def corpus_errors(spark, sf_dir):
    """Repeated keys and links to nowhere of a corpus folder (V4)."""
    found = corpus.errors(corpus.read(spark, _corpus(spark, sf_dir)))
    return found.select("check", "value", "n_rows")


def corpus_publish(spark, sf_dir):
    """A corpus with more laws and units beside the old one: the rows of all its tables, and how many the validation counted (Q13, Q14, U1s, O1, K7)."""
    part = read(spark, sf_dir, "part")
    new = {
        "laws": part.select(F.concat(F.lit("new "), "p_brand").alias("doc_id"), F.lit("New").alias("title")).distinct(),
        "legal_units": part.select(F.concat(F.lit("n"), "p_partkey").alias("unit_id"), F.concat(F.lit("new "), "p_brand").alias("source_doc_id"), F.concat(F.lit("Section "), "p_partkey").alias("local_citation"), F.col("p_name").alias("text"), F.lit(True).alias("is_current")),
    }
    out = work_folder(spark, "published")
    report = corpus.publish(spark, _corpus(spark, sf_dir), new, out)
    shown = {  # what stands for the unit, the law, the citation and the text in each table
        "legal_units": ("unit_id", "source_doc_id", "local_citation", "text"), "laws": (None, "doc_id", "title", None), "gdprhub_cases": ("case_id", "country", "case_number", "facts_text"),
        "case_law_relations": ("case_id", "target_unit_id", "citation", "resolution_status"), "law_relations": ("source_unit_id", "target_unit_id", None, "relation_scope"),
    }
    columns = ("unit_id", "source_doc_id", "local_citation", "text")
    rows = spark.createDataFrame([("counts", name, str(n), "", "") for name, n in report["counts"].items()], "table string, " + ", ".join(f"{c} string" for c in columns))
    for name, df in corpus.read(spark, out).items():
        rows = rows.unionByName(df.select(F.lit(name).alias("table"), *((F.col(c) if c else F.lit("")).alias(own) for c, own in zip(shown[name], columns, strict=True))))
    return rows


def stream_ingest(spark, sf_dir):
    """Files appended once by a stream that is started twice (K3)."""
    from ..streaming.ingest import ingest

    events = read(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 6).alias("value"))
    source, table, checkpoint = (work_folder(spark, x) for x in ("source", "table", "stream"))
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").json(source)
        ingest(spark, source, "event_id bigint, event_type string, value double", table, checkpoint, "event_id").awaitTermination()
    return spark.read.parquet(table)


def headers(spark, sf_dir):
    """Request headers by format and host."""
    from ..sources.fetch import headers_for

    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))

    def one(r):
        h = headers_for("https://sso.agc.gov.sg/x" if r["k"] % 2 else "https://h/x", ("html", "xml", "pdf")[r["k"] % 3])
        return [(r["k"], h["Accept"].split(",")[0], h["User-Agent"].endswith("tessel/0.1"))]

    return _by_rows(rows, "k bigint, accept string, named boolean", one)


QUERIES = {
    f.__name__: f
    for f in (jsonl_roundtrip, jsonl_lines, title_discovery, append_resumed, manifest_entries, catalogue_union, file_texts, results_read, index_units, index_vectors, index_links, index_exact, index_related, index_evidence, index_catalogue, corpus_errors, corpus_publish, stream_ingest, headers)
}
_UNIT = "'u' || p_partkey"
_EVEN = "(substr(p_brand, 7)::INT % 2 = 0)"
_LEAF = """leaf AS (SELECT p.* FROM part p WHERE p_size <> 7 AND NOT EXISTS (SELECT 1 FROM part c WHERE c.p_size <> 7 AND c.p_partkey % 3 = 1 AND c.p_partkey - 1 = p.p_partkey))"""
_CASES = """cs AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderpriority END AS facts, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderstatus END AS held FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 8 <> 0)"""
_VECTORS = f"""
    WITH {_LEAF}, {_CASES}
    SELECT 'law_unit:' || {_UNIT} AS evidence_id, 'law' AS source_type, CASE WHEN {_EVEN} THEN 'EU' ELSE 'CN' END AS jurisdiction, NULL AS country, p_brand AS doc_id, NULL AS decided_date,
           sha256('Law ' || p_brand || chr(10) || CASE WHEN {_EVEN} THEN 'EU' ELSE 'CN' END || chr(10) || p_brand || ' § ' || p_partkey || chr(10) || p_name) AS text_sha256, 8 AS dim FROM leaf
    UNION ALL SELECT 'case:c' || o_orderkey, 'case', CASE WHEN o_orderkey % 2 = 0 THEN 'ES' END, CASE WHEN o_orderkey % 2 = 0 THEN 'Spain' END, NULL, strftime(o_orderdate, '%Y-%m-%d'),
           sha256(concat_ws(chr(10), 'Case ' || o_orderkey, 'A', CASE WHEN o_orderkey % 2 = 0 THEN 'Spain' END, 'retail', 'x, y', facts, held)), 8 FROM cs"""
ORACLE_SQL = {
    "jsonl_roundtrip": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'é ' || c_name END AS name, c_mktsegment || ',x' AS tags, c_acctbal AS a FROM customer",
    "jsonl_lines": "SELECT * FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS line_no, c_custkey, c_name FROM customer) WHERE line_no % 5 = 1 AND c_custkey % 4 <> 3",
    "title_discovery": """
        SELECT 'T' || o_custkey AS title, CASE WHEN bool_or(o_orderkey % 3 = 0) THEN 0 ELSE 1 END AS source, CASE WHEN bool_or(o_orderkey % 3 = 0) THEN min(o_orderkey) FILTER (o_orderkey % 3 = 0) ELSE min(o_orderkey) END AS line_no FROM orders GROUP BY o_custkey""",
    "append_resumed": "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 2 END AS run FROM orders",
    "manifest_entries": "SELECT 'n' || n_nationkey || '.jsonl' AS path, (length(n_name) + 4)::BIGINT AS bytes, sha256(n_name || ' é' || chr(10)) AS sha256 FROM nation",
    "catalogue_union": "SELECT 'd' || n_nationkey AS doc_id, n_name AS title, 'J' || n_regionkey AS jurisdiction, CASE WHEN n_nationkey % 5 = 0 THEN 'manual' ELSE 'auto' END AS download_mode, '' AS target_path FROM nation",
    "file_texts": """
        SELECT 'n' || n_nationkey || ['.txt', '.html', '.xml', '.htm', '.xml'][n_nationkey % 5 + 1] AS file,
               CASE n_nationkey % 5 WHEN 0 THEN n_name || ' é' WHEN 1 THEN n_name || ' & co' || chr(10) || 'two' || chr(10) || 'three' WHEN 2 THEN n_name || chr(10) || 'tail' WHEN 3 THEN n_name || chr(10) || 'next' ELSE n_name || ' ' || chr(160) || ' broken' END AS text FROM nation""",
    "results_read": """
        WITH r AS (SELECT o_orderkey AS k, o_orderkey * 2 AS n, 'e' || o_orderkey AS ranking, o_orderkey % 5 = 0 AS failed FROM orders
                   UNION ALL SELECT o_orderkey, o_orderkey * 2 + 1, 'again', o_orderkey % 3 = 0 FROM orders WHERE o_orderkey % 2 = 0)
        SELECT 's' || k AS id, arg_max(ranking, (NOT failed, n)) AS ranking, arg_max(failed, (NOT failed, n)) AS failed FROM r GROUP BY k""",
    "index_units": f"SELECT {_UNIT} AS unit_id, p_brand AS doc_id, 'article' || p_partkey || 'a' AS citation_key FROM part WHERE p_size <> 7",
    "index_vectors": _VECTORS,
    "index_links": f"""
        WITH {_CASES}, u AS (SELECT p_partkey FROM part WHERE p_size <> 7)
        SELECT DISTINCT 'c' || l_orderkey AS source, 'u' || l_partkey AS target_unit_id, 'Article ' || l_linenumber AS citation FROM lineitem WHERE l_quantity > 10 AND l_partkey IN (SELECT p_partkey FROM u) AND l_orderkey IN (SELECT o_orderkey FROM cs)
        UNION ALL SELECT {_UNIT}, 'u' || (p_partkey + 2), '' FROM part WHERE p_size % 2 = 0 AND p_size <> 7 AND p_partkey + 2 IN (SELECT p_partkey FROM u)""",
    "index_exact": f"SELECT p_brand AS request_id, {_UNIT} AS unit_id, p_partkey::INT AS position, 1.0::DOUBLE AS score FROM part WHERE p_partkey % 50 = 0 AND p_size <> 7",
    "index_related": f"""
        WITH {_CASES}, d AS (SELECT DISTINCT o_custkey::VARCHAR AS request_id, 'u' || l_partkey AS unit_id, p_brand, l_partkey FROM lineitem JOIN cs ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 10 AND p_size <> 7)
        SELECT request_id, unit_id, 'Law ' || p_brand AS title, p_brand || ' § ' || l_partkey AS canonical_citation, row_number() OVER (PARTITION BY request_id ORDER BY unit_id)::INT AS rank FROM d QUALIFY rank <= 3""",
    "index_evidence": f"""
        WITH {_LEAF}, {_CASES}
        SELECT 'law_unit:' || {_UNIT} AS evidence_id, 'Law ' || p_brand AS title, p_brand || ' § ' || p_partkey AS citation, p_name AS text, 'preview' AS content_mode FROM leaf
        UNION ALL SELECT 'case:c' || o_orderkey, 'Case ' || o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'E' || o_orderkey ELSE 'N' || o_orderkey END, 'Facts: ' || trim(facts) || chr(10) || 'Decision: ' || coalesce(held, ''), 'preview' FROM cs""",
    "index_catalogue": f"""
        WITH e AS (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'article' ELSE 'section' END AS kind, min('Article ' || p_partkey || ' (Ａ)') AS example FROM part WHERE p_size <> 7 GROUP BY 1, 2)
        SELECT p_brand AS doc_id, 'Law ' || p_brand AS title, CASE WHEN {_EVEN} THEN 'EU' ELSE 'CN' END AS jurisdiction, string_agg(kind || '=' || example, ';' ORDER BY kind) AS examples FROM e GROUP BY p_brand""",
    "corpus_errors": """
        SELECT 'case_law_relations: no such unit' AS "check", 'u' || l_partkey AS value, count(*) AS n_rows FROM lineitem WHERE l_quantity > 2 AND l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY 2
        UNION ALL SELECT 'case_law_relations: no such case', 'c' || l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2
        UNION ALL SELECT 'law_relations: no such unit', 'u' || (p_partkey + 2), count(*) FROM part WHERE p_partkey + 2 NOT IN (SELECT p_partkey FROM part) GROUP BY 2""",
    "corpus_publish": f"""
        WITH r AS (
            SELECT 'legal_units' AS "table", {_UNIT} AS unit_id, p_brand AS source_doc_id, 'Article ' || p_partkey || ' (Ａ)' AS local_citation, p_name AS text FROM part
            UNION ALL SELECT 'legal_units', 'n' || p_partkey, 'new ' || p_brand, 'Section ' || p_partkey, p_name FROM part
            UNION ALL (SELECT DISTINCT 'laws', '', p_brand, 'Law ' || p_brand, '' FROM part) UNION ALL (SELECT DISTINCT 'laws', '', 'new ' || p_brand, 'New', '' FROM part)
            UNION ALL SELECT 'gdprhub_cases', 'c' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Spain' END, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'N' || o_orderkey END, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderpriority END FROM orders
            UNION ALL SELECT 'case_law_relations', 'c' || l_orderkey, CASE WHEN l_quantity > 2 THEN 'u' || l_partkey END, 'Article ' || l_linenumber, CASE WHEN l_quantity > 10 THEN 'resolved' ELSE 'unresolved' END FROM lineitem
            UNION ALL SELECT 'law_relations', {_UNIT}, 'u' || (p_partkey + 2), '', CASE WHEN p_size % 2 = 0 THEN 'cross_law' ELSE 'intra_law' END FROM part)
        SELECT * FROM r UNION ALL SELECT 'counts', "table", count(*)::VARCHAR, '', '' FROM r GROUP BY "table\"""",
    "stream_ingest": "SELECT event_id, event_type, round(value, 6) AS value FROM events",
    "headers": "SELECT n_nationkey::BIGINT AS k, ['text/html', 'application/xml;notice=tree', 'application/pdf'][n_nationkey % 3 + 1] AS accept, n_nationkey % 2 = 0 AS named FROM nation",
}
