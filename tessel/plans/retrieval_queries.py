"""Vector search, lookup, filters and hydration over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import match_key, strict_key
from ..operators import ranking, retrieval

#: Ids of the vectors that serve as a request.
PROBES = (3, 17, 42)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, each: int) -> DataFrame:
    """Rows dealt out anew, about `each` to a task. A small file of short rows is one task's, whatever work or text a row leads to; counting reads no more than the files' footers."""
    return rows.repartition(max(1, -(-rows.count() // each)))


def _probes(vectors: DataFrame, ids=PROBES) -> list[list[float]]:
    """The request's vectors; a few rows by a filter that reaches the scan."""
    return [r["embedding"] for r in vectors.where(F.col("vec_id").isin(*ids)).orderBy("vec_id").collect()]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", "label", F.round(retrieval.best_score(F.col("embedding"), _probes(vectors)), 6).alias("score"))


def vector_topk(spark, sf_dir):
    return _scored(spark, sf_dir).orderBy(F.col("score").desc(), "vec_id").limit(20).select("vec_id", "score")


def vector_batch_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    requests = vectors.where(F.col("vec_id").isin(*range(16))).select((F.col("vec_id") % 5).alias("request_id"), F.col("embedding").alias("query"))
    scored = retrieval.scores_by_request(vectors.select("vec_id", "embedding"), requests, "request_id").withColumn("score", F.round("score", 6))
    return retrieval.top(scored, ["request_id"], "score", "vec_id", 10).select("request_id", "vec_id", "score", "rank")


def vector_diverse_topk(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("request_id", F.lit(1))
    return ranking.diverse_top(rows, ["request_id"], "label", "score", "vec_id", 15).select("vec_id", "label", "score", "rank")


def passage_refine(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("request_id", F.lit(1))
    parents = retrieval.top(rows.where("vec_id < 50").select("request_id", F.col("vec_id").alias("parent"), "score"), ["request_id"], "score", "parent", 12)
    passages = rows.where("vec_id >= 50").select("request_id", (F.col("vec_id") % 50).alias("parent"), F.col("vec_id").alias("passage"), "score")
    out = retrieval.refine_by_passages(parents, passages, ["request_id"], "parent", "passage", "score", 30)
    return out.select("parent", "score", "rank", F.concat_ws(",", F.transform("passages", lambda x: x.cast("string"))).alias("passages"))


def rrf_fusion(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    p = _probes(vectors)
    one = lambda q: vectors.select(F.lit(1).alias("request_id"), "vec_id", F.round(retrieval.dot(F.col("embedding"), q), 6).alias("score"))
    a, b = (retrieval.top(one(q), ["request_id"], "score", "vec_id", 40).select("request_id", "vec_id", "rank") for q in p[:2])
    out = ranking.reciprocal_rank_fusion(a, b, ["request_id"], "vec_id", "rank")
    return out.select("vec_id", F.round("score", 9).alias("score"), "rank").where("rank <= 25")


def exact_lookup(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), "p_partkey", F.col("p_name").alias("local_citation"))
    asked = part.where("p_partkey % 50 = 0").select("doc_id", F.upper(F.regexp_replace("local_citation", " ", "  ")).alias("wanted"), F.col("p_partkey").alias("position"))
    return retrieval.exact_lookup(part, asked).select("p_partkey", "position", match_key(F.col("local_citation")).alias("loose"), strict_key(F.col("local_citation")).alias("strict"))


def candidate_filter(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.lit("case").alias("source_type"), F.col("o_orderkey").alias("record"), F.col("o_orderstatus").alias("jurisdiction"), F.col("o_orderpriority").alias("country"), F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    customers = read(spark, sf_dir, "customer").select(F.lit("law").alias("source_type"), F.col("c_custkey").alias("record"), F.col("c_mktsegment").alias("jurisdiction"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("date"))
    keep = retrieval.candidate_filter(source_type=F.col("source_type"), jurisdiction=F.col("jurisdiction"), country=F.col("country"), date=F.col("date"), source_types=("law", "case"), jurisdictions=("BUILDING", "MACHINERY"), countries=("1-URGENT", "F"), date_from="1994-01-01", date_to="1996-12-31")
    return orders.unionByName(customers).where(keep).select("source_type", "record", "date")


def candidate_exists(spark, sf_dir):
    """Orders count where a line of a chosen supplier exists; suppliers directly."""
    orders = read(spark, sf_dir, "orders").select(F.lit("case").alias("source_type"), F.col("o_orderkey").alias("record"), F.lit(None).cast("long").alias("doc"))
    suppliers = read(spark, sf_dir, "supplier").select(F.lit("law").alias("source_type"), (-F.col("s_suppkey")).alias("record"), F.col("s_suppkey").alias("doc"))
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("doc"))
    return retrieval.bound_to_documents(orders.unionByName(suppliers), "source_type", "doc", "record", links, (3, 5)).select("source_type", "record")


def related_expand(spark, sf_dir):
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    links = line.select("l_orderkey", "l_partkey")
    units = part.select(F.col("p_partkey").alias("l_partkey"), "p_name", F.col("p_brand").alias("brand"))
    brands = part.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("brand_parts"))
    return retrieval.related(links, units, brands, "l_orderkey", "l_partkey", "brand", 3).select("l_orderkey", "l_partkey", "p_name", "brand", "brand_parts", "rank")


def hydrate_turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    rolled = retrieval.children_in_order(turns, "conv_id", "turn", "role", "text")
    return rolled.select("conv_id", F.size("children").cast("long").alias("n_turns"), F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["turn"].cast("string"), c["role"], F.length(c["text"]).cast("string"))), "|").alias("turns"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_batch_topk, vector_diverse_topk, passage_refine, rrf_fusion, exact_lookup, candidate_filter, candidate_exists, related_expand, hydrate_turns)}

_DOT = "list_inner_product(e.embedding::DOUBLE[], {q}.embedding::DOUBLE[])"
_SCORED = """scored AS (
    SELECT e.vec_id, e.label, round(max(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id IN (3, 17, 42)) q GROUP BY e.vec_id, e.label)"""

ORACLE_SQL = {
    "vector_topk": f"WITH {_SCORED} SELECT vec_id, score FROM scored ORDER BY score DESC, vec_id LIMIT 20",
    "vector_batch_topk": """
        WITH s AS (
            SELECT q.vec_id % 5 AS request_id, e.vec_id, round(max(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score
            FROM embeddings e, embeddings q WHERE q.vec_id < 16 GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10""",
    "vector_diverse_topk": f"""
        WITH {_SCORED}, r AS (
            SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r, greatest(1, 15 // (SELECT count(DISTINCT label) FROM embeddings)) AS quota,
                   min(vec_id) OVER (PARTITION BY label) AS first_seen FROM scored),
        p AS (SELECT *, row_number() OVER (ORDER BY r > quota, CASE WHEN r > quota THEN NULL ELSE first_seen END NULLS LAST, score DESC, vec_id) AS p FROM r)
        SELECT vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM p WHERE p <= 15""",
    "passage_refine": f"""
        WITH {_SCORED}, parents AS (
            SELECT vec_id AS parent, score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM scored WHERE vec_id < 50 QUALIFY rank <= 12),
        best AS (
            SELECT vec_id % 50 AS parent, vec_id AS passage, score, row_number() OVER (ORDER BY score DESC, vec_id) AS p
            FROM scored WHERE vec_id >= 50 AND vec_id % 50 IN (SELECT parent FROM parents) QUALIFY p <= 30),
        lifted AS (SELECT parent, max(score) AS best, string_agg(passage::VARCHAR, ',' ORDER BY p) AS passages FROM best GROUP BY parent)
        SELECT parent, greatest(score, coalesce(best, score)) AS score, rank, coalesce(passages, '') AS passages FROM parents LEFT JOIN lifted USING (parent)""",
    "rrf_fusion": """
        WITH s AS (
            SELECT q.vec_id AS q, e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
            FROM embeddings e, embeddings q WHERE q.vec_id IN (3, 17)),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 40),
        f AS (
            SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, a.rank AS x, b.rank AS y,
                   0.25 / (60 + coalesce(b.rank, 41)) + 0.75 / (60 + coalesce(a.rank, 41)) AS score
            FROM (SELECT * FROM r WHERE q = 3) a FULL JOIN (SELECT * FROM r WHERE q = 17) b ON a.vec_id = b.vec_id)
        SELECT vec_id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, x NULLS LAST, y)::INT AS rank FROM f QUALIFY rank <= 25""",
    "exact_lookup": r"""
        WITH p AS (SELECT *, regexp_replace(lower(p_name), '[^\p{L}\p{N}]', '', 'g') AS loose, regexp_replace(lower(p_name), '\s+', '', 'g') AS strict FROM part)
        SELECT a.p_partkey, b.p_partkey AS position, a.loose, a.strict FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.strict = b.strict WHERE b.p_partkey % 50 = 0""",
    "candidate_filter": """
        SELECT 'case' AS source_type, o_orderkey AS record, d AS date
        FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
        WHERE (o_orderpriority IN ('1-URGENT', 'F') OR o_orderstatus IN ('1-URGENT', 'F')) AND (d IS NULL OR d BETWEEN '1994-01-01' AND '1996-12-31')
        UNION ALL SELECT 'law', c_custkey, NULL FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
    "candidate_exists": """
        SELECT 'case' AS source_type, o_orderkey AS record FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey IN (3, 5))
        UNION ALL SELECT 'law', -s_suppkey FROM supplier WHERE s_suppkey IN (3, 5)""",
    "related_expand": """
        WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey)::INT AS rank FROM d QUALIFY rank <= 3),
        b AS (SELECT p_brand, count(*) AS brand_parts FROM part GROUP BY p_brand)
        SELECT r.l_orderkey, r.l_partkey, p.p_name, p.p_brand AS brand, b.brand_parts, r.rank FROM r JOIN part p ON p.p_partkey = r.l_partkey JOIN b ON b.p_brand = p.p_brand""",
    "hydrate_turns": """
        SELECT conv_id, count(*) AS n_turns, string_agg(turn || ':' || role || ':' || length(text), '|' ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id""",
}
