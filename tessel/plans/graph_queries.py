"""Trees, links, checks and the catalogue over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, integrity, retrieval
from .retrieval_queries import read


def _tree(spark, sf_dir):
    """Orders as a tree of depth four: within each block of four keys a key's parent is the one before."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(key.alias("unit_id"), F.when(key % 4 != 0, key - 1).alias("parent_id"), (F.col("o_custkey") % 3).alias("target"))


def leaf_nodes(spark, sf_dir):
    return hierarchy.leaves(_tree(spark, sf_dir)).select("unit_id")


def ancestor_closure(spark, sf_dir):
    return hierarchy.ancestors(_tree(spark, sf_dir))


def drop_parent_dups(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    closure = hierarchy.ancestors(tree)
    return hierarchy.without_parent_repeats(tree.select(F.col("unit_id").alias("source"), "target"), closure, "source", ["target"])


def fk_violations(spark, sf_dir):
    line, orders, part, customer = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer"))
    some = part.where("p_size > 5")
    return integrity.missing_parents(line, "l_partkey", some, "p_partkey", "line_part").unionByName(integrity.missing_parents(orders, "o_custkey", customer.where("c_acctbal > 0"), "c_custkey", "order_customer"))


def duplicate_keys(spark, sf_dir):
    return integrity.repeated_keys(read(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


def unique_units(spark, sf_dir):
    """Units given twice, once each (V1, V2)."""
    units = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_name").alias("text"), "p_size")
    return integrity.unique_units(units.unionByName(units.where("unit_id % 3 = 0")))


def unique_cases(spark, sf_dir):
    """Cases fetched more than once, as they were fetched last (V3)."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("title"), F.lit("2026-01-01").alias("retrieved_at"), F.lit("EU").alias("jurisdiction"))
    again = orders.where("case_id % 3 = 0").withColumns({"retrieved_at": F.lit("2026-02-01"), "jurisdiction": F.col("title")})
    return integrity.unique_cases(orders.unionByName(again))


def set_ops_diff(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    return integrity.set_difference(line.where("l_quantity < 3").select("l_partkey"), line.where("l_quantity > 48").select("l_partkey"), "l_partkey")


def change_report(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    old = part.where("p_partkey % 7 <> 0")
    new = part.where("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return integrity.changes(old, new, "p_partkey", ["p_name", "p_size"])


def superseded_filter(spark, sf_dir):
    part = read(spark, sf_dir, "part").where("p_partkey % 3 <> 1").select("p_partkey", "p_name")
    pairs = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") + 2).alias("successor")).where("p_partkey % 2 = 0")
    return integrity.without_superseded(part, "p_partkey", pairs)


def catalog_summary(spark, sf_dir):
    """Of each brand how many parts it has and an example of each of its types."""
    part = read(spark, sf_dir, "part")
    nested = retrieval.examples(part, "p_brand", "p_type", "p_name").join(part.groupBy("p_brand").agg(F.count("*").alias("n_parts")), "p_brand")
    return nested.select("p_brand", "n_parts", F.array_join(F.transform(F.map_entries("examples"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("examples"))


def build_stats(spark, sf_dir):
    return integrity.table_counts({t: read(spark, sf_dir, t) for t in ("part", "orders", "customer", "documents", "pages")})


def unit_type_counts(spark, sf_dir):
    """How many units of each kind a document has."""
    counted = integrity.kind_counts(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ("F", "O", "P"))
    return counted.select("o_orderpriority", F.col("F").alias("n_f"), F.col("O").alias("n_o"), F.col("P").alias("n_p"))


def citation_expand(spark, sf_dir):
    """References "Article a to b(n)" made from columns, expanded and resolved to units, else to the parent that they name."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.least(F.col("l_partkey") % 7, F.lit(4)).cast("int").alias("more"))
    each = line.select("l_orderkey", "n", F.explode(F.sequence("n", F.col("n") + F.col("more"))).alias("number"))
    asked = each.select("l_orderkey", "n", F.concat(F.lit("Article "), F.col("number"), F.lit("("), F.col("number") % 3, F.lit(")")).alias("requested"))
    units = read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("Article "), F.col("l_linenumber"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("("), F.col("l_linenumber") % 3, F.lit(")"))).otherwise(F.lit(""))).alias("citation"))
    from ..operators.relations import resolve_citations

    return resolve_citations(asked, units, ["l_orderkey"], "requested", "citation").select("l_orderkey", "n", "requested", "citation", "basis")


def event_windows(spark, sf_dir):
    from ..streaming.ingest import windowed_counts

    return windowed_counts(read(spark, sf_dir, "events"), "ts", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


QUERIES = {f.__name__: f for f in (leaf_nodes, ancestor_closure, drop_parent_dups, fk_violations, duplicate_keys, unique_units, unique_cases, set_ops_diff, change_report, superseded_filter, catalog_summary, build_stats, unit_type_counts, citation_expand, event_windows)}

_TREE = "tree AS (SELECT o_orderkey AS unit_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - 1 END AS parent_id, o_custkey % 3 AS target FROM orders)"
_UP = f"""WITH RECURSIVE {_TREE}, up AS (
    SELECT unit_id AS unit, parent_id AS ancestor, 1 AS distance FROM tree WHERE parent_id IS NOT NULL
    UNION ALL SELECT u.unit, t.parent_id, u.distance + 1 FROM up u JOIN tree t ON t.unit_id = u.ancestor WHERE t.parent_id IS NOT NULL AND u.distance < 3)"""

ORACLE_SQL = {
    "leaf_nodes": f"WITH {_TREE} SELECT unit_id FROM tree WHERE unit_id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)",
    "ancestor_closure": f"{_UP} SELECT unit, ancestor, distance FROM up",
    "drop_parent_dups": f"{_UP} SELECT unit_id AS source, target FROM tree t WHERE NOT EXISTS (SELECT 1 FROM up JOIN tree d ON d.unit_id = up.unit WHERE up.ancestor = t.unit_id AND d.target = t.target)",
    "fk_violations": """
        SELECT 'line_part' AS "check", l_partkey::VARCHAR AS value, count(*) AS n_rows FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY l_partkey
        UNION ALL SELECT 'order_customer', o_custkey::VARCHAR, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""",
    "duplicate_keys": "SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "unique_units": "SELECT p_partkey AS unit_id, p_name AS text, p_size FROM part",
    "unique_cases": "SELECT o_orderkey AS case_id, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN '2026-02-01' ELSE '2026-01-01' END AS retrieved_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'EU' END AS jurisdiction FROM orders",
    "set_ops_diff": """
        (SELECT l_partkey, 'missing' AS side FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity < 3 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48))
        UNION ALL (SELECT l_partkey, 'unexpected' FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 3))""",
    "change_report": """
        SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'added' WHEN p_partkey % 11 = 0 THEN 'removed' WHEN p_partkey % 5 = 0 THEN 'changed' ELSE 'same' END AS state
        FROM part WHERE p_partkey % 7 <> 0 OR p_partkey % 11 <> 0""",
    "superseded_filter": """
        WITH p AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 1)
        SELECT * FROM p WHERE NOT (p_partkey % 2 = 0 AND p_partkey + 2 IN (SELECT p_partkey FROM p))""",
    "catalog_summary": """
        WITH e AS (SELECT p_brand, p_type, min(p_name) AS example, count(*) AS n FROM part GROUP BY 1, 2)
        SELECT p_brand, sum(n)::BIGINT AS n_parts, string_agg(p_type || '=' || example, ';' ORDER BY p_type) AS examples FROM e GROUP BY p_brand""",
    "build_stats": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in ("part", "orders", "customer", "documents", "pages")),
    "unit_type_counts": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "citation_expand": """
        WITH l AS (SELECT l_orderkey, l_linenumber AS n, least(l_partkey % 7, 4) AS more FROM lineitem),
        a AS (SELECT l_orderkey, n, unnest(range(n, n + more + 1)) AS x FROM l),
        u AS (SELECT DISTINCT l_orderkey, 'Article ' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '(' || l_linenumber % 3 || ')' ELSE '' END AS citation FROM lineitem),
        r AS (SELECT DISTINCT l_orderkey, n, 'Article ' || x || '(' || x % 3 || ')' AS requested, 'Article ' || x AS parent FROM a)
        SELECT r.l_orderkey, r.n, r.requested, coalesce(e.citation, p.citation) AS citation,
               CASE WHEN e.citation IS NOT NULL THEN 'exact' WHEN p.citation IS NOT NULL THEN 'parent_unit_fallback' ELSE 'unresolved' END AS basis
        FROM r LEFT JOIN u e ON e.l_orderkey = r.l_orderkey AND e.citation = r.requested LEFT JOIN u p ON p.l_orderkey = r.l_orderkey AND p.citation = r.parent""",
}
