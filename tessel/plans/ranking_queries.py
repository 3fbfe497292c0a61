"""Deduplication, merges of rankings and metrics over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, ranking
from .retrieval_queries import read

ROLES = ("applicable_law", "analogous_case", "supplementary_obligations")
CYCLE = ("applicable_law", "analogous_case", "applicable_law", "supplementary_obligations")


def dedupe_first_pos_last_val(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("position"), "event_type", F.round("value", 6).alias("value"))
    return ranking.first_position_last_value(events, ["user_id"], "position")


def dedupe_first_wins(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("position"), F.round("value", 6).alias("value"))
    return ranking.first_wins(events, ["user_id", "event_type"], "position")


def latest_version_select(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "props")
    out = ranking.latest_version(events, ["user_id"], [F.col("ts"), F.length("props"), F.col("event_id")], "event_type")
    return out.select("user_id", "event_id", "event_type", "n_rows", "conflicting")


def keep_success_result(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return ranking.keep_success(events, ["user_id"], F.col("event_type") == "error", "event_id")


def role_merge_dedupe(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("position"), F.round("value", 6).alias("score"), F.col("event_type").alias("roles"))
    return ranking.merge_roles(events, ["user_id"], "position", "score", "roles").withColumn("roles", F.array_join("roles", ","))


def _role_rows(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("request_id"), F.col("l_partkey").alias("item"), label.alias("role")).agg(F.sum("l_quantity").alias("q"))
    from pyspark.sql import Window

    order = Window.partitionBy("request_id", "role").orderBy(F.col("q").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 12").select("request_id", "role", "item", "rank")


def role_quota_interleave(spark, sf_dir):
    return ranking.quota_interleave(_role_rows(spark, sf_dir), ["request_id"], "role", "item", "rank", ranking.role_quotas(8, ROLES, CYCLE), 8)


def _two_sources(spark, sf_dir):
    from pyspark.sql import Window

    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), F.lit("case").alias("kind"), F.col("o_orderkey").alias("item"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).alias("rank"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("law").alias("kind"), F.col("c_custkey").alias("item"), F.lit(1).alias("rank"))
    return orders, customers


def source_coverage_merge(spark, sf_dir):
    orders, customers = _two_sources(spark, sf_dir)
    return ranking.priority_merge([customers, orders], ["request_id"], "item", "rank", 5)


def case_slot_merge(spark, sf_dir):
    orders, customers = _two_sources(spark, sf_dir)
    return ranking.reserved_slot_merge(customers.unionByName(orders), ["request_id"], "kind", "case", "rank", "item", 4, True).select("request_id", "kind", "item", "position")


def _tasks(spark, sf_dir) -> int:
    """Half a million lines to a task."""
    return max(1, -(-read(spark, sf_dir, "lineitem").count() // 500_000))


def _judged(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    truth = line.select("l_orderkey", "l_partkey", "l_linenumber").repartition(_tasks(spark, sf_dir), "l_orderkey", "l_partkey").groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("item_id")).agg(F.max((F.col("l_linenumber") % 3 + 1).cast("int")).alias("grade"), F.max(F.col("l_linenumber") == 1).alias("required"))
    ranks = line.select(F.col("l_orderkey").alias("sample_id"), (F.col("l_partkey") + F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(F.col("l_linenumber") % 3)).alias("item_id"), F.col("l_linenumber").alias("rank"))
    return truth, ranks


def ir_metrics(spark, sf_dir):
    return evaluation.metrics(*_judged(spark, sf_dir), (1, 3, 5), partitions=_tasks(spark, sf_dir))


def metrics_by_group(spark, sf_dir):
    scores = evaluation.metrics(*_judged(spark, sf_dir), (3,), partitions=_tasks(spark, sf_dir)).withColumn("task", F.when(F.col("sample_id") % 20 == 0, "even").otherwise("odd")).withColumn("split", F.when(F.col("sample_id") % 30 == 0, "test").otherwise("dev"))
    return evaluation.means(scores, ["recall", "mrr", "ndcg"], ["task", "split"])


def coverage_groups(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    groups = line.groupBy("l_orderkey", "l_returnflag").agg(F.collect_set("l_suppkey").alias("ids")).select("l_orderkey", F.struct(F.col("ids"), F.least(F.size("ids"), F.lit(2)).alias("min_hits")).alias("g")).groupBy("l_orderkey").agg(F.collect_list("g").alias("groups"))
    got = line.where("l_suppkey % 3 <> 0").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("retrieved"))
    joined = groups.join(got, "l_orderkey", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<bigint>")))
    return joined.select("l_orderkey", F.round(evaluation.coverage(F.col("groups"), F.col("retrieved")), 6).alias("coverage"))


def benchmark_counts(spark, sf_dir):
    """Rows by language, by source, and by both in one pass."""
    docs = read(spark, sf_dir, "documents")
    return docs.groupingSets([[F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (dedupe_first_pos_last_val, dedupe_first_wins, latest_version_select, keep_success_result, role_merge_dedupe, role_quota_interleave, source_coverage_merge, case_slot_merge, ir_metrics, metrics_by_group, coverage_groups, benchmark_counts)
}

_ROLE_ROWS = """r0 AS (
    SELECT l_suppkey % 20 AS request_id, l_partkey AS item, ['applicable_law', 'analogous_case', 'supplementary_obligations'][l_linenumber % 3 + 1] AS role, sum(l_quantity) AS q
    FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT request_id, role, item, row_number() OVER (PARTITION BY request_id, role ORDER BY q DESC, item) AS rank FROM r0 QUALIFY rank <= 12)"""
_JUDGED = """truth AS (
    SELECT l_orderkey AS sample_id, l_partkey AS item_id, max(l_linenumber % 3 + 1) AS grade, bool_or(l_linenumber = 1) AS required
    FROM lineitem GROUP BY 1, 2),
best AS (
    SELECT sample_id, item_id, row_number() OVER (PARTITION BY sample_id ORDER BY min(rank), item_id) AS rank
    FROM (SELECT l_orderkey AS sample_id, l_partkey + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_linenumber % 3 END AS item_id, l_linenumber AS rank FROM lineitem)
    GROUP BY sample_id, item_id),
ideal AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY grade DESC, item_id) AS i FROM truth),
t AS (
    SELECT sample_id, k, count(*) AS n_relevant, count(*) FILTER (required) AS n_required, sum(CASE WHEN i <= k THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS ideal
    FROM ideal, (SELECT unnest({ks}) AS k) GROUP BY 1, 2),
g AS (
    SELECT b.sample_id, k, count(*) AS n, count(grade) AS hits, count(*) FILTER (required) AS req, min(rank) FILTER (grade IS NOT NULL) AS first,
           sum(CASE WHEN grade IS NULL THEN 0 ELSE (pow(2, grade) - 1) / log2(rank + 1) END) AS dcg
    FROM best b LEFT JOIN truth USING (sample_id, item_id), (SELECT unnest({ks}) AS k) WHERE rank <= k GROUP BY 1, 2),
m AS (
    SELECT sample_id, k, round(hits / n, 6) AS precision, round(hits / n_relevant, 6) AS recall, round(CASE WHEN n_required = 0 THEN 1.0::DOUBLE ELSE req / n_required END, 6) AS required_recall,
           round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(CASE WHEN ideal = 0 THEN 0 ELSE dcg / ideal END, 6) AS ndcg
    FROM t JOIN g USING (sample_id, k))"""

ORACLE_SQL = {
    "dedupe_first_pos_last_val": "SELECT user_id, min(event_id) AS position, arg_max(event_type, event_id) AS event_type, arg_max(round(value, 6), event_id) AS value FROM events GROUP BY user_id",
    "dedupe_first_wins": "SELECT user_id, event_type, min(event_id) AS position, arg_min(round(value, 6), event_id) AS value FROM events GROUP BY user_id, event_type",
    "latest_version_select": """
        SELECT user_id, arg_max(event_id, (ts, length(props), event_id)) AS event_id, arg_max(event_type, (ts, length(props), event_id)) AS event_type,
               count(*) AS n_rows, count(DISTINCT event_type) > 1 AS conflicting FROM events GROUP BY user_id""",
    "keep_success_result": "SELECT user_id, arg_max(event_id, (event_type <> 'error', event_id)) AS event_id, arg_max(event_type, (event_type <> 'error', event_id)) AS event_type FROM events GROUP BY user_id",
    "role_merge_dedupe": """
        WITH e AS (SELECT user_id, event_id, round(value, 6) AS v, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
        SELECT user_id, min(event_id) AS position, max(v) AS score, arg_max(event_id, (v, -event_id)) AS best_position, string_agg(event_type, ',' ORDER BY event_id) FILTER (n = 1) AS roles FROM e GROUP BY user_id""",
    "role_quota_interleave": f"""
        WITH {_ROLE_ROWS},
        a AS (SELECT *, rank AS slot, 0 AS ro FROM r WHERE role = 'applicable_law' AND rank <= 4),
        b AS (SELECT r.*, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS slot, 1 AS ro FROM r WHERE role = 'analogous_case' AND NOT EXISTS (SELECT 1 FROM a WHERE a.request_id = r.request_id AND a.item = r.item) QUALIFY slot <= 2),
        ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
        c AS (SELECT r.*, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS slot, 2 AS ro FROM r WHERE role = 'supplementary_obligations' AND NOT EXISTS (SELECT 1 FROM ab WHERE ab.request_id = r.request_id AND ab.item = r.item) QUALIFY slot <= 2),
        p AS (SELECT * FROM ab UNION ALL SELECT * FROM c),
        o AS (SELECT r.*, CASE role WHEN 'applicable_law' THEN 0 WHEN 'analogous_case' THEN 1 ELSE 2 END AS ro FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.request_id = r.request_id AND p.item = r.item)),
        rest AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY request_id, item ORDER BY ro, rank) = 1),
        every AS (SELECT request_id, item, role, 0 AS rest, slot, ro, rank FROM p UNION ALL SELECT request_id, item, role, 1, NULL, ro, rank FROM rest)
        SELECT request_id, item, role, row_number() OVER (PARTITION BY request_id ORDER BY rest, slot, ro, rank)::INT AS position FROM every QUALIFY position <= 8""",
    "source_coverage_merge": """
        WITH s AS (SELECT c_custkey AS request_id, c_custkey AS item, 0 AS source, 1 AS rank FROM customer
                   UNION ALL SELECT o_custkey, o_orderkey, 1, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) FROM orders),
        f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY request_id, item ORDER BY source, rank) = 1)
        SELECT request_id, item, source, row_number() OVER (PARTITION BY request_id ORDER BY source, rank, item)::INT AS position FROM f QUALIFY position <= 5""",
    "case_slot_merge": """
        WITH s AS (SELECT c_custkey AS request_id, 'law' AS kind, c_custkey AS item, 1 AS rank FROM customer
                   UNION ALL SELECT o_custkey, 'case', o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) FROM orders),
        r AS (SELECT *, row_number() OVER (PARTITION BY request_id, kind ORDER BY rank, item) AS r, max((kind = 'law')::INT) OVER (PARTITION BY request_id) AS others FROM s)
        SELECT request_id, kind, item, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN kind = 'case' AND r <= 4 - others THEN 0 WHEN kind = 'law' THEN 1 ELSE 2 END, r, item)::INT AS position FROM r QUALIFY position <= 4""",
    "ir_metrics": f"WITH {_JUDGED.format(ks='[1, 3, 5]')} SELECT * FROM m",
    "metrics_by_group": f"""
        WITH {_JUDGED.format(ks='[3]')}, x AS (SELECT *, CASE WHEN sample_id % 20 = 0 THEN 'even' ELSE 'odd' END AS task, CASE WHEN sample_id % 30 = 0 THEN 'test' ELSE 'dev' END AS split FROM m)
        SELECT task, split, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM x GROUP BY GROUPING SETS ((), (task), (split))""",
    "coverage_groups": """
        WITH g AS (SELECT l_orderkey, l_returnflag, least(count(DISTINCT l_suppkey), 2) AS need, count(DISTINCT l_suppkey) FILTER (l_suppkey % 3 <> 0
                          OR l_suppkey IN (SELECT 0 WHERE false)) AS hits FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey, round(avg((hits >= need)::INT), 6) AS coverage FROM g GROUP BY l_orderkey""",
    "benchmark_counts": "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
}
