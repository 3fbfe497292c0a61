"""Deduplication, fusion, quotas and merges of rankings.

Rankings are rows with a request column and an explicit position; nothing relies on row order.
Every operator works on all requests at once: a grouping by (request, key) is a hash aggregate with
partial sums, and only per-request ranks need a window, which is partitioned by the request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_position_last_value(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Per key the last row's values at the first row's position (A1)."""
    values = [c for c in rows.columns if c not in (*keys, position)]
    return rows.groupBy(*keys).agg(F.min(position).alias(position), F.max_by(F.struct(*values), position).alias("_v")).select(*keys, position, *(F.col(f"_v.{c}").alias(c) for c in values))


def first_wins(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Per key the first row (A2)."""
    values = [c for c in rows.columns if c not in (*keys, position)]
    return rows.groupBy(*keys).agg(F.min(position).alias(position), F.min_by(F.struct(F.lit(0).alias("_"), *values), position).alias("_v")).select(*keys, position, *(F.col(f"_v.{c}").alias(c) for c in values))


def latest_version(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], content: str) -> DataFrame:
    """Per key the row with the largest order values, the number of rows, and whether contents differ (A3)."""
    values = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)))).alias("_v"), F.count("*").alias("n_rows"), (F.count_distinct(F.sha2(content, 256)) > 1).alias("conflicting"))
    return found.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in values), "n_rows", "conflicting")


def keep_success(rows: DataFrame, keys: Sequence[str], failed: Column, position: str) -> DataFrame:
    """Per key a success before any failure, and of equals the later row (A4)."""
    values = [c for c in rows.columns if c not in keys]
    found = rows.withColumn("_ok", ~F.coalesce(failed, F.lit(False))).groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("_ok", position)).alias("_v"))
    return found.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in values))


def merge_roles(rows: DataFrame, keys: Sequence[str], position: str, score: str, roles: str) -> DataFrame:
    """Per key the first position, the best score (the earlier of equals) and all roles in order of first sight (A5)."""
    seen = F.array_sort(F.collect_list(F.struct(position, roles)))
    return rows.groupBy(*keys).agg(F.min(position).alias(position), F.max(score).alias(score), F.max_by(position, F.struct(F.col(score), -F.col(position))).alias("best_position"), F.array_distinct(F.transform(seen, lambda x: x[roles])).alias(roles))


def diverse_top(rows: DataFrame, request: Sequence[str], group: str, score: str, tie: str, limit: int) -> DataFrame:
    """Of each group its best max(1, limit // groups) rows, then the best of the rest, `limit` in all, ranked by score."""
    by = Window.partitionBy(*request)
    best_first = [F.col(score).desc(), F.col(tie)]
    n_groups = rows.groupBy(*request).agg(F.count_distinct(group).alias("_n"))
    own = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*request, group).orderBy(*best_first)))
    # no row beyond the limit within its group can be selected, so the wider windows see few rows
    own = own.where(F.col("_r") <= limit)
    own = own.join(n_groups, list(request))
    first_seen = F.min(tie).over(Window.partitionBy(*request, group))
    own = own.withColumn("_quota", F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_n")))).withColumn("_later", F.col("_r") > F.col("_quota")).withColumn("_first", F.when(F.col("_later"), F.lit(None)).otherwise(first_seen))
    picked = own.withColumn("_p", F.row_number().over(by.orderBy("_later", F.col("_first").asc_nulls_last(), *best_first))).where(F.col("_p") <= limit)
    return picked.withColumn("rank", F.row_number().over(by.orderBy(*best_first))).select(*rows.columns, "rank")


def reciprocal_rank_fusion(recalled: DataFrame, reranked: DataFrame, request: Sequence[str], key: str, rank: str, weight: float = 0.25, constant: int = 60) -> DataFrame:
    """weight / (constant + reranked rank) + (1 - weight) / (constant + recalled rank); an absent row ranks one past the end."""
    join = [*request, key]
    a, b = recalled.select(*join, F.col(rank).alias("recall_rank")), reranked.select(*join, F.col(rank).alias("rerank_rank"))
    both = a.join(b, join, "full_outer")
    whole = Window.partitionBy(*request)
    na, nb = F.count("recall_rank").over(whole), F.count("rerank_rank").over(whole)
    x, y = F.coalesce("rerank_rank", nb + 1), F.coalesce("recall_rank", na + 1)
    scored = both.select(*join, "recall_rank", "rerank_rank", (F.lit(weight) / (constant + x) + F.lit(1 - weight) / (constant + y)).alias("score"))
    order = Window.partitionBy(*request).orderBy(F.col("score").desc(), F.col("recall_rank").asc_nulls_last(), F.col("rerank_rank"))
    return scored.withColumn("rank", F.row_number().over(order))


def role_quotas(limit: int, roles: Sequence[str], cycle: Sequence[str]) -> dict[str, int]:
    """One slot for each role while there are any, the rest in turn through the cycle."""
    out = dict.fromkeys(roles, 0)
    for role in roles[:limit]:
        out[role] = 1
    for i in range(max(limit - len(roles), 0)):
        out[cycle[i % len(cycle)]] += 1
    return out


def quota_interleave(rows: DataFrame, request: Sequence[str], role: str, key: str, rank: str, quotas: dict[str, int], limit: int) -> DataFrame:
    """Each role in turn takes its quota of rows that no earlier role took; slots alternate over the roles, then the rest follows in role order.

    A role's choice depends on the roles before it, so the choice is a fold over a request's candidates in role
    order, after one grouping. Ranks count from 1; no row past limit + sum(quotas) of its role can be
    shown, so the arrays are that short.
    """
    most = sum(quotas.values())
    order_of = F.create_map(*(F.lit(x) for i, name in enumerate(quotas) for x in (name, i)))
    quota_of = F.array(*(F.lit(q) for q in quotas.values()))
    candidate = F.struct(F.try_element_at(order_of, F.col(role)).alias("r"), F.col(rank).cast("int").alias("n"), F.col(key).alias("k"))
    kind = dict(rows.dtypes)[key]
    grouped = rows.where((F.col(rank) <= limit + most) & F.col(role).isin(*quotas)).groupBy(*request).agg(F.array_sort(F.collect_list(candidate)).alias("c"))

    def step(picked: Column, x: Column) -> Column:
        slot = F.size(F.filter(picked, lambda p: p["r"] == x["r"]))
        taken = F.exists(picked, lambda p: p["k"] == x["k"]) | (slot >= F.element_at(quota_of, x["r"] + 1))
        return F.when(taken, picked).otherwise(F.array_append(picked, F.struct((slot + 1).alias("slot"), x["r"].alias("r"), x["k"].alias("k"))))

    chosen = F.array_sort(F.aggregate("c", F.expr(f"cast(array() as array<struct<slot:int,r:int,k:{kind}>>)"), step))
    picked = grouped.select(*request, "c", chosen.alias("p"))
    rest = F.filter("c", lambda x: ~F.exists("p", lambda p: p["k"] == x["k"]))
    first = F.filter(rest, lambda x: ~F.exists(rest, lambda y: (y["k"] == x["k"]) & (y < x)))
    shown = F.slice(F.concat(F.transform("p", lambda p: F.struct(p["r"].alias("r"), p["k"].alias("k"))), F.transform(first, lambda x: F.struct(x["r"].alias("r"), x["k"].alias("k")))), 1, limit)
    names = F.array(*(F.lit(name) for name in quotas))
    return picked.select(*request, F.posexplode(shown).alias("at", "x")).select(*request, F.col("x.k").alias(key), F.element_at(names, F.col("x.r") + 1).alias(role), (F.col("at") + 1).alias("position"))


def priority_merge(sources: Sequence[DataFrame], request: Sequence[str], key: str, rank: str, limit: int) -> DataFrame:
    """Rankings one after the other, each key once at its first position, cut at the limit."""
    every: DataFrame | None = None
    for i, source in enumerate(sources):
        part = source.select(*request, key, F.struct(F.lit(i).alias("source"), F.col(rank).alias("rank")).alias("at"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(*request, key).agg(F.min("at").alias("at"))
    order = Window.partitionBy(*request).orderBy("at", key)
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select(*request, key, F.col("at.source").alias("source"), "position")


def reserved_slot_merge(rows: DataFrame, request: Sequence[str], kind: str, main: str, rank: str, key: str, limit: int, reserve: bool) -> DataFrame:
    """Rows of the main kind first; one slot of the limit stays for another kind if it has any and the limit allows."""
    is_main = F.col(kind) == main
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*request, F.col(kind) == main).orderBy(rank, key)))
    others = F.max(F.when(~is_main, 1).otherwise(0)).over(Window.partitionBy(*request))
    room = F.lit(limit) - (others if reserve and limit > 1 else F.lit(0))
    order = F.when(is_main & (F.col("_r") <= room), 0).when(~is_main, 1).otherwise(2)
    merged = ranked.withColumn("_o", order).withColumn("position", F.row_number().over(Window.partitionBy(*request).orderBy("_o", "_r", key)))
    return merged.where(F.col("position") <= limit).select(*rows.columns, "position")
