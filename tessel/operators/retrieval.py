"""Exact lookup, filtered vector search, passages, related units, hydration and the catalogue (Q2 to Q7)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import folded, match_key, strict_key


def dot(vector: Column, query: Sequence[float] | Column) -> Column:
    """Inner product in double precision, in element order."""
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)


def normalized(vector: Column, least: float = 1e-12) -> Column:
    """The vector at unit length."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(least)))


def best_score(vector: Column, queries: Sequence[Sequence[float]]) -> Column:
    """The best product with any query vector (J10, A14). Query vectors are literals of the plan, so the scan has no join."""
    scores = [dot(vector, q) for q in queries]
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


#: Bytes of request vectors that travel to the tasks at once.
REQUEST_BYTES = 64 << 20


def scores_by_request(vectors: DataFrame, requests: DataFrame, request: str, vector: str = "embedding", query: str = "query", most_bytes: int = REQUEST_BYTES) -> DataFrame:
    """The best score of each vector for each request of a table (request, query vector), both kept apart by request.

    Every vector meets every request, as an exact scan must: a batch of vectors is multiplied with all request vectors at
    once, in double precision. The request vectors are broadcast in blocks of at most so many bytes, each a scan of its own;
    a request's vectors stay in one block. A null vector or request is left out.
    """
    spark = vectors.sparkSession
    kept = [c for c in vectors.columns if c != vector]
    kinds, named = dict(vectors.dtypes), requests.schema[request].dataType
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{request}` {named.simpleString()}", "score double"])

    def blocks() -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        own, first, rows, last = [], [], [], object()
        ordered = requests.where(F.col(request).isNotNull() & F.col(query).isNotNull()).select(request, query).orderBy(request)
        for r in ordered.toLocalIterator():
            if r[0] != last and rows and 8 * sum(map(len, rows)) > most_bytes:
                yield own, np.array(first), np.array(rows, np.float64)
                own, first, rows = [], [], []
            if r[0] != last or not own:
                own.append(r[0])
                first.append(len(rows))
                last = r[0]
            rows.append(r[1])
        if rows:
            yield own, np.array(first), np.array(rows, np.float64)

    def scored(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, first, asked = held.value
            step = max(1, (4 << 20) // (8 * len(asked)))  # rows of a product of 4 MB
            for whole in batches:
                whole = whole.filter(whole.column(vector).is_valid())
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    matrix = b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    best = np.maximum.reduceat(matrix @ asked.T, first, axis=1)
                    rows = np.repeat(np.arange(b.num_rows), len(own))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in kept), pa.array(own * b.num_rows, to_arrow_type(named)), pa.array(best.reshape(-1))], names=[*kept, request, "score"])

        return run

    out: DataFrame | None = None
    for block in blocks():
        part = vectors.mapInArrow(scored(spark.sparkContext.broadcast(block)), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def top(rows: DataFrame, request: Sequence[str], score: str, tie: str, limit: int) -> DataFrame:
    """The best rows of each request with their rank."""
    order = [F.col(score).desc(), F.col(tie)]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*request).orderBy(*order))).where(F.col("rank") <= limit)


def candidate_filter(*, source_type: Column, jurisdiction: Column, country: Column, date: Column, source_types: Sequence[str] = (), jurisdictions: Sequence[str] = (), countries: Sequence[str] = (), date_from: str | None = None, date_to: str | None = None, law: str = "law", case: str = "case") -> Column:
    """jurisdictions bind laws only; countries bind cases only and match country or jurisdiction; bounds keep rows without a date."""
    keep = F.lit(True)
    if source_types:
        keep = keep & source_type.isin(*source_types)
    if jurisdictions:
        keep = keep & ((source_type != law) | F.coalesce(jurisdiction.isin(*jurisdictions), F.lit(False)))
    if countries:
        keep = keep & ((source_type != case) | F.coalesce(country.isin(*countries) | jurisdiction.isin(*countries), F.lit(False)))
    if date_from:
        keep = keep & (date.isNull() | (date >= date_from))
    if date_to:
        keep = keep & (date.isNull() | (date <= date_to))
    return keep


def bound_to_documents(candidates: DataFrame, source_type: str, doc: str, record: str, links: DataFrame, doc_ids: Sequence[str], law: str = "law", case: str = "case") -> DataFrame:
    """The part of F5 on doc_ids: laws directly, cases if a link (record, doc) leads into one."""
    linked = links.where(F.col(doc).isin(*doc_ids)).select(record).distinct().withColumn("_linked", F.lit(True))
    rows = candidates.join(linked, record, "left")
    keep = ((F.col(source_type) == law) & F.col(doc).isin(*doc_ids)) | ((F.col(source_type) == case) & F.coalesce("_linked", F.lit(False)))
    return rows.where(keep).drop("_linked")


def exact_lookup(units: DataFrame, citations: DataFrame, doc: str = "doc_id", citation: str = "local_citation", wanted: str = "wanted", position: str = "position", *, fold: bool = False) -> DataFrame:
    """Units of a citation (J3): equal loose keys meet in the join, equal strict keys decide. citations(doc, wanted, position).

    fold makes compatibility forms plain and folds case first, which runs Python on both sides' citations.
    """
    plain = folded if fold else (lambda c: c)
    left = units.withColumn("_s", plain(F.col(citation))).withColumn("_k", match_key(F.col("_s")))
    right = citations.select(doc, F.col(wanted), F.col(position), plain(F.col(wanted)).alias("_w")).withColumn("_k", match_key(F.col("_w")))
    return left.join(right, [doc, "_k"]).where(strict_key(F.col("_s")) == strict_key(F.col("_w"))).drop("_k", "_s", "_w")


def related(links: DataFrame, units: DataFrame, laws: DataFrame, request: str, unit: str, doc: str, limit: int) -> DataFrame:
    """Units that a request's cases are linked with, each once, the first `limit` by unit id."""
    pairs = links.select(request, unit).distinct()
    own = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(unit))).where(F.col("rank") <= limit)
    return own.join(units, unit).join(laws, doc)


def children_in_order(children: DataFrame, parent: str, sequence: str, *values: str) -> DataFrame:
    """Per parent its children as an array of structs in sequence order."""
    return children.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(sequence, *values))).alias("children"))


def refine_by_passages(ranked: DataFrame, passages: DataFrame, request: Sequence[str], parent: str, passage: str, score: str, limit: int) -> DataFrame:
    """Of all passages of the ranked parents the best `limit` for a request; a parent's score becomes the better of its own and its best passage's, its rank stays."""
    own = passages.join(ranked.select(*request, parent), [*request, parent], "left_semi")
    best = own.withColumn("_p", F.row_number().over(Window.partitionBy(*request).orderBy(F.col(score).desc(), passage))).where(F.col("_p") <= limit)
    lifted = best.groupBy(*request, parent).agg(F.max(score).alias("_best"), F.transform(F.array_sort(F.collect_list(F.struct("_p", passage))), lambda x: x[passage]).alias("passages"))
    out = ranked.join(lifted, [*request, parent], "left")
    return out.withColumn(score, F.greatest(F.col(score), F.col("_best"))).withColumn("passages", F.coalesce("passages", F.array().cast("array<string>") if dict(passages.dtypes)[passage] == "string" else F.array().cast(f"array<{dict(passages.dtypes)[passage]}>"))).drop("_best")


def examples(units: DataFrame, doc: str, kind: str, citation: str) -> DataFrame:
    """Of each document a map from the kinds of its units to the first citation of each."""
    least = units.where(F.col(kind).isNotNull()).groupBy(doc, kind).agg(F.min(citation).alias("example"))
    return least.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "example")))).alias("examples"))
